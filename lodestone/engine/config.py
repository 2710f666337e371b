"""Configuration: a tree of plain values, out of defaults, a source, overrides and the environment, in that order."""

from __future__ import annotations

import copy
import json
import os
import re
import warnings
from collections.abc import Iterable, Mapping
from pathlib import Path

SIGNALS = ("embedding", "text", "structure", "graph", "wiki", "community")
"""``community`` is another name for the graph's signal."""
PREFIX = "LODESTONE_"
DEFAULTS: dict = {
    "signals": list(SIGNALS),
    "retrieval": {"k": 5, "rerank_head": 50},
    "chunk": {"max_words": 450, "overlap": 60},
    "authority": {"key": None, "order": [], "floor": None},
    "deep": {"max_hops": 4, "max_tool_calls": 10, "max_evidence_units": 40, "timeout_s": 60.0, "search_k": 5},
    "answer": {"language": "en"},
    "models": {},
    "doc_types": None,
}
_ENV = re.compile(r"\$\{(\w+)\}")


def merged(base: Mapping, over: Mapping) -> dict:
    """``over`` laid on ``base``, level by level."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(out.get(k), Mapping) and isinstance(v, Mapping) else v
    return out


def _read(source: Mapping | str | Path | None) -> dict:
    if source is None:
        return {}
    if isinstance(source, Mapping):
        return dict(source)
    text = source
    if isinstance(source, Path) or (len(source) < 4096 and "\n" not in source and os.path.isfile(source)):
        text = Path(source).read_text(encoding="utf-8")
    try:
        found = json.loads(text)
    except ValueError:
        import yaml  # only where the source isn't JSON

        found = yaml.safe_load(text)
    if found is None:
        return {}
    if not isinstance(found, Mapping):
        raise TypeError("a configuration is a mapping")
    return dict(found)


def from_env(env: Mapping[str, str], prefix: str = PREFIX) -> dict:
    """``PREFIX_A__B=v`` becomes {"a": {"b": "v"}}; values are read as JSON where they can be."""
    out: dict = {}
    for key, value in env.items():
        if key.startswith(prefix):
            *path, last = key[len(prefix) :].lower().split("__")
            at = out
            for k in path:
                at = at.setdefault(k, {})
            try:
                at[last] = json.loads(value)
            except ValueError:
                at[last] = value
    return out


def load(source: Mapping | str | Path | None = None, overrides: Mapping | None = None, env: Mapping[str, str] | None = None, prefix: str = PREFIX) -> dict:
    out = merged(copy.deepcopy(DEFAULTS), _read(source))
    out = merged(out, overrides or {})
    out = merged(out, from_env(os.environ if env is None else env, prefix))
    out["signals"] = sorted(signals(out["signals"]))
    return out


def signals(declared: Iterable[str] | None) -> frozenset[str]:
    """The declared signals; all of them if none are declared; an unknown one is an error."""
    if declared is None:
        return frozenset(SIGNALS)
    names = frozenset(declared)
    if unknown := names - set(SIGNALS):
        raise ValueError(f"unknown signals {sorted(unknown)}")
    return names


def check(config: Mapping, allowed: Mapping | str | Path | None) -> Mapping:
    """The configuration as it is, with a warning for signals and types of documents outside an allow-list; without the list, or its file, nothing."""
    if allowed is None or (isinstance(allowed, (str, Path)) and not os.path.isfile(allowed)):
        return config
    rules = _read(allowed)
    for name, have in (("allowed_signals", config.get("signals")), ("allowed_doc_types", config.get("doc_types"))):
        if rules.get(name) is not None and have is not None and (extra := sorted(set(have) - set(rules[name]))):
            warnings.warn(f"{extra} are outside {name} {sorted(rules[name])}", stacklevel=2)
    return config


def expand(value: str, env: Mapping[str, str] | None = None) -> str:
    """``${NAME}`` replaced by the environment's value, by nothing where it has none."""
    have = os.environ if env is None else env
    return _ENV.sub(lambda m: have.get(m[1], ""), value)


def named(value: str) -> list[str]:
    """The names that ``expand`` would look up."""
    return _ENV.findall(value)
