"""What may be plugged in, and the callbacks that only look on."""

from __future__ import annotations

import logging
from collections.abc import Callable
from typing import ClassVar

from pyspark.sql import DataFrame

log = logging.getLogger(__name__)


class Plugin:
    """Every plugin names its version."""

    version: ClassVar[str] = ""


class Extractor(Plugin):
    """``parse(bytes)`` to a list of blocks, for one source type."""

    source_type: ClassVar[str] = ""

    def parse(self, content: bytes) -> list[dict]:
        raise NotImplementedError


class Chunker(Plugin):
    def chunk(self, text: str) -> list[str]:
        raise NotImplementedError


class Embedder(Plugin):
    """``dim`` numbers a text, many texts at once."""

    dim: ClassVar[int] = 0

    def embed(self, texts: list[str]) -> list[list[float]]:
        raise NotImplementedError


class Vision(Plugin):
    def describe(self, prompt: str, image_url: str) -> dict:
        raise NotImplementedError


class GraphModel(Plugin):
    def distil(self, text: str) -> dict:
        raise NotImplementedError


class Reranker(Plugin):
    """Positions of the texts by falling relevance."""

    def order(self, query: str, texts: list[str]) -> list[int]:
        raise NotImplementedError


class Judge(Plugin):
    def supported(self, claim: str, passage: str) -> bool:
        raise NotImplementedError


class Evaluator(Plugin):
    def evaluate(self, results: DataFrame, golden: DataFrame) -> DataFrame:
        raise NotImplementedError


class Detector(Plugin):
    """(language, confidence, reliable) of a text."""

    def detect(self, text: str) -> tuple[str, float, bool]:
        raise NotImplementedError


class Memory(Plugin):
    def recall(self, queries: DataFrame) -> DataFrame:
        raise NotImplementedError


class Retriever(Plugin):
    """May add one ranked list: (question_id, doc_id, score, rank) of at most k a question."""

    COLUMNS = ("question_id", "doc_id", "score", "rank")

    def retrieve(self, questions: DataFrame, k: int) -> DataFrame:
        raise NotImplementedError


SLOTS = (Extractor, Chunker, Embedder, Vision, GraphModel, Reranker, Judge, Evaluator, Detector, Memory)


class Registry:
    """One plugin a slot, the last one given; retrievers add up."""

    def __init__(self) -> None:
        self.slots: dict[type[Plugin], Plugin] = {}
        self.extractors: dict[str, Extractor] = {}
        self.retrievers: list[Retriever] = []

    def use(self, plugin: Plugin) -> None:
        kinds = [k for k in (*SLOTS, Retriever) if isinstance(plugin, k)]
        if len(kinds) != 1:
            raise TypeError(f"{type(plugin).__name__} is {len(kinds)} kinds of plugin, not one")
        if not isinstance(plugin.version, str) or not plugin.version.strip():
            raise ValueError(f"{type(plugin).__name__} names no version")
        if kinds[0] is Retriever:
            self.retrievers.append(plugin)
        elif kinds[0] is Extractor:
            self.extractors[plugin.source_type] = plugin
        else:
            self.slots[kinds[0]] = plugin

    def get(self, kind: type[Plugin]) -> Plugin | None:
        return self.slots.get(kind)

    def lists(self, questions: DataFrame, k: int) -> list[DataFrame]:
        """The retrievers' lists; one without the columns of a list, or longer than k, is an error or cut."""
        out = []
        for r in self.retrievers:
            found = r.retrieve(questions, k)
            if missing := set(Retriever.COLUMNS) - set(found.columns):
                raise ValueError(f"{type(r).__name__} gives no {sorted(missing)}")
            out.append(found.select(*Retriever.COLUMNS).filter(found["rank"] <= k))
        return out


class Hooks:
    """Callbacks by name (``ingest``, ``delete``, ``retrieve``, ``answer``, ``chunk``); one that fails is logged and changes nothing."""

    def __init__(self, **on: Callable) -> None:
        self.on = on

    def fire(self, name: str, *args: object) -> None:
        if name in self.on:
            try:
                self.on[name](*args)
            except Exception:
                log.warning("hook %s failed", name, exc_info=True)
