"""Language and script of texts by closed word lists, and the choice of an answer's language."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from lodestone.functions import tables as T
from lodestone.functions import text as X

RELIABLE, MIXED = 0.5, 0.4


def latin_language(text: Column, default: str = "en") -> Column:
    """The language with the most cue words in the text, the first of equal ones; the default without any."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w.rlike(r"^\p{L}+$")))
    best, lang = F.lit(0), F.lit(default)
    for code, cues in T.LATIN_CUES.items():
        hits = F.size(F.array_intersect(words, X.words(cues)))
        lang = F.when(hits > best, code).otherwise(lang)
        best = F.greatest(best, hits)
    return lang


def answer_language(explicit: Column, detected: Column, confidence: Column, conversation: Column, default: str = "en") -> Column:
    """Explicit unless ``auto``, then a reliable detection, then the conversation's, then the default."""
    return F.coalesce(F.nullif(explicit, F.lit("auto")), F.when(confidence >= RELIABLE, detected), conversation, F.lit(default))


def code_mixed(shares: Column, strong: float = MIXED) -> Column:
    """Whether the two greatest shares are both strong."""
    best = F.slice(F.sort_array(shares, asc=False), 1, 2)
    return (F.size(best) == 2) & F.forall(best, lambda s: s >= strong)


_OF_SCRIPT = dict(p.split(":") for p in "latin:en cyrillic:ru greek:el hebrew:he arabic:ar devanagari:hi bengali:bn tamil:ta telugu:te kannada:kn malayalam:ml gujarati:gu gurmukhi:pa thai:th hangul:ko hiragana:ja katakana:ja cjk:zh".split())


def detect(text: str, default: str = "en") -> tuple[str, float, bool]:
    """(language, confidence, reliable): by the script that most letters have, of Latin ones by cue words; confidence is that script's share of the letters."""
    names: Counter[str] = Counter()
    for ch, n in Counter(text).items():
        if ch.isalpha() and (name := unicodedata.name(ch, "")):
            names[name.split(" ")[0].lower()] += n
    total = sum(names.values())
    if not total:
        return default, 0.0, False
    first = {s: text.index(next(c for c in text if c.isalpha() and unicodedata.name(c, "").lower().split(" ")[0] == s)) for s in names}
    script = min(names, key=lambda s: (-names[s], first[s]))
    share = names[script] / total
    lang = _OF_SCRIPT.get(script, default)
    if script == "latin":
        held = {w for w in text.lower().split() if w.isalpha()}
        best = 0
        for code, cues in T.LATIN_CUES.items():
            if (hits := len(held & cues)) > best:
                best, lang = hits, code
    return lang, share, share >= RELIABLE


@F.arrow_udf(StructType([StructField("language", StringType()), StructField("confidence", DoubleType()), StructField("reliable", BooleanType())]))
def detected(text: pa.Array) -> pa.Array:
    """``detect`` as a struct. Of a batch one text at a time is a Python object."""
    cols = list(zip(*(detect(t.as_py() or "") for t in text), strict=True)) or [()] * 3
    return pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.string(), pa.float64(), pa.bool_()), strict=True)], ["language", "confidence", "reliable"])


def requested(explicit: Column, found: Column, conversation: Column, default: str = "en") -> Column:
    """The answer's language; what was detected (a ``detected`` struct) counts only where ``auto`` was asked for."""
    auto = F.coalesce(explicit == "auto", F.lit(False))
    return answer_language(explicit, F.when(auto, found["language"]), F.when(auto, found["confidence"]), conversation, default)


_SPOKEN = """
latin en fr de es pt it nl pl tr vi id sw
cyrillic ru uk
greek el
hebrew he
arabic ar fa ur
devanagari hi mr ne
bengali bn as
tamil ta
thai th
hangul ko
han zh
han+hiragana+katakana ja
telugu te
kannada kn
malayalam ml
gujarati gu
gurmukhi pa
oriya or
sinhala si
khmer km
lao lo
myanmar my
georgian ka
armenian hy
"""
SPOKEN = {code: tuple(line.split()[0].split("+")) for line in _SPOKEN.strip().splitlines() for code in line.split()[1:]}
"""The scripts of each language that may be searched for."""


class CannotSearch(ValueError):
    """A language is unknown, or written in a script that the tokenizer doesn't support."""


def search_languages(codes: Iterable[str]) -> list[str]:
    """The languages in the order asked for, each once. An unknown one, one of an unsupported script, or none at all, is an error before any work is done."""
    out: list[str] = []
    for raw in codes:
        code = raw.strip().lower()
        if code not in SPOKEN:
            raise CannotSearch(f"unknown language {raw!r}")
        if missing := [s for s in SPOKEN[code] if s not in X.SUPPORTED]:
            raise CannotSearch(f"{code} is written in {missing[0]}, which is not supported")
        if code not in out:
            out.append(code)
    if not out:
        raise CannotSearch("name at least one language")
    return out
