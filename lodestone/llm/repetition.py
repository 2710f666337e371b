"""Quality rules on repetition: how much of a text lies in repeated lines and n-grams.

For each length n, words are hashed by a rolling hash (lower case, marks left
out); the characters in any occurrence of an n-gram that the document has more
than once are counted once each, over the characters of all its words. In
scripts without spaces each character is a word. For lines, the characters of
lines that occur more than once, over those of all lines; lines are compared
stripped, blank ones don't count.

The rules follow the published Gopher/MassiveText thresholds, which count the
repeats without their first occurrence; as every occurrence counts here, the
bounds are set anew (see ``RULES``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm import kernels as K
from lodestone.llm.common import batches

LENGTHS = (2, 3, 4, 5, 7, 10)
RULES = {"lines": 0.5, "ngram_4": 0.6, "ngram_5": 0.55, "ngram_7": 0.5, "ngram_10": 0.5}
"""A document breaks a rule if the share is above the bound."""


def _repeated(h: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(h), bool)
    twice = twice[np.r_[True, twice[1:] != twice[:-1]]]
    at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    return twice[at] == h


def shares(column: pa.Array) -> dict[str, np.ndarray]:
    """``words``, ``lines`` and ``ngram_n`` of each text; 0 where a text has no word or line."""
    data, offsets = K.text_buffer(column)
    n_docs = len(offsets) - 1
    out = {"words": np.zeros(n_docs, np.int64), "lines": np.zeros(n_docs)} | {f"ngram_{n}": np.zeros(n_docs) for n in LENGTHS}
    for i, j in K.blocks(offsets):
        d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        t = K.Tokens(d, o, wide=True)
        out["words"][i:j] = np.diff(t.first)
        letters = np.r_[0, np.cumsum((d & 0xC0) != 0x80)]
        size = letters[t.end] - letters[t.start]
        whole = np.maximum(1, np.bincount(t.doc, size, j - i))
        salt = K.mix(t.doc.astype(np.uint64) + np.uint64(1))
        for n, g, valid in t.grams(max(LENGTHS)):
            if n not in LENGTHS:
                continue
            at = np.flatnonzero(valid)
            hit = at[_repeated(K.mix(g[at] ^ salt[at]))]
            cover = np.zeros(len(g) + 1, np.int32)
            cover[: len(g)] += np.bincount(hit, minlength=len(g))[: len(g)].astype(np.int32)
            ends = hit + n
            cover -= np.bincount(ends, minlength=len(g) + 1).astype(np.int32)
            inside = np.cumsum(cover[:-1]) > 0
            out[f"ngram_{n}"][i:j] = np.bincount(t.doc[inside], size[inside], j - i) / whole
        out["lines"][i:j] = _lines(d, o, letters)
    return out


def _lines(d: np.ndarray, o: np.ndarray, letters: np.ndarray) -> np.ndarray:
    n = len(o) - 1
    if not len(d):
        return np.zeros(n)
    # stripped lines: from the first to the last byte that isn't white space
    solid = np.flatnonzero(K.CLASS[d] != K.SPACE)
    if not len(solid):
        return np.zeros(n)
    newline = np.cumsum(d == 10)
    line = newline[solid]
    doc = np.searchsorted(o, solid, "right") - 1
    begin = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])])
    start = solid[begin]
    end = solid[np.r_[begin[1:], len(solid)] - 1] + 1
    owner = doc[begin]
    h = K.span_hash(d, start, end)
    again = _repeated(K.mix(h ^ K.mix(owner.astype(np.uint64) + np.uint64(1))))
    size = (letters[end] - letters[start]).astype(np.float64)
    return np.bincount(owner[again], size[again], n) / np.maximum(1, np.bincount(owner, size, n))


def rules(docs: DataFrame, bounds: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, words, lines, ngram_2 ... ngram_10, broken, keep) for each row; ``broken`` lists the rules whose bound is passed.

    A null, empty or wordless text has shares of 0 and is kept: it repeats
    nothing. Shares are rounded to six places; a share equal to a bound keeps
    the rule. Repeated rows are judged each; a text of any length is judged
    whole. An empty table gives no row. Other columns are neither read nor
    carried, so their names can't clash.
    """
    bounds = dict(RULES if bounds is None else bounds)
    names = ["words", "lines", *[f"ngram_{n}" for n in LENGTHS]]

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        s = {k: v if k == "words" else np.round(v, 6) for k, v in shares(b.column(1)).items()}
        over = {k: s[k] > v for k, v in bounds.items()}
        bad = np.any(list(over.values()), axis=0) if over else np.zeros(b.num_rows, bool)
        broken = [[k for k in over if over[k][i]] if bad[i] else [] for i in range(b.num_rows)]
        return pa.RecordBatch.from_arrays([b.column(0), *[pa.array(s[k]) for k in names], pa.array(broken, pa.list_(pa.string())), pa.array(~bad)], ["doc_id", *names, "broken", "keep"])

    kinds = [T.StructField(k, T.LongType() if k == "words" else T.DoubleType()) for k in names]
    schema = T.StructType([docs.schema["doc_id"], *kinds, T.StructField("broken", T.ArrayType(T.StringType())), T.StructField("keep", T.BooleanType())])
    return docs.select("doc_id", "text").mapInArrow(batches(f), schema)


def without_repetition(docs: DataFrame, bounds: dict[str, float] | None = None) -> DataFrame:
    """The documents that break no rule; all columns as they are. Cases as for ``rules``."""
    bounds = dict(RULES if bounds is None else bounds)
    at = docs.columns.index("text")

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        s = shares(b.column(at))
        return b.filter(pa.array(~np.any([np.round(s[k], 6) > v for k, v in bounds.items()], axis=0)))

    return docs.mapInArrow(batches(f), docs.schema) if bounds else docs
