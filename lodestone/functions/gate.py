"""Whether a passage supports a claim."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lodestone.functions import tables as T
from lodestone.functions.text import content, tokenize

SINGLE_GAP, TOTAL_GAP = 4, 8


def align(claim: list[str], passage: list[str], single: int = SINGLE_GAP, total: int = TOTAL_GAP) -> tuple[int, int, int, int] | None:
    """(start, end, total gap, greatest gap) of the claim's tokens in order within the passage, or None.

    For each claim token in turn, a position of the passage extends the position
    before it whose path has skipped least so far, the earliest of equal ones.
    Among tied paths the earliest may lie too far off, so a match can be
    missed but none is invented: the predicate errs towards refusal.
    """
    if not claim or not passage:
        return None
    paths: dict[int, tuple[int, int, int]] = {j: (0, 0, j) for j, t in enumerate(passage) if t == claim[0]}
    if not paths:
        return None
    for token in claim[1:]:
        ends = sorted(paths)
        # a path grows by a position that is near the end of one, so only these are looked at
        near = sorted({j for e in ends for j in range(e + 1, min(e + single + 2, len(passage))) if passage[j] == token})
        grown: dict[int, tuple[int, int, int]] = {}
        best, k = None, 0
        for j in near:
            while k < len(ends) and ends[k] < j:
                if best is None or paths[ends[k]][0] < paths[best][0]:
                    best = ends[k]
                k += 1
            skipped, widest, start = paths[best]
            gap = j - best - 1
            if gap <= single and skipped + gap <= total:
                grown[j] = (skipped + gap, max(widest, gap), start)
        if not grown:
            return None
        paths = grown
    end = min(paths, key=lambda j: (paths[j][0], j))
    skipped, widest, start = paths[end]
    return start, end, skipped, widest


def align_closest(claim: list[str], passage: list[str], single: int = SINGLE_GAP, total: int = TOTAL_GAP) -> tuple[int, int, int, int] | None:
    """As ``align``, but of all paths that keep the budget the one that skips least, so no match is missed. Not what ``supported`` goes by."""
    if not claim or not passage:
        return None
    paths = {j: (0, 0, j) for j, t in enumerate(passage) if t == claim[0]}
    for token in claim[1:]:
        grown: dict[int, tuple[int, int, int]] = {}
        for e, (skipped, widest, start) in paths.items():
            for j in range(e + 1, min(e + single + 2, len(passage))):
                gap = j - e - 1
                if passage[j] == token and skipped + gap <= total and (skipped + gap, max(widest, gap), -start) < grown.get(j, (total + 1, 0, 0)):
                    grown[j] = (skipped + gap, max(widest, gap), -start)
        paths = {j: (s, w, -b) for j, (s, w, b) in grown.items()}
    if not paths:
        return None
    end = min(paths, key=lambda j: (paths[j][0], j))
    skipped, widest, start = paths[end]
    return start, end, skipped, widest


def supported(claim: str, passage: str) -> bool:
    """Ordered containment within the gap budget, with no marker of negation lost from the matched span."""
    return supported_by(claim, tokenize(passage))


def supported_by(claim: str, p: list[str]) -> bool:
    """The same for the passage's tokens, so that many claims share one pass over it."""
    c = tokenize(claim)
    span = align(c, p)
    if span is None:
        return False
    inside = p[span[0] : span[1] + 1]
    return all(c.count(m) >= inside.count(m) for m in T.POLARITY.intersection(inside))


@F.pandas_udf(BooleanType())
def supported_udf(claim: pd.Series, passage: pd.Series) -> pd.Series:
    return pd.Series([supported(c or "", p or "") for c, p in zip(claim, passage, strict=True)])


def contained(claim_tokens: Column, passage_tokens: Column) -> Column:
    """All content tokens of the claim, and there are some, occur in the passage."""
    c = content(claim_tokens)
    return (F.size(c) > 0) & (F.size(F.array_except(c, passage_tokens)) == 0)


def relevant(question_tokens: Column, passage_tokens: Column) -> Column:
    return F.arrays_overlap(content(question_tokens), content(passage_tokens))


def coverage(claim_content: Column, passage_content: Column) -> Column:
    return F.when(F.size(claim_content) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(claim_content, passage_content)) / F.size(claim_content))
