"""Token counts by a Viterbi search that keeps counts only.

The vocabulary is a unigram model: pieces with log probabilities. Aho-Corasick
enumerates all pieces that end at each position; dynamic programming carries,
for each position, the best score and the number of pieces on the way to it,
without back pointers. As the usual unigram encoders do, a path replaces the
one that holds a position only if its score is strictly greater, and candidates
come in the order of their start, so of tied paths the one whose last piece is
longest stays. A character that no piece covers is an unknown of one character,
ten below the least score; with byte fallback it costs one token a byte.

A piece marks a word's beginning by U+2581 and has it nowhere behind another
character, so no piece spans the place between a character and a space. The
text parts there, parts are independent, and each distinct part is searched once.

The public vocabulary at hand (32,000 pieces with byte fallback) is of a merge
model; its stored scores are merge ranks, not log probabilities. By default the
rank r of a piece becomes -log(r + 1), Zipf's law for the frequency at that
rank, rounded to 1/1024 so that sums are exact in any order. ``scores="stored"``
takes the file's as they are.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.common import batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN = 10.0
_PART = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
CACHED_LETTERS = 64
CACHE = 400_000
"""Distinct parts a worker remembers; beyond that it begins anew, which changes no count."""


def pieces(path: str = VOCABULARY, scores: str = "zipf") -> tuple[list[tuple[str, float]], bool]:
    """(piece, score) of the ordinary pieces of a model file, and whether it falls back to bytes."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    falls_back = any(p.is_byte(i) for i in range(p.get_piece_size()))
    if scores == "stored":
        return [(p.id_to_piece(i), p.get_score(i)) for i in ids], falls_back
    ranked = sorted(ids, key=lambda i: (-p.get_score(i), i))
    return [(p.id_to_piece(i), -round(float(np.log(r + 1)) * 1024) / 1024) for r, i in enumerate(ranked, 1)], falls_back


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN
        self.byte_fallback = byte_fallback
        self.singles = {p for p, _ in vocabulary if len(p) == 1}
        self.lines = byte_fallback and not any("\n" in p for p, _ in vocabulary)
        """Whether a line end is no part of a piece, so that lines are independent too."""
        self.seen: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def part(self, text: str) -> int:
        n = len(text)
        score, count = [-np.inf] * (n + 1), [0] * (n + 1)
        score[0] = 0.0
        if self.singles.issuperset(text):
            # the automaton gives the matches by their end, of one end the longest first
            for end, (length, s) in self.automaton.iter(text):
                v = score[end + 1 - length] + s
                if v > score[end + 1]:
                    score[end + 1], count[end + 1] = v, count[end + 1 - length] + 1
            return count[n]
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
        # an unknown stands where no piece is the character alone; runs of them are one token without byte fallback
        run = [False] * (n + 1)
        for e in range(1, n + 1):
            best, there, unknown = -np.inf, 0, False
            for length, s in ends[e - 1]:
                if score[e - length] + s > best:
                    best, there = score[e - length] + s, count[e - length] + 1
            if text[e - 1] not in self.singles and score[e - 1] + self.unknown > best:
                best, unknown = score[e - 1] + self.unknown, True
                there = count[e - 1] + (len(text[e - 1].encode()) if self.byte_fallback else not run[e - 1])
            score[e], count[e], run[e] = best, there, unknown
        return count[n]

    def _known(self, part: str) -> int:
        if len(part) > CACHED_LETTERS:
            return self.part(part)
        c = self.seen.get(part)
        if c is None:
            c = self.seen[part] = self.part(part)
        return c

    def _parts(self, marked: str) -> int:
        return sum(map(self._known, _PART.findall(marked)))

    def count(self, text: str) -> int:
        """Tokens of a text: a space is put before it, spaces become U+2581."""
        if not text:
            return 0
        if len(self.seen) + len(self.words) > CACHE:
            self.seen.clear()
            self.words.clear()
        if not self.lines:
            return self._parts(SPACE + text.replace(" ", SPACE))
        total, words = 0, self.words
        for k, line in enumerate(text.split("\n")):
            if k:
                total += 1  # the line end itself, a byte
            if not line or line[0] == " " or line[-1] == " " or "  " in line or SPACE in line:
                total += self._parts((SPACE if k == 0 else "") + line.replace(" ", SPACE))
                continue
            own = line.split(" ")
            if k:
                total += self._known(own[0])
                del own[0]
            try:
                total += sum(map(words.__getitem__, own))
            except KeyError:
                for w in own:
                    c = words.get(w)
                    if c is None:
                        c = self.part(SPACE + w)
                        if len(w) <= CACHED_LETTERS:
                            words[w] = c
                    total += c
        return total


@lru_cache(maxsize=4)
def _vocabulary(path: str, scores: str) -> tuple[list[tuple[str, float]], bool]:
    return pieces(path, scores)


_counters: dict[tuple[str, str], Counter] = {}


def counts(docs: DataFrame, vocabulary: str = VOCABULARY, scores: str = "zipf") -> DataFrame:
    """(doc_id, n_tokens) for each row: tokens of the whole text.

    A null or empty text has 0; a text of any length is searched whole. Repeated
    rows are counted each. Ties as said above. An empty table gives no row.
    Other columns are not read, so their names can't clash. ``vocabulary`` is a
    path that the driver reads; its pieces, a bounded list, are sent to the executors.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary, scores))
    name = (vocabulary, scores)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        c = _counters.get(name)
        if c is None:
            c = _counters[name] = Counter(*sent.value)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([c.count(t or "") for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(batches(f), T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType())]))
