"""Numpy kernels over Arrow text columns, shared by the operators of this subpackage.

A text column is handled as its one UTF-8 buffer plus offsets. Words are cut
and hashed for a whole block of documents at once, so no Python code runs per
word. Blocks hold about ``BLOCK_BYTES`` of text (or one longer document), which
bounds a worker's memory whatever the size of the Arrow batch.

Conventions, the same for all operators: a null text counts as an empty one;
letters are folded to lower case for ASCII and the Latin-1 supplement; a word
is a run of ASCII letters, digits and bytes above 127; a mark is a run of the
other bytes that aren't white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE, WORD, MARK = 0, 1, 2
CLASS = np.full(256, MARK, np.uint8)
CLASS[list(b" \t\n\r\x0b\x0c\0")] = SPACE
CLASS[[b for b in range(256) if chr(b).isalnum() and b < 128 or b >= 128]] = WORD
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            globals()[name] = np.multiply.accumulate(a)


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: spreads a hash over all its 64 bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1 of them) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of at most ``most`` bytes, or of one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the two-byte letters of Latin-1."""
    out = _FOLD[data]
    if len(data) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][upper] += 0x20
    return out


_SPACELESS = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3041, 0x30FA), (0x30FC, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x323AF))
_SIGNS = ((0xA0, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x60C, 0x60C), (0x61B, 0x61F), (0x6D4, 0x6D4), (0x964, 0x965), (0xE2F, 0xE2F), (0x2000, 0x206F), (0x20A0, 0x20CF), (0x2190, 0x2BFF), (0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0x303D, 0x303F), (0x30FB, 0x30FB), (0xFE30, 0xFE4F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where characters of more than one byte begin, how many bytes each has, and their code points."""
    at = np.flatnonzero(data >= 0xC2)
    size = np.where(data[at] >= 0xF0, 4, np.where(data[at] >= 0xE0, 3, 2))
    whole = at + size <= len(data)
    at, size = at[whole], size[whole]
    code = np.where(size == 4, data[at] & 7, np.where(size == 3, data[at] & 15, data[at] & 31)).astype(np.int64)
    for k in range(1, 4):
        more = size > k
        code[more] = code[more] << 6 | (data[at[more] + k] & 63)
    return at, size, code


def _among(code: np.ndarray, ranges: tuple[tuple[int, int], ...]) -> np.ndarray:
    k = np.searchsorted([a for a, _ in ranges], code, "right") - 1
    return (k >= 0) & (code <= np.array([b for _, b in ranges])[k])


class Tokens:
    """Words (and marks, if wanted) of a block: ``start``, ``end``, ``hash``, ``first`` (index of each document's first token, n + 1).

    With ``wide`` signs beyond ASCII are marks too, and every character of a
    script without spaces is a word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, marks: bool = False, wide: bool = False):
        kind = CLASS[data]
        cuts = [offsets]
        if wide:
            at, size, code = characters(data)
            sign, alone = _among(code, _SIGNS), _among(code, _SPACELESS)
            for k in range(4):
                kind[at[sign & (size > k)] + k] = MARK
            cuts += [at[alone], (at + size)[alone]]
        if not marks:
            kind[kind == MARK] = SPACE
        n = len(data)
        change = np.ones(n + 1, bool)
        change[1:n] = kind[1:] != kind[:-1]
        change[np.concatenate(cuts)] = True
        cuts = np.flatnonzero(change)
        inside = kind[cuts[:-1]] != SPACE if n else np.zeros(0, bool)
        self.start, self.end = cuts[:-1][inside], cuts[1:][inside]
        self.first = np.searchsorted(self.start, offsets)
        _grow(n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((fold(data).astype(np.uint64) + _U(1)) * _powers[:n], out=prefix[1:])
        self.hash = mix((prefix[self.end] - prefix[self.start]) * _inverses[self.start])
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def grams(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, hashes, valid) for n from 1 to ``most``: the gram that begins at each token, and whether it ends within the document."""
        left = self.first[1:][self.doc] - np.arange(len(self.doc))
        g = self.hash.copy()
        yield 1, g, left >= 1
        for n in range(2, most + 1):
            g = g * _U(_BASE)
            if len(g) >= n:
                g[: len(g) - n + 1] += self.hash[n - 1 :]
            yield n, g, left >= n


def stable_uniform(key: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in (0, 1) that depend only on the 64-bit key and the seed."""
    h = mix(key.astype(np.uint64) * _U(0xD6E8FEB86659FD93) + mix(np.array([seed], np.uint64))[0])
    return ((h >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)


_LANES = np.array([sum(((b >> (7 - k)) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def bit_majority(hashes: np.ndarray, first: np.ndarray, words: int = 2) -> np.ndarray:
    """SimHash of each run ``hashes[first[i]:first[i + 1]]``: (n, words) of 64 bits each, a bit set where more than half of the run has it.

    Bits are counted in eight byte lanes of a 64-bit word, at most 255 hashes at a time.
    """
    n = len(first) - 1
    out = np.zeros((n, words), np.uint64)
    count = np.diff(first)
    full = np.flatnonzero(count > 0)
    if not len(full):
        return out
    # pieces of at most 255 hashes
    pieces = -(-count[full] // 255)
    owner = np.repeat(np.arange(len(full)), pieces)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[:-1][full][owner] + 255 * step
    base = first[full[0]]
    hashes = hashes[base : first[-1]]
    begin = begin - base
    group = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    for w in range(words):
        h = mix(hashes + _U((0xA24BAED4963EE407 * (w + 1)) & 0xFFFFFFFFFFFFFFFF))
        octets = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8).T)
        bits = np.zeros((len(full), 64), bool)
        for k in range(8):
            lanes = np.add.reduceat(_LANES[octets[k]], begin)
            each = lanes.view(np.uint8).reshape(-1, 8).astype(np.int64)
            bits[:, 8 * k : 8 * k + 8] = 2 * np.add.reduceat(each, group, axis=0) > count[full][:, None]
        out[full, w] = np.packbits(bits, axis=1).view(np.uint64)[:, 0]
    return out


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes; letters are not folded."""
    n = len(data)
    _grow(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * _powers[:n], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * _inverses[start])
