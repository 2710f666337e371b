"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has 128 bits: each is the majority's among the hashes of
the text's pairs of neighbouring words, and of its words of at least ``LETTERS``
bytes, which count ``WEIGHT`` times each. Every word is in a pair, so texts that
differ in a number or in the order of words differ in their hashes; longer words
weigh more, as short ones tell texts less apart. Two texts are near copies if
the fingerprints differ in at most ``FAR`` = 18 bits.

The search is exact: either half has three segments of 18 bits, and the ten bits
that each half has besides are a last segment of 20. If the last ones differ, 17
bits of difference at most are left for the six, so one of them has at most two.
The last segment's table is entered with its value only. In the six's, each
fingerprint is entered in the segment's table under the Hamming ball of radius
one around the segment's value, so two values at a distance of at most two meet
in an entry. Every pair that meets is held to the complete distance. Only a
spanning forest of what an entry links is passed on, so groups of thousands of
copies cost no square; connected components over all entries give the groups.

A table is parted by the first bits of its segment: a fingerprint is sent to its
own part and to those one bit away, and the flips of the remaining bits are
entered where it arrives. The number of those first bits grows with the
logarithm of the fingerprints, so parts stay of a size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import kernels as K
from lodestone.llm.common import batches, components, cut, pack

LETTERS, WEIGHT = 5, 2
FAR = 18
SEGMENTS, SEGMENT_BITS, LAST_BITS = 3, 18, 10
PART = 1 << 15
"""Fingerprints whose segment begins alike, about; a part holds a few times as many."""


def _features(t: K.Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of pairs of words and of longer words, by document, and the index of each document's first."""
    _, (_, pair, valid) = t.grams(2)
    longer = (t.end - t.start) >= LETTERS
    used = np.stack([valid, *[longer] * WEIGHT], 1)
    every = np.stack([K.mix(pair + np.uint64(2)), *[t.hash] * WEIGHT], 1)
    before = np.r_[0, np.cumsum(used.sum(axis=1))]
    return every[used], before[t.first]


def fingerprints(column: pa.Array) -> np.ndarray:
    """(n, 2) of 64 bits. A text without a word, or of one short word alone, gets a hash of its bytes, so it equals only itself; null counts as empty."""
    data, offsets = K.text_buffer(column)
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    for i, j in K.blocks(offsets):
        o = offsets[i : j + 1] - offsets[i]
        d = data[offsets[i] : offsets[j]]
        features, first = _features(K.Tokens(d, o))
        out[i:j] = K.bit_majority(features, first)
        for k in np.flatnonzero(np.diff(first) == 0):
            out[i + k] = np.frombuffer(hashlib.blake2b(d[o[k] : o[k + 1]].tobytes(), digest_size=16).digest(), np.uint64)
    return out


def _binary(fp: np.ndarray) -> pa.Array:
    """Fingerprints as 16 bytes, big endian."""
    raw = np.ascontiguousarray(fp.astype(">u8")).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(fp), [None, pa.py_buffer(np.arange(len(fp) + 1, dtype=np.int32) * 16), pa.py_buffer(raw)])


def _numbers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp)."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), _binary(fingerprints(b.column(1)))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(batches(f), f"doc_id {kind}, fp binary")


def _segment(fp: np.ndarray, k: int) -> np.ndarray:
    """The k-th segment; behind the last of ``SEGMENT_BITS`` comes the one of what is left of both halves."""
    if k < 2 * SEGMENTS:
        half, s = divmod(k, SEGMENTS)
        return (fp[:, half] >> np.uint64(SEGMENT_BITS * s)) & np.uint64((1 << SEGMENT_BITS) - 1)
    last = fp >> np.uint64(SEGMENT_BITS * SEGMENTS)
    return (last[:, 0] << np.uint64(LAST_BITS)) | last[:, 1]


def _entries(prefix: int):
    """(part, hi, lo): each fingerprint in the parts of all tables that its segments' first ``prefix`` bits, or one flip of them, name."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = _numbers(b.column(0))
        flips = np.r_[0, 1 << np.arange(prefix)].astype(np.uint64)
        parts = [(_segment(fp, k) >> np.uint64(SEGMENT_BITS - prefix))[:, None] ^ flips | np.uint64(k << 2 * LAST_BITS) for k in range(2 * SEGMENTS)]
        parts.append((_segment(fp, 2 * SEGMENTS) >> np.uint64(2 * LAST_BITS - prefix))[:, None] | np.uint64(2 * SEGMENTS << 2 * LAST_BITS))
        parts = np.concatenate(parts, axis=1)
        rows = np.repeat(fp.view(np.int64), parts.shape[1], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(parts.ravel().astype(np.int32)), pa.array(rows[:, 0].copy()), pa.array(rows[:, 1].copy())], ["part", "hi", "lo"])

    return f


def _keyed(part: int, fp: np.ndarray, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys within a part, in order, and the fingerprint entered under each."""
    k, own = part >> 2 * LAST_BITS, part & (1 << 2 * LAST_BITS) - 1
    bits = (SEGMENT_BITS if k < 2 * SEGMENTS else 2 * LAST_BITS) - prefix
    value = _segment(fp, k)
    key = (value & np.uint64((1 << bits) - 1)).astype(np.int64)
    at = np.arange(len(fp))
    if k < 2 * SEGMENTS:
        # those that arrived by a flip have spent it
        home = np.flatnonzero(value >> np.uint64(bits) == np.uint64(own))
        key = np.concatenate([key, (key[home, None] ^ (1 << np.arange(bits))).ravel()])
        at = np.concatenate([at, np.repeat(home, bits)])
    order = np.argsort(key.astype(np.uint32), kind="stable")
    return key[order], fp[at[order]]


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x[:, :1] ^ y[None, :, 0]) + np.bitwise_count(x[:, 1:] ^ y[None, :, 1]) <= FAR


def forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links near fingerprints: each of a component's members is visited once, against those not visited yet."""
    edges = []
    free = np.ones(len(fp), bool)
    for begin in range(0, len(fp), 256):
        head = np.arange(begin, min(begin + 256, len(fp)))
        head = head[free[head]]
        rest = np.flatnonzero(free)
        hit = _near(fp[head], fp[rest])
        for h, row in zip(head.tolist(), hit, strict=True):
            if not free[h]:
                continue
            free[h] = False
            found = rest[row]
            found = found[free[found]]
            queue = []
            at = h
            while True:
                if len(found):
                    edges += [(at, int(x)) for x in found]
                    free[found] = False
                    queue += found.tolist()
                if not queue:
                    break
                at = queue.pop()
                left = np.flatnonzero(free)
                found = left[_near(fp[at : at + 1], fp[left])[0]]
    return edges


def _links(keys: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
    """Links between fingerprints that share a key; keys come sorted."""
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[begin, len(keys)])
    found: list[np.ndarray] = []
    # small runs: all pairs of runs of one size at once
    for n in np.unique(size[(size > 1) & (size <= 96)]):
        at = begin[size == n]
        i, j = np.triu_indices(n, 1)
        most = max(1, 2_000_000 // len(i))
        for c in range(0, len(at), most):
            x, y = (at[c : c + most, None] + i).ravel(), (at[c : c + most, None] + j).ravel()
            d = np.bitwise_count(fp[x, 0] ^ fp[y, 0])
            s = np.flatnonzero(d <= FAR)
            x, y, d = x[s], y[s], d[s]
            s = d + np.bitwise_count(fp[x, 1] ^ fp[y, 1]) <= FAR
            found.append(np.stack([x[s], y[s]], 1))
    for at, n in zip(begin[size > 96], size[size > 96], strict=True):
        if e := forest(fp[at : at + n]):
            found.append(np.array(e) + at)
    if not found:
        return None
    pairs = np.concatenate(found)
    if not len(pairs):
        return None
    both = np.unique(np.concatenate([fp[pairs[:, 0]], fp[pairs[:, 1]]], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([_binary(both[:, :2]), _binary(both[:, 2:])], ["a", "b"])


def _search(prefix: int):
    """Rows come sorted by part; a part may cross batches."""

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = None
        for b in it:
            part = b.column(0).to_numpy()
            fp = np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()], 1).view(np.uint64)
            begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
            for i, j in zip(begin, [*begin[1:], len(part)], strict=True):
                if part[i] != now:
                    if held and (out := _links(*_keyed(now, np.concatenate(held), prefix))) is not None:
                        yield out
                    now, held = int(part[i]), []
                held.append(fp[i:j])
        if held and (out := _links(*_keyed(now, np.concatenate(held), prefix))) is not None:
            yield out

    return f


def near_edges(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints whose components are those of all near pairs."""
    prefix = min(16, max(4, (fps.count() // PART).bit_length()))
    entries = fps.select("fp").mapInArrow(batches(_entries(prefix)), "part int, hi bigint, lo bigint")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return entries.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_search(prefix), "a binary, b binary").distinct()


def _groups(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fp, n, least doc_id) of the distinct fingerprints, and (node, root) of those that have a near one."""
    distinct = cut(marked.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")))
    return distinct, components(near_edges(distinct))


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, duplicate_of) for each document that goes: the least doc_id of its group stays.

    Documents with equal fingerprints are copies, so repeated rows are: for n
    rows of one doc_id, n - 1 come back with duplicate_of = doc_id. A null text
    counts as empty; texts without a word, or of one short word, are copies only
    of the same bytes; a null doc_id never stays if its group has another; a
    text of any length is read whole. An empty table gives none. Columns other
    than doc_id and text are not read, so their names can't clash.
    """
    marked = cut(with_fingerprint(docs))
    distinct, roots = _groups(marked)
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    best = named.groupBy("root").agg(F.min("least").alias("duplicate_of"), F.sum("n").alias("size")).filter("size > 1")
    groups = named.join(best, "root").select("fp", "duplicate_of")
    rows = marked.join(groups, "fp").repartition("fp", "doc_id").withColumn("_nth", F.row_number().over(Window.partitionBy("fp", "doc_id").orderBy("doc_id")))
    # equal doc_ids with different texts may share a group: the row that stays has the least fingerprint
    first = rows.filter(F.col("doc_id").eqNullSafe(F.col("duplicate_of"))).groupBy("duplicate_of").agg(F.min("fp").alias("_fp"))
    rows = rows.join(first.withColumnRenamed("duplicate_of", "_of"), F.col("duplicate_of").eqNullSafe(F.col("_of")), "left")
    stays = F.col("doc_id").eqNullSafe(F.col("duplicate_of")) & (F.col("_nth") == 1) & F.col("fp").eqNullSafe(F.col("_fp"))
    return rows.filter(~stays).select("doc_id", "duplicate_of")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each group the row with the least doc_id stays (of repeated rows, one). All columns are kept as they are.

    Nulls, empty, wordless and long texts as for ``duplicates``; an empty table
    stays empty; columns are carried as one struct, so no name can clash.
    """
    marked = cut(with_fingerprint(docs))
    distinct, roots = _groups(marked)
    named = distinct.join(roots, distinct["fp"] == roots["node"])
    order = Window.partitionBy("root").orderBy(F.col("least").asc_nulls_last(), "fp")
    losers = cut(named.withColumn("_r", F.row_number().over(order)).filter("_r > 1").select(F.col("fp").alias("_fp")))

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        row = b.column(0)
        text = row.field("text")
        return pa.RecordBatch.from_arrays([row, _binary(fingerprints(text))], ["_row", "_fp"])

    whole = pack(docs)
    marked_rows = whole.mapInArrow(batches(f), T.StructType([*whole.schema.fields, T.StructField("_fp", T.BinaryType())]))
    # first, as each task then passes on one row a fingerprint only, however many copies it has
    nth = F.row_number().over(Window.partitionBy("_fp").orderBy(F.col("_row.doc_id").asc_nulls_last()))
    single = marked_rows.withColumn("_nth", nth).filter("_nth = 1")
    return single.join(losers, "_fp", "left_anti").select("_row.*")

