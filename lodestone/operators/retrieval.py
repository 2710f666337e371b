"""Ranked retrieval for many questions in one plan.

Retrievers map (questions, k) to ranked candidates: (question_id, doc_id, score,
rank), rank from 1. Ties go to the lesser doc_id. Texts are cut into tokens once
for all questions and all variants of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions import text as X
from lodestone.sources.shared import cut, few

K1, B = 1.5, 0.75
RRF_K = 60
RERANK_HEAD = 50
BLOCK, SLACK = 4096, 2e-6
"""Vectors of a block at most, about; what the rounding of distances to six digits may change their order by, and more."""
STEP = 1024
"""Texts whose tokens a task counts at a time."""


def top(scored: DataFrame, k: int, by: str | Sequence[str] = "question_id", item: str = "doc_id", least: bool = False) -> DataFrame:
    """The k best of each question; the planner cuts each task's rows to k before the shuffle."""
    order = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(F.asc("score") if least else F.desc("score"), item)
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)


def doc_stats(docs: DataFrame, toks: Column) -> DataFrame:
    """One row: documents, and their mean length in tokens."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(toks)).alias("avg_len"))


def question_terms(variants: Sequence[DataFrame]) -> DataFrame:
    """(list, question_id, term): the distinct tokens of the questions of each variant."""
    each = [q.select(F.lit(i).alias("list"), "question_id", F.explode(F.array_distinct(X.tokens_any(F.col("question")))).alias("term")) for i, q in enumerate(variants)]
    return reduce(DataFrame.unionByName, each)


def tokens_of(toks: pa.Array, rest: pa.Array) -> pa.Array:
    """The tokens of all texts, from the columns of ``X.tokens_or_text``."""
    if rest.null_count == len(rest):
        return toks
    return pa.array([t if r is None else X.tokenize(r) for t, r in zip(toks.to_pylist(), rest.to_pylist(), strict=True)], pa.list_(pa.string()))


def postings(docs: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """(doc_id, len, places, counts): of each document its tokens, and which of the wanted terms it holds how often, by their places in ``wanted``.

    A text's tokens are counted in its own row, so none of them is shuffled and no
    task gets all documents with a frequent term. The rows are cut: lengths,
    frequencies and scores all come from them.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    n = max(1, len(wanted))
    values = pa.array(wanted, pa.string())

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for begin in range(0, whole.num_rows, STEP):
                ids, toks, rest = whole.slice(begin, STEP).columns
                toks = tokens_of(toks, rest)
                size = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                at = pc.fill_null(pc.index_in(toks.flatten(), value_set=values), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                key = np.repeat(np.arange(len(size)), size) * n + at
                key, counts = np.unique(key[at >= 0], return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(len(size) + 1) * n), pa.int32())
                lists = (pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (key % n, counts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(size), *lists], ["doc_id", "len", "places", "counts"])

    toks, rest = X.tokens_or_text(F.col("text"))
    each = docs.select("doc_id", toks.alias("t"), rest.alias("rest")).mapInArrow(f, f"doc_id {kind}, len bigint, places array<int>, counts array<int>")
    return cut(each.groupBy("doc_id").agg(F.first("len").alias("len"), F.flatten(F.collect_list("places")).alias("places"), F.flatten(F.collect_list("counts")).alias("counts")))


def _scored(asked: Sequence[tuple[int, object, np.ndarray]], idf: np.ndarray, avg: float, k: int | None, qkind: pa.DataType):
    """Rows (list, question_id, doc_id, score) of ``postings``: of all those of a task the k best of each question, by score and then doc_id."""
    same: dict[tuple[int, ...], list[int]] = {}
    for i, (_, _, places) in enumerate(asked):
        same.setdefault(tuple(places), []).append(i)
    groups = [(np.array(places), who) for places, who in same.items() if places]
    step = max(1, min(4096, (1 << 22) // max(1, len(idf))))
    order = lambda x: (-x[0], x[1] is not None, x[1])

    def rows(found: list[tuple[list[int], list[tuple[float, object]]]], dkind: pa.DataType) -> pa.RecordBatch:
        flat = [(asked[i][0], asked[i][1], doc, score) for who, best in found for i in who for score, doc in best]
        cols = list(zip(*flat, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), qkind, dkind, pa.float64()), strict=True)], ["list", "question_id", "doc_id", "score"])

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, object]]] = [[] for _ in groups]
        dkind = None
        for whole in it:
            for begin in range(0, whole.num_rows, step):
                ids, size, places, counts = whole.slice(begin, step).columns
                dkind = ids.type
                size = size.to_numpy()
                row = np.repeat(np.arange(len(size)), pc.list_value_length(places).to_numpy(zero_copy_only=False))
                at, tf = places.flatten().to_numpy(), counts.flatten().to_numpy()
                weight = np.zeros((len(idf), len(size)))
                # the counts of a doc_id that stands in several rows add up first
                np.add.at(weight, (at, row), tf)
                at, row = np.nonzero(weight)
                tf = weight[at, row]
                weight[at, row] = idf[at] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[row] / avg)))
                every = []
                for g, (terms, who) in enumerate(groups):
                    score = np.floor(weight[terms].sum(axis=0) * 1e6 + 0.5) / 1e6
                    least = best[g][-1][0] if k is not None and len(best[g]) == k else 0.0
                    hit = np.flatnonzero((score > 0) & (score >= least))
                    if k is not None and len(hit) > k:
                        hit = hit[score[hit] >= np.partition(score[hit], len(hit) - k)[len(hit) - k]]
                    if not len(hit):
                        continue
                    more = list(zip(score[hit].tolist(), ids.take(pa.array(hit)).to_pylist(), strict=True))
                    if k is None:
                        every.append((who, more))
                    else:
                        best[g] = sorted(best[g] + more, key=order)[:k]
                if every:
                    yield rows(every, dkind)
        if dkind is not None and any(best):
            yield rows([(who, b) for (_, who), b in zip(groups, best, strict=True)], dkind)

    return f


def bm25_lists(variants: Sequence[DataFrame], docs: DataFrame, k: int | None = None) -> DataFrame:
    """(list, question_id, doc_id, score, rank): the k best documents (all, without k) for the questions of each variant.

    The questions' terms are known to every task; the tasks score their own
    documents and pass on the k best, so what is shuffled doesn't grow with the
    documents that share a word with a question.
    """
    terms = question_terms(variants)
    held_terms: dict[tuple[int, object], set[str]] = {}
    for r in terms.collect():
        held_terms.setdefault((r["list"], r["question_id"]), set()).add(r["term"])
    wanted = sorted(set().union(*held_terms.values()))
    place = {t: i for i, t in enumerate(wanted)}
    asked = [(i, q, np.array(sorted(place[t] for t in ts))) for (i, q), ts in held_terms.items()]
    held = postings(docs, wanted)
    stats = held.agg(F.count("*").alias("n"), F.avg("len").alias("avg")).first()
    df = np.zeros(len(wanted))
    for r in held.select("doc_id", F.explode(F.array_distinct("places")).alias("place")).groupBy("place").agg(F.count("*").alias("df")).collect():
        df[r["place"]] = r["df"]
    idf = np.log(1 + (stats["n"] - df + 0.5) / (df + 0.5))
    qkind, dkind = terms.schema["question_id"].dataType, docs.schema["doc_id"].dataType
    scored = held.mapInArrow(_scored(asked, idf, stats["avg"] or 1.0, k, to_arrow_type(qkind)), f"list int, question_id {qkind.simpleString()}, doc_id {dkind.simpleString()}, score double")
    return scored if k is None else top(scored, k, ["list", "question_id"])


def bm25(questions: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    return bm25_lists([questions], docs, k).drop("list")


def _nearest(t: pa.Table, k: int, metric: str, dim: int) -> pa.Table:
    """The k nearest of the rows that are asked about, for each of those that ask: a matrix product preselects, with ``SLACK`` for its error; distances are then taken directly."""
    asks = t.column("asks").to_numpy()
    ids = t.column("id").to_numpy()
    x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = (x * x).sum(axis=1)
    left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
    out: list[tuple[np.ndarray, ...]] = []
    for i in range(0, len(left) if len(right) else 0, 512):
        at = left[i : i + 512]
        if metric == "l2":
            d = norm[at][:, None] + norm[right] - 2 * (x[at] @ x[right].T)
            slack = SLACK + 1e-12 * (norm[at][:, None] + norm[right].max())
        else:
            d = 1 - (x[at] @ x[right].T) / np.sqrt(norm[at][:, None] * norm[right])
            slack = SLACK
        last = min(k, len(right)) - 1
        p, c = np.nonzero(d <= np.partition(d, last, axis=1)[:, last : last + 1] + slack)
        a, b = at[p], right[c]
        if metric == "l2":
            far = ((x[a] - x[b]) ** 2).sum(axis=1)
        else:
            far = 1 - (x[a] * x[b]).sum(axis=1) / (np.sqrt(norm[a]) * np.sqrt(norm[b]))
        far = np.round(far, 6) + 0.0  # no -0.0
        order = np.lexsort((ids[b], far, p))
        p, a, b, far = p[order], a[order], b[order], far[order]
        begin = np.searchsorted(p, np.arange(len(at)))
        keep = np.arange(len(p)) - begin[p] < k
        out.append((ids[a][keep], ids[b][keep], far[keep]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"question_id": pa.array(cols[0]), "vec_id": pa.array(cols[1]), "distance": pa.array(cols[2])})


def vector_top(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2", dim: int = 64) -> DataFrame:
    """(question_id, vec_id, distance, score, rank): the k nearest of (vec_id, embedding) to each of (question_id, q); score is 1 / (1 + distance).

    Both ids are keys of integers; vectors that ``vector_reason`` calls unfit are
    neither searched nor found. Exact: either side is cut into blocks of about
    ``BLOCK``, each pair of blocks gives the k nearest of its own, and of a
    query's candidates from all blocks the k nearest stay. A vector is sent once
    for each block of queries, a query once for each block of vectors.
    """
    fit = vectors.filter(vector_reason(F.col("embedding"), dim).isNull()).select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    ask = queries.filter(vector_reason(F.col("q"), dim).isNull()).select(F.col("question_id").cast("bigint").alias("id"), F.col("q").cast("array<double>").alias("v"))
    rows, cols = (max(1, -(-df.count() // BLOCK)) for df in (ask, fit))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = ask.select(place(rows).alias("r"), every(cols).alias("c"), F.lit(True).alias("asks"), "id", "v")
    asked = fit.select(every(rows).alias("r"), place(cols).alias("c"), F.lit(False).alias("asks"), "id", "v")
    near = asking.unionByName(asked).groupBy("r", "c").applyInArrow(lambda t: _nearest(t, k, metric, dim), "question_id bigint, vec_id bigint, distance double")
    order = Window.partitionBy("question_id").orderBy("distance", "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)
    return ranked.select("question_id", "vec_id", "distance", score_of(F.col("distance")).alias("score"), "rank")


DIM = 64


@lru_cache(1 << 18)
def _place(token: str) -> int:
    return hashlib.sha1(token.encode("utf-8", "replace")).digest()[-1]


def embedded(rows: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, v) of (id, text): the embedder without a model. A token's place is its SHA-1 modulo ``dim``, a power of two up to 256; counts are scaled to length 1. A text without a token has no vector.

    A text's tokens are counted in its own row; what is shuffled is a row of
    counts a text, for those of an id that stands in several rows add up.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for begin in range(0, whole.num_rows, STEP):
                ids, toks, rest = whole.slice(begin, STEP).columns
                toks = tokens_of(toks, rest)
                size = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False)
                terms = toks.flatten().dictionary_encode()
                at = np.array([_place(t) % dim for t in terms.dictionary.to_pylist()], np.int64)[terms.indices.to_numpy()]
                n = np.bincount(np.repeat(np.arange(len(size)), size) * dim + at, minlength=len(size) * dim)
                some = np.flatnonzero(size)
                n = pa.array(n.reshape(-1, dim)[some].ravel(), pa.int32())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * dim, pa.int32()), n)], ["id", "n"])

    toks, rest = X.tokens_or_text(F.col("text"))
    each = rows.select("id", toks.alias("t"), rest.alias("rest")).mapInArrow(f, f"id {kind}, n array<int>").groupBy("id").agg(F.collect_list("n").alias("each"))
    total = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate("each", F.lit(0.0), lambda s, n: s + n[i]))
    held = each.select("id", total.alias("n")).withColumn("norm", F.sqrt(F.aggregate("n", F.lit(0.0), lambda s, n: s + n * n)))
    return held.select("id", F.transform("n", lambda n: n / F.col("norm")).alias("v"))


def score_of(distance: Column) -> Column:
    return 1 / (1 + distance)


def vector_reason(v: Column, dim: int) -> Column:
    """Why a vector is unfit, or null: checked in the order empty, dimension, not finite, zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        F.when(v.isNull(), "not a vector")
        .when(F.size(v) == 0, "empty")
        .when(F.size(v) != dim, "dimension")
        .when(bad, "not finite")
        .when(F.forall(v, lambda x: x == 0), "zero")
    )


def fuse(lists: DataFrame | Sequence[DataFrame], k: int = RRF_K, item: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion: (question_id, item, score, best_list), the sum of 1 / (k + rank) over the lists.

    The lists come apart, or as one with a column ``list``. ``best_list`` is the
    list that gave the highest raw score, the first of equal ones.
    """
    if isinstance(lists, DataFrame):
        every = lists.select("question_id", item, "rank", "score", "list")
    else:
        every = reduce(DataFrame.unionByName, [d.select("question_id", item, "rank", "score", F.lit(i).alias("list")) for i, d in enumerate(lists)])
    return every.groupBy("question_id", item).agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("fused"),
        F.max_by("list", F.struct("score", -F.col("list"))).alias("best_list"),
    ).select("question_id", item, F.col("fused").alias("score"), "best_list")


def spread(candidates: DataFrame) -> DataFrame:
    """(question_id, spread): between the highest and the lowest score of each question."""
    return candidates.groupBy("question_id").agg(F.round(F.max("score") - F.min("score"), 6).alias("spread"))


def rerank(fused: DataFrame, questions: DataFrame, docs: DataFrame, k: int, head: int = RERANK_HEAD) -> DataFrame:
    """Orders the first ``head`` of each question by the share of its content tokens that the text has; the rest follows as fused."""
    ranked = cut(top(fused, 1 << 30)).withColumnRenamed("score", "fused")
    q = questions.select("question_id", X.content(X.tokens_any(F.col("question"))).alias("qc"))
    first = few(ranked.filter(F.col("rank") <= head)).join(docs.select("doc_id", "text"), "doc_id").join(q, "question_id")
    overlap = F.round(F.size(F.array_intersect("qc", X.tokens_any(F.col("text")))) / F.greatest(F.size("qc"), F.lit(1)), 6)
    first = first.select("question_id", "doc_id", "fused", "rank", overlap.alias("score"))
    rest = ranked.filter(F.col("rank") > head).select("question_id", "doc_id", "fused", "rank", F.lit(-1.0).alias("score"))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "rank")
    out = first.unionByName(rest).withColumn("place", F.row_number().over(order).cast("bigint"))
    return out.filter(F.col("place") <= k).select("question_id", "doc_id", "score", "place")
