"""Quality classifier by importance resampling.

Two generative models of hashed unigrams and bigrams of words and marks, one of
target text (documents labelled as good) and one of the raw corpus, give each
document the log of its importance weight: the sum over its n-grams of the log
ratio of their probabilities. Documents are then sampled without replacement in
proportion to the weights by Gumbel top-k: the k greatest of log weight plus
Gumbel noise.

The target model weighs languages as the raw corpus does, and languages without
a good label are in neither model: the ratios tell good text from raw text, not
one language from another.

k follows from the models: with a share p of good documents among the labelled
ones, p * weight (1 at most) is the probability that a document is good, and k
is the sum of these over the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import kernels as K
from lodestone.llm.common import cut, pack, unpack

BUCKETS = 1 << 15
SMOOTHING = 50.0
SAMPLE = 200_000
"""At most about this many labelled documents form the target model; so many ids are broadcast at most."""
SEED = 17


def _features(d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams of a block, and their documents."""
    t = K.Tokens(d, o, marks=True)
    buckets, docs = [], []
    for n, g, valid in t.grams(2):
        at = np.flatnonzero(valid)
        buckets.append((K.mix(g[at] + np.uint64(n)) >> np.uint64(64 - 15)).astype(np.int64))
        docs.append(t.doc[at])
    return np.concatenate(buckets), np.concatenate(docs)


def _lang() -> Column:
    return F.coalesce("lang", F.lit(""))


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of (lang, text): each task sums its own, so ``BUCKETS`` rows a language leave it at most."""

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in it:
            names, code = np.unique(np.array(b.column(0).to_pylist(), dtype=str), return_inverse=True)
            data, offsets = K.text_buffer(b.column(1))
            for i, j in K.blocks(offsets):
                buckets, docs = _features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.bincount(code[i:j][docs] * BUCKETS + buckets, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for k, name in enumerate(names.tolist()):
                    total[name] = total[name] + n[k] if name in total else n[k]
        for name, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(n[some])], ["lang", "bucket", "n"])

    return texts.select(_lang().alias("lang"), "text").mapInArrow(f, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame) -> np.ndarray:
    rows = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows at most
    out = np.zeros(BUCKETS)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return out


class Model:
    """Log ratios by bucket, and the share of good documents among the labelled.

    Both counts of a bucket get ``SMOOTHING`` more, the raw one brought to the
    target's size and less the n-gram that is judged, so that an n-gram that was
    never seen elsewhere tells nothing.
    """

    def __init__(self, target: np.ndarray, raw: np.ndarray, share: float):
        scale = target.sum() / max(1, raw.sum())
        self.ratio = np.log(target + SMOOTHING) - np.log(np.maximum(raw - 1, 0) * scale + SMOOTHING)
        self.share = share

    def log_weights(self, column: pa.Array) -> np.ndarray:
        """Rounded to six places; 0 for a text without words and marks."""
        data, offsets = K.text_buffer(column)
        out = np.zeros(len(offsets) - 1)
        for i, j in K.blocks(offsets):
            buckets, docs = _features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            out[i:j] = np.bincount(docs, self.ratio[buckets], j - i)
        return np.round(out, 6)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Model | None:
    """The models of good text (``quality`` = 1 of the labels, at most about ``sample`` documents by a hash of their ids) and of all of ``docs``.

    None if no document that has a label of 1 has any text. Where a document has several labels, it is good if one says so.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n, good = known.agg(F.count("*"), F.coalesce(F.sum(F.expr("cast(quality = 1 as bigint)")), F.lit(0))).first()
    if not good:
        return None
    share = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.filter("quality = 1").filter(share < min(1.0, sample / good)).select("doc_id")
    target = cut(bucket_counts(docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id", "left_semi")))
    raw = cut(bucket_counts(docs))
    size = lambda c: {r[0]: r[1] for r in c.groupBy("lang").agg(F.sum("n")).collect()}  # noqa: E731, one row a language
    t, r = size(target), size(raw)
    if not t:
        return None
    total, whole = sum(t.values()), sum(n for k, n in r.items() if k in t)
    weight = F.create_map(*[F.lit(x) for k, n in t.items() for x in (k, r[k] / whole * total / n)])
    weighted = target.select("bucket", (F.col("n") * weight[F.col("lang")]).alias("n"))
    return Model(_dense(weighted), _dense(raw.filter(F.col("lang").isin(list(t)))), good / n)


def _hash() -> Column:
    return F.xxhash64("doc_id").alias("_h")


def _keys(model: Model, hashes: pa.Array, text: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Log weights and the noisy keys; the noise depends on seed, the doc_id's hash and nothing else."""
    w = model.log_weights(text)
    return w, np.round(w - np.log(-np.log(K.stable_uniform(hashes.to_numpy().view(np.uint64), seed))), 6)


def _scored(docs: DataFrame, model: Model, seed: int) -> DataFrame:
    """(doc_id, log_weight, key, good) of all documents, from a checkpoint: what follows reads no text again."""

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            w, key = _keys(model, b.column(1), b.column(2), seed)
            good = np.minimum(1.0, model.share * np.exp(np.minimum(w, 50)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w), pa.array(key), pa.array(good)], ["doc_id", "log_weight", "key", "good"])

    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(k, T.DoubleType()) for k in ("log_weight", "key", "good")]])
    return cut(docs.select("doc_id", _hash(), "text").mapInArrow(f, schema))


def _cutoff(keys: DataFrame, k: int | None) -> float:
    """The k-th greatest key: found among all keys by counts of ever finer spans, so nothing is sorted or gathered."""
    low, high, n, good = keys.agg(F.min("key"), F.max("key"), F.count("*"), F.sum(F.expr("cast(round(good * 1000000) as bigint)"))).first()
    if not n:
        return -np.inf
    k = round(good / 1e6) if k is None else k
    if k >= n:
        return -np.inf
    if k <= 0:
        return np.inf
    above = 0
    while low < high:
        width = (high - low) / 1000
        span = F.least(F.floor((F.col("key") - low) / width), F.lit(999))
        inside = keys.filter(F.col("key").between(low, high)).groupBy(span.alias("s")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("s")).collect()  # 1000 rows at most
        for r in inside:
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
        else:
            return low
    return low


def sample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, key) of the documents that are sampled.

    Ids may be of any type. Rows tied with the k-th key are all sampled, so are
    repeated rows; a null or empty text has weight 1 (log 0), a null doc_id the
    noise of its hash; a text of any length is weighed whole. Without a good
    label in ``docs`` everything is sampled, with nulls; an empty table gives no
    row. Columns other than doc_id, text and lang are not read, so their names
    can't clash.
    """
    model = fit(docs, labels, seed=seed)
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("double").alias("log_weight"), F.lit(None).cast("double").alias("key"))
    scored = _scored(docs, model, seed)
    return scored.filter(F.col("key") >= _cutoff(scored, k)).drop("good")


def resampled(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """The sampled documents, all columns as they are. Cases as for ``sample``."""
    model = fit(docs, labels, seed=seed)
    if model is None:
        return docs
    least = _cutoff(_scored(docs, model, seed), k)
    whole = pack(docs, _h=_hash())

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            row = b.column(0)
            held = pa.array(_keys(model, b.column(1), row.field("text"), seed)[1] >= least)
            yield pa.RecordBatch.from_arrays([row.filter(held)], ["_row"])

    return unpack(whole.mapInArrow(f, T.StructType([whole.schema["_row"]])))
