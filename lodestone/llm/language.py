"""Language identification by a byte convolutional network.

The network sees a window of ``WINDOW`` bytes, each as one of 256 classes.
Filters of widths 2, 3 and 4 slide over the window, each filter's response is
max-pooled over it, and a softmax over the pooled responses gives the language.
A document is cut into windows from end to end; its probabilities are the mean
over all its windows.

Because a filter's input is a class and not a vector, its response is a sum of
table entries; entries for two neighbouring bytes are added up beforehand, so
a width costs one or two look-ups a byte. Training is plain gradient descent
(Adam) in numpy on all windows of a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import kernels as K
from lodestone.llm.common import batches

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
SAMPLE = 400
"""Labelled documents a language, at most about this many, that the network is fitted on, each with its whole text."""
LEAST = 0.4
"""Documents whose best language has a lower probability are rejected."""
EPOCHS = 3
_BATCH = 128

CLASSES = 256


class Network:
    def __init__(self, languages: Sequence[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.languages = list(languages)
        self.tables = [r.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def _responses(self, x: np.ndarray, w: int, table: np.ndarray) -> np.ndarray:
        n = x.shape[1] - w + 1
        return sum(table[k][x[:, k : k + n]] for k in range(w))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of windows (n, WINDOW) of bytes."""
        pairs = x[:, :-1].astype(np.int32) * CLASSES + x[:, 1:]
        pooled = np.empty((len(x), len(WIDTHS) * FILTERS), np.float32)
        for q, (w, t) in enumerate(zip(WIDTHS, self.paired(), strict=True)):
            n = x.shape[1] - w + 1
            total = t[0][pairs[:, :n]]
            if w == 3:
                total += t[1][x[:, 2:]]
            elif w == 4:
                total += t[1][pairs[:, 2:]]
            pooled[:, q * FILTERS : (q + 1) * FILTERS] = total.max(axis=1)
        z = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def paired(self) -> list[list[np.ndarray]]:
        if not hasattr(self, "_paired"):
            join = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS)
            self._paired = [[join(t[0], t[1])] + ([t[2]] if w == 3 else [join(t[2], t[3])] if w == 4 else []) for w, t in zip(WIDTHS, self.tables, strict=True)]
        return self._paired

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 11, rate: float = 0.01) -> Network:
        self.__dict__.pop("_paired", None)
        r = np.random.default_rng(seed)
        params = [*self.tables, self.bias, self.out, self.out_bias]
        m = [np.zeros_like(p) for p in params]
        v = [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), _BATCH):
                xb, yb = x[order[at : at + _BATCH]], y[order[at : at + _BATCH]]
                pooled, where = [], []
                for w, t in zip(WIDTHS, self.tables, strict=True):
                    resp = self._responses(xb, w, t)
                    a = resp.argmax(axis=1)
                    where.append(a)
                    pooled.append(np.take_along_axis(resp, a[:, None, :], 1)[:, 0])
                z1 = np.concatenate(pooled, axis=1) + self.bias
                h = np.maximum(z1, 0)
                z = h @ self.out + self.out_bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                p /= len(yb)
                dh = (p @ self.out.T) * (z1 > 0)
                grads = []
                for q, w in enumerate(WIDTHS):
                    g = np.zeros_like(self.tables[q])
                    d = dh[:, q * FILTERS : (q + 1) * FILTERS]
                    for k in range(w):
                        c = np.take_along_axis(xb, where[q] + k, axis=1)
                        np.add.at(g[k], (c, np.broadcast_to(np.arange(FILTERS), c.shape)), d)
                    grads.append(g)
                grads += [dh.sum(0), h.T @ p, p.sum(0)]
                step += 1
                for i, (par, g) in enumerate(zip(params, grads, strict=True)):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    par -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        return self


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of a block of documents, end to end, the last one filled up with zeros: (windows, index of each document's first, bytes of text in each)."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    first = np.r_[0, np.cumsum(count)]
    x = np.zeros(first[-1] * WINDOW, np.uint8)
    shift = np.repeat(first[:-1] * WINDOW - offsets[:-1], size)
    x[np.arange(len(data)) + shift] = data
    weight = np.full(first[-1], WINDOW, np.float64)
    weight[first[1:][count > 0] - 1] = (size - (count - 1) * WINDOW)[count > 0]
    return x.reshape(-1, WINDOW), first, weight


def score(network: Network, column: pa.Array, step: int = 512) -> np.ndarray:
    """Mean probabilities of each document over all its windows, by their bytes; NaN for texts without a byte."""
    data, offsets = K.text_buffer(column)
    out = np.full((len(offsets) - 1, len(network.languages)), np.nan)
    for i, j in K.blocks(offsets):
        x, first, weight = windows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        if not len(x):
            continue
        p = np.concatenate([network.probabilities(x[a : a + step]) for a in range(0, len(x), step)]) * weight[:, None]
        some = np.flatnonzero(np.diff(first) > 0)
        sums = np.add.reduceat(p, first[some], axis=0)
        out[i + some] = sums / np.add.reduceat(weight, first[some])[:, None]
    return out


def train(docs: DataFrame, sample: int = SAMPLE, seed: int = 5) -> Network | None:
    """Fits a network on about ``sample`` documents of each label in ``lang``, chosen by a hash of their ids; None if fewer than two languages are labelled."""
    some = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").select("doc_id", "lang", "text")
    counts = {r[0]: r[1] for r in some.groupBy("lang").count().collect()}  # one row a language
    if len(counts) < 2:
        return None
    share = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    bound = F.lit(0.0)
    for k, n in counts.items():
        bound = F.when(F.col("lang") == k, F.lit(min(1.0, sample / n))).otherwise(bound)
    taken = some.filter(share < bound).select("lang", "text").mapInArrow(batches(_all_windows), "lang string, x binary")
    rows = sorted((r["lang"], bytes(r["x"])) for r in taken.collect())  # SAMPLE documents a language, about
    if not rows:
        return None
    languages = sorted(counts)
    x = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, WINDOW)
    return Network(languages).fit(x, np.repeat([languages.index(r[0]) for r in rows], [len(r[1]) // WINDOW for r in rows]))


def _all_windows(b: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, x): all windows of each text, one after the other."""
    data, offsets = K.text_buffer(b.column(1))
    out = [windows(data[i:j], np.array([0, j - i]))[0].tobytes() for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
    return pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(out, pa.binary())], ["lang", "x"])


def identify(docs: DataFrame, network: Network | None = None, least: float = LEAST) -> DataFrame:
    """(doc_id, lang, confidence, accepted) for each row: the most probable language over the whole text.

    ``network`` is fitted on the labelled rows of ``docs`` if it isn't given. A
    null or empty text has no language (null, null) and is rejected; a tie goes
    to the first language in alphabetical order; where nothing is labelled all
    languages are null and all non-empty texts accepted. Repeated rows are
    judged each, a text of any length by all its windows. An empty table gives
    no row. Columns other than doc_id, text and lang are not read, so their
    names can't clash.
    """
    network = network or train(docs)
    languages = np.array(network.languages if network else [""], dtype=object)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        lang, best, ok = decide(network, languages, b.column(1), least)
        return pa.RecordBatch.from_arrays([b.column(0), lang, best, pa.array(ok)], ["doc_id", "lang", "confidence", "accepted"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    return docs.select("doc_id", "text").mapInArrow(batches(f), schema)


def decide(network: Network | None, languages: np.ndarray, text: pa.Array, least: float) -> tuple[pa.Array, pa.Array, np.ndarray]:
    if network is None:
        full = np.diff(K.text_buffer(text)[1]) > 0
        return pa.nulls(len(text), pa.string()), pa.nulls(len(text), pa.float64()), full
    p = score(network, text)
    none = np.isnan(p[:, 0])
    p = np.nan_to_num(p)
    best = p.argmax(axis=1)
    top = np.round(p[np.arange(len(p)), best], 6)
    lang = languages[best].copy()
    lang[none] = None
    return pa.array(lang, pa.string()), pa.array(top, pa.float64(), mask=none), ~none & (top >= least)


def accepted(docs: DataFrame, network: Network | None = None, least: float = LEAST) -> DataFrame:
    """The documents whose language is told with a probability of at least ``least``; all columns as they are. Cases as for ``identify``."""
    network = network or train(docs)
    languages = np.array(network.languages if network else [""], dtype=object)
    at = docs.columns.index("text")

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(decide(network, languages, b.column(at), least)[2]))

    return docs.mapInArrow(batches(f), docs.schema)
