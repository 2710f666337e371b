"""Each operator's rule worked out a second time, plainly, and compared; cases that the other tests leave out."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import importance, kernels, language, mixing, packing, repetition, simhash, tokencount, vectors, warc

SF = "/root/testdata/sf0.001"


def queue(rows, weights, others, budget):
    """(doc_id, source, text) in the order of the mixture, by a queue a source."""
    key = lambda r: (hashlib.md5(f"{mixing.SEED}:{r[0]}".encode()).hexdigest(), r[0], hashlib.md5((r[2] or "").encode()).hexdigest())
    waiting = {}
    for r in sorted(rows, key=key):
        if weights.get(r[1], others) > 0:
            waiting.setdefault(r[1], []).append(r)
    spent = dict.fromkeys(waiting, 0)
    out, total = [], 0
    while any(waiting.values()):
        size = lambda r: len((r[2] or "").split())
        finish = {s: ((spent[s] + size(w[0])) / weights.get(s, others), s, key(w[0])) for s, w in waiting.items() if w}
        s = min(finish, key=finish.get)
        r = waiting[s].pop(0)
        spent[s] += size(r)
        total += size(r)
        if total > budget:
            break
        out.append(r)
    return out


@pytest.mark.parametrize("weights, others", [({"a": 3.0, "b": 1.0}, 0.0), ({"a": 1.0, "b": 0.0001, "c": 2.0}, 0.5)])
def test_mixture_is_the_queues(spark, weights, others):
    rows = [(i, "abcd"[(i * 7) % 11 % 4], "w " * (1 + i % 5)) for i in range(120)]
    rows += [(7, "a", "w w w")] * 10 + [(8, "a", None), (8, "a", "")] + [(9, "b", "x y"), (9, "b", "y x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    for budget in (9, 60, 10_000):
        want = queue(rows, weights, others, budget)
        got = [(r["doc_id"], r["source"]) for r in mixing.mixture(docs, weights, budget, others=others).collect()]
        assert got == [r[:2] for r in want]
        mixed = [tuple(r) for r in mixing.mixed(docs, weights, budget, others=others).collect()]
        assert [(r[0], r[1], r[2] or "") for r in mixed] == [(r[0], r[1], r[2] or "") for r in want]


def test_mixed_cuts_equal_rows_at_the_budget(spark):
    docs = spark.createDataFrame([(1, "a", "x y z")] * 10, "doc_id bigint, source string, text string")
    assert mixing.mixture(docs, budget=9).count() == mixing.mixed(docs, budget=9).count() == 3


def test_mixture_ranges_hold_alike_under_uneven_weights(spark):
    rows = [(i, "a" if i % 20 else "b", "w") for i in range(4000)]
    light, _ = mixing.finish_times(spark.createDataFrame(rows, "doc_id bigint, source string, text string"), {"a": 1.0, "b": 0.0001}, 0.0, "s")
    from lodestone.llm.common import ranged

    sizes = Counter(r[0] for r in ranged(light, [light["_vft"]], "_p").select("_p").collect())
    assert max(sizes.values()) <= 3 * 4000 / 8


def test_packing_spreads_the_bytes(spark):
    text = " ".join(f"w{i}" for i in range(2048 * 20 + 77))
    docs = spark.createDataFrame([(i, text) for i in range(40)] + [(None, text)] * 20, "doc_id bigint, text string")
    from pyspark.sql import functions as F

    sizes = [r[1] for r in packing.packed(docs).groupBy(F.spark_partition_id()).agg(F.sum(F.length("text"))).collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8


def test_language_forward_pass_and_document_mean():
    r = np.random.default_rng(1)
    net = language.Network(["de", "en", "fr"])
    texts = ["der Baum und das Haus " * 12, "Привет мир", "", None, "x" * 129, "中文"]
    got = language.score(net, pa.array(texts))
    net.bias[:] = r.normal(size=net.bias.shape)
    got = language.score(net, pa.array(texts))
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        if not raw:
            assert np.isnan(got[k]).all()
            continue
        total = np.zeros(3)
        for i in range(0, len(raw), language.WINDOW):
            piece = raw[i : i + language.WINDOW]
            x = piece + bytes(language.WINDOW - len(piece))
            pooled = []
            for w, table in zip(language.WIDTHS, net.tables, strict=True):
                resp = [sum(table[j][x[at + j]].astype(float) for j in range(w)) for at in range(len(x) - w + 1)]
                pooled.append(np.max(resp, axis=0))
            z = np.maximum(np.concatenate(pooled) + net.bias, 0) @ net.out + net.out_bias
            p = np.exp(z - z.max())
            total += p / p.sum() * len(piece)
        assert np.allclose(got[k], total / len(raw), atol=1e-4)


def test_language_tells_scripts_apart(spark):
    rows = [(i, w, ln) for i in range(60) for w, ln in ((f"это русский текст номер {i} о погоде", "ru"), (f"αυτό είναι ελληνικό κείμενο {i} για τον καιρό", "el"), (f"זה טקסט בעברית {i} על מזג האוויר", "he"), (f"这是第{i}个中文文本关于天气", "zh"))]
    docs = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "doc_id bigint, text string, lang string")
    got = language.identify(docs).withColumnRenamed("lang", "told").join(docs, "doc_id").collect()
    assert np.mean([r["told"] == r["lang"] for r in got]) > 0.97


def words_of(text):
    """Runs of letters and digits; each Chinese, Japanese or Thai character alone."""
    return re.findall(r"[一-鿿ぁ-ヿก-๛]|[^\W_一-鿿ぁ-ヿก-๛]+", text.lower())


def test_repetition_counts_characters():
    texts = ["à é à é ñandú über", "一二三四五。" * 50, "一二三四", "héé wörd. héé wörd. x", "ab cd\nàà bb\nab cd", "ไทยไทย", "“a b” – a b…", None, " \n"]
    got = repetition.shares(pa.array(texts))
    for k, t in enumerate(texts):
        w = words_of(t or "")
        assert got["words"][k] == len(w)
        for n in repetition.LENGTHS:
            grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
            many = Counter(grams)
            inside = {j for i, g in enumerate(grams) if many[g] > 1 for j in range(i, i + n)}
            assert got[f"ngram_{n}"][k] == pytest.approx(sum(len(w[j]) for j in inside) / max(1, sum(map(len, w))))
        lines = [x.strip() for x in (t or "").split("\n") if x.strip()]
        assert got["lines"][k] == pytest.approx(sum(len(x) for x in lines if lines.count(x) > 1) / max(1, sum(map(len, lines))))


def naive_simhash(text):
    mix = lambda h: int(kernels.mix(np.array([h & (2**64 - 1)], np.uint64))[0])
    base = 0x9E3779B97F4A7C15 | 1
    words = re.findall(r"[0-9a-z\x80-\xff]+", "".join(chr(b) for b in kernels.fold(np.frombuffer((text or "").encode(), np.uint8))))
    hashes = [mix(sum((ord(c) + 1) * pow(base, i, 2**64) for i, c in enumerate(w))) for w in words]
    features = []
    for i, (w, h) in enumerate(zip(words, hashes, strict=True)):
        if i + 1 < len(words):
            features.append(mix(h * base + hashes[i + 1] + 2))
        features += [h] * (simhash.WEIGHT if len(w) >= simhash.LETTERS else 0)
    if not features:
        return np.frombuffer(hashlib.blake2b((text or "").encode(), digest_size=16).digest(), np.uint64)
    out = []
    for w in range(2):
        h = [mix(f + 0xA24BAED4963EE407 * (w + 1)) for f in features]
        bits = [2 * sum(x >> b & 1 for x in h) > len(h) for b in range(64)]
        out.append(bits)
    return out


def test_simhash_against_a_plain_one():
    texts = ["the quick brown fox jumps over the lazy dog", "a b", "word", "x", "", None, "Über den Fluß und in die Wälder 12 47", " ".join(f"w{i % 50} token{i}" for i in range(700))]
    got = simhash.fingerprints(pa.array(texts))
    for k, t in enumerate(texts):
        want = naive_simhash(t)
        if isinstance(want, np.ndarray):
            assert (got[k] == want).all()
            continue
        for w in range(2):
            # bit 8 k + j of the count is bit 7 - j of the packed byte k of the hash's byte k
            packed = [sum(int(want[w][8 * b + 7 - j]) << (7 - j) for j in range(8)) for b in range(8)]
            assert got[k][w].tobytes() == bytes(packed)


def test_simhash_tells_numbers_and_order_apart(spark):
    s = "profit grew from {} to {} in the year {} for unit {}"
    texts = [s.format(12, 47, 2019, "A"), s.format(13, 99, 2024, "C"), "unit for the year in to from grew profit 12 47 2019 A", s.format(12, 47, 2019, "A")]
    fp = simhash.fingerprints(pa.array(texts))
    assert (fp[0] == fp[3]).all() and not (fp[0] == fp[1]).all() and not (fp[0] == fp[2]).all()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [tuple(r) for r in simhash.duplicates(docs).collect()] == [(3, 0)]


def test_simhash_groups_are_those_of_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    t = docs.select("doc_id", "text").orderBy("doc_id").toArrow().combine_chunks()
    ids, fp = t.column(0).to_pylist(), simhash.fingerprints(t.column(1))
    near = simhash._near(fp, fp)
    root = np.arange(len(ids))
    while True:
        least = np.where(near, root[None, :], len(ids)).min(axis=1)
        if (least == root).all():
            break
        root = least
    want = {ids[i]: ids[root[i]] for i in range(len(ids)) if root[i] != i}
    assert {r["doc_id"]: r["duplicate_of"] for r in simhash.duplicates(docs).collect()} == want and len(want) > 50


def test_vectors_in_hot_groups(spark):
    """A tight group that outweighs all else, a wide one, and a ring around the first one's ball."""
    r = np.random.default_rng(5)
    c = r.normal(size=(40, 16))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    tight = c[0] + 0.02 * r.normal(size=(900, 16))
    wide = c[1] + 0.045 * r.normal(size=(300, 16))
    ring = c[0] + 0.07 * r.normal(size=(200, 16))
    x = np.concatenate([c, tight, wide, ring, 3.0 * tight[:20]])
    df = spark.createDataFrame([(i, [float(v) for v in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.sqrt(np.maximum(0, 2 - 2 * u @ u.T)) <= 0.25
    root = np.arange(len(u))
    while True:
        least = np.where(near, root[None, :], len(u)).min(axis=1)
        if (least == root).all():
            break
        root = least
    for pivots in (1, 30, None):
        got = {r["vec_id"]: r["group_id"] for r in vectors.groups(df, 0.25, pivots).collect()}
        assert got == dict(enumerate(root.tolist()))


def test_clashing_names_and_ids_of_any_type(spark):
    vec = spark.createDataFrame([(1, [1.0, 0.0], 7, "n", True), (2, [1.0, 0.01], 7, "n", True)], "vec_id bigint, embedding array<float>, node int, v string, home boolean")
    assert sorted(tuple(r) for r in vectors.groups(vec).collect()) == [(1, 1, True), (2, 1, False)]
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", 5, "f"), (1, "u", "<p>x</p>", 5, "f"), (2, "a\nb", None, 5, "f")], "page_id bigint, url string, html string, file int, frame string")
    assert warc.frames(pages).count() == 4
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = spark.read.parquet(f"{SF}/labels.parquet")
    named = docs.selectExpr("concat('d', doc_id) AS doc_id", "text", "lang", "1 AS key", "'x' AS good", "2 AS _h")
    got = importance.sample(named, known.selectExpr("concat('d', doc_id) AS doc_id", "quality"))
    assert got.count() > 0 and got.first()["doc_id"].startswith("d")
    assert importance.resampled(named, known.selectExpr("concat('d', doc_id) AS doc_id", "quality")).columns == named.columns


def test_importance_weights_worked_out_plainly(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    known = {}
    for r in labels:
        if r["doc_id"] is not None and r["quality"] is not None:
            known[r["doc_id"]] = max(known.get(r["doc_id"], 0), r["quality"])

    def buckets(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        t = kernels.Tokens(raw, np.array([0, len(raw)]), marks=True)
        hashes = [int(h) for h in t.hash]
        base = 0x9E3779B97F4A7C15 | 1
        grams = [(h + 1) % 2**64 for h in hashes] + [(a * base + b + 2) % 2**64 for a, b in zip(hashes, hashes[1:], strict=False)]
        return [int(x) >> 49 for x in kernels.mix(np.array(grams, np.uint64))]

    held = {r["doc_id"]: (r["lang"], buckets(r["text"])) for r in docs}
    target, raw = {}, {}
    for d, (lang, b) in held.items():
        raw.setdefault(lang, Counter()).update(b)
        if known.get(d) == 1:
            target.setdefault(lang, Counter()).update(b)
    size = lambda c: sum(c.values())
    total, whole = sum(map(size, target.values())), sum(size(raw[x]) for x in target)
    t, r = Counter(), Counter()
    for lang, c in target.items():
        for b, n in c.items():
            t[b] += n * size(raw[lang]) / whole * total / size(c)
        r.update(raw[lang])
    scale = sum(t.values()) / sum(r.values())
    ratio = {b: math.log(t[b] + importance.SMOOTHING) - math.log(max(r[b] - 1, 0) * scale + importance.SMOOTHING) for b in range(importance.BUCKETS)}
    weight = {d: sum(ratio[x] for x in b) for d, (_, b) in held.items()}
    share = sum(known.values()) / len(known)
    k = round(sum(min(1.0, share * math.exp(min(w, 50))) for w in weight.values()))
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = importance.sample(df, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert len(got) == k
    for row in got:
        assert row["log_weight"] == pytest.approx(weight[row["doc_id"]], abs=1e-4)
        assert row["key"] > row["log_weight"] - 5


def test_token_counts_against_another_encoder():
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    r = np.random.default_rng(3)
    letters = list("abcdé")
    vocabulary = [("<unk>", 0.0)] + [(x, -4.0 - 0.37 * i) for i, x in enumerate(["▁", *letters])]
    for i in range(150):
        piece = ("▁" if r.random() < 0.4 else "") + "".join(r.choice(letters, r.integers(1, 5)))
        if piece not in dict(vocabulary):
            vocabulary.append((piece, -5.0 - 0.113 * i - 0.0007 * r.random()))
    other = Tokenizer(Unigram(vocabulary, unk_id=0))
    c = tokencount.Counter(vocabulary[1:], False)
    for _ in range(400):
        text = " ".join("".join(r.choice(letters, r.integers(1, 9))) for _ in range(r.integers(1, 12)))
        assert c.count(text) == len(other.encode("▁" + text.replace(" ", "▁")).ids)


def test_many_equal_rows_are_spread(spark):
    """A third of a table in one row's copies: no range or file holds them all, and none is lost."""
    from lodestone.llm import sharding

    docs = spark.createDataFrame([(None, "a", "x y")] * 3000 + [(i, "b", "x y") for i in range(3000)], "doc_id bigint, source string, text string")
    got = sharding.shards(docs, 10).collect()
    sizes = [sum(r["shard"] == k and r["source"] == s for r in got) for k in range(10) for s in "ab"]
    assert len(got) == 6000 and set(sizes) == {300} and sorted(r["position"] for r in got) == list(range(6000))
    assert mixing.mixture(docs, share=0.5).count() == mixing.mixed(docs, share=0.5).count() == 3000
    pages = spark.createDataFrame([(1, "u", "<p>same</p>" * 20)] * 6000 + [(i, "v", "<p>x</p>") for i in range(100)], "page_id bigint, url string, html string")
    made = warc.frames(pages, 200_000)
    rows = [r["file"] for r in made.filter("record > 0").select("file").collect()]
    assert len(rows) == 6100 and max(Counter(rows).values()) < 4000
