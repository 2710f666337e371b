"""The ten operators against brute force, and their cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import importance, language, mixing, packing, repetition, sharding, simhash, tokencount, vectors, warc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, tokens int, fp string, _key int"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
HARD = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 5, "x", 1, "f", 1),
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 5, "x", 1, "f", 1),
    (2, None, None, None, None, None, None, None, None),
    (None, "der schnelle braune fuchs springt nicht über den faulen hund", "de", "b", 1, "x", 1, "f", 1),
    (3, "", "en", "a", 0, "x", 1, "f", 1),
    (4, " \n " * 3000, "en", "a", 0, "x", 1, "f", 1),
    (5, LONG, "en", "b", 9, "x", 1, "f", 1),
    (6, "!!! ???", "de", "b", 9, "x", 1, "f", 1),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (6, 0, 1), (None, 1, 0), (7, None, 0)], "doc_id bigint, quality int, toxic int")


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_empty_tables(spark, labels):
    docs = spark.createDataFrame([], SCHEMA)
    none = labels.filter("false")
    vec = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    for df in (mixing.mixture(docs), mixing.mixed(docs), sharding.shards(docs), packing.packed(docs), language.identify(docs), language.accepted(docs), repetition.rules(docs), vectors.groups(vec), vectors.pairs(vec), warc.frames(pages), simhash.duplicates(docs), simhash.one_of_each(docs), tokencount.counts(docs), importance.sample(docs, none), importance.resampled(docs, labels)):
        assert df.count() == 0


def test_row_keeping_filters_carry_all_columns(hard, labels):
    for df in (language.accepted(hard), importance.resampled(hard, labels), simhash.one_of_each(hard), mixing.mixed(hard, share=1.0), repetition.without_repetition(hard)):
        assert df.columns == hard.columns
        assert set(values(df)) <= set(values(hard))


def test_mixture_against_a_queue(hard, spark):
    rows = [(i, "w " * (1 + i % 7), "ab"[i % 3 == 0]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mixture(docs, {"a": 3.0, "b": 1.0}, budget=200).collect()
    tokens = {s: sum(r["tokens"] for r in got if r["source"] == s) for s in "ab"}
    assert sum(tokens.values()) <= 200 and abs(tokens["a"] / 3 - tokens["b"]) <= 7
    times = [r["virtual_finish"] for r in got]
    assert times == sorted(times) and [r["mixture_tokens"] for r in got] == list(itertools.accumulate(r["tokens"] for r in got))
    assert mixing.mixture(docs, {"a": 1.0}, share=1.0).filter("source = 'b'").count() == 0
    assert mixing.mixture(hard, share=1.0).count() == len(HARD)
    assert sorted(r[0] for r in mixing.mixed(docs, {"a": 3.0, "b": 1.0}, 200).select("doc_id").collect()) == sorted(r["doc_id"] for r in got)


def test_shards_match_the_mixture(hard, spark):
    docs = spark.createDataFrame([(i, "ab"[i < 250]) for i in range(1000)], "doc_id bigint, source string")
    got = sharding.shards(docs, 8).collect()
    sizes = [[sum(r["shard"] == k and r["source"] == s for r in got) for k in range(8)] for s in "ab"]
    assert all(max(x) - min(x) <= 1 for x in sizes) and sorted(r["position"] for r in got) == list(range(1000))
    assert sharding.shards(hard, 3).count() == len(HARD)
    with pytest.raises(ValueError):
        sharding.shards(docs, 0)


def test_packing_round_trip(hard):
    got = packing.packed(hard, 64).collect()
    assert all(r["length"] <= 64 and r["length"] & (r["length"] - 1) == 0 and len(r["text"].split()) == r["length"] for r in got)
    for d, text in ((5, LONG), (6, "!!! ???")):
        assert "".join(r["text"] for r in sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["start"])) == text
    assert {r["doc_id"] for r in got} == {None, 1, 5, 6}
    with pytest.raises(ValueError):
        packing.pieces(hard, 100)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language.train(docs.filter("doc_id < 500"))
    got = language.identify(docs.filter("doc_id >= 500"), net).withColumnRenamed("lang", "told").join(docs, "doc_id").select("lang", "told", "accepted").collect()
    told = [r for r in got if r["accepted"]]
    assert len(told) > 0.97 * len(got) and np.mean([r["lang"] == r["told"] for r in told]) > 0.97


def test_language_cases(hard):
    got = {r["doc_id"]: r for r in language.identify(hard).collect()}
    assert not got[2]["accepted"] and got[2]["lang"] is None and not got[3]["accepted"] and got[1]["lang"] == "en"


def test_network_gradient_learns():
    x = np.repeat(np.array([[1] * 128, [2] * 128], np.uint8), 50, axis=0)
    net = language.Network(["a", "b"]).fit(x, np.repeat([0, 1], 50), epochs=5)
    assert (net.probabilities(x).argmax(1) == np.repeat([0, 1], 50)).all()


def test_repetition_against_brute_force():
    texts = ["a b a b c", "x\ny\nx\n", "one two three four", None, "", LONG[:5000], "la la la la"]
    got = repetition.shares(pa.array(texts))
    for k, t in enumerate(texts):
        w = (t or "").split()
        for n in repetition.LENGTHS:
            grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
            inside = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + n)} if len(w) < 2000 else set()
            assert got[f"ngram_{n}"][k] == pytest.approx(sum(len(w[j]) for j in inside) / max(1, sum(map(len, w))))
        lines = [x.strip() for x in (t or "").split("\n") if x.strip()]
        assert got["lines"][k] == pytest.approx(sum(len(x) for x in lines if lines.count(x) > 1) / max(1, sum(map(len, lines))))


def test_vectors_against_all_pairs(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 8))
    x[100:160] = x[:60] + 0.03 * r.normal(size=(60, 8))
    x[160] = x[0]
    rows = [(i, [float(v) for v in v]) for i, v in enumerate(x)] + [(0, [float(v) for v in x[0]]), (400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [1.0, 2.0]), (None, [1.0] * 8), (404, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.sqrt(((u[:, None] - u[None]) ** 2).sum(2))
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if d[i, j] <= 0.25}
    for pivots in (1, 7, 40):
        assert {(r["a"], r["b"]) for r in vectors.pairs(df, 0.25, pivots).collect()} == want
    root = list(range(300))
    for _ in range(300):
        for i, j in want:
            root[i] = root[j] = min(root[i], root[j])
    got = vectors.groups(df, 0.25, 7).collect()
    assert len(got) == len(rows) and all(g["group_id"] == root[g["vec_id"]] for g in got if g["vec_id"] is not None and g["vec_id"] < 300)
    assert sum(g["kept"] for g in got if g["vec_id"] == 0) == 1


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{'text ' * (i % 50)}{i}</p>") for i in range(400)] + [(1, "http://h/1", "<p>text 1</p>")] * 2 + [(None, None, None), (7, "u", ""), (8, None, "é" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    made = warc.write(pages, str(tmp_path / "w"), 200_000).collect()
    assert len(made) > 1 and sum(r["records"] for r in made) == len(rows)
    assert values(warc.scan(spark, str(tmp_path / "w"))) == sorted(rows, key=repr)
    frame = next(r for r in warc.frames(pages, 200_000).collect() if r["record"] == 2)
    content = (tmp_path / "w" / f"part-{frame['file']:05d}.warc.zst").read_bytes()
    assert content[:4] == (0x184D2A5D).to_bytes(4, "little") and warc.read_at(content, frame["offset"], frame["length"])["page_id"] == frame["page_id"]


def test_simhash_search_is_exact(spark):
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, (40, 2)).astype(np.uint64)
    fps = [base]
    for flips in (3, 8, 11, 14, 18, 22):
        x = base.copy()
        for k in range(len(x)):
            for b in r.choice(128, flips, replace=False):
                x[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        fps.append(x)
    fp = np.concatenate(fps)
    near = simhash._near(fp, fp)
    root = list(range(len(fp)))
    for _ in range(20):
        for i, j in zip(*np.nonzero(near), strict=True):
            root[i] = root[j] = min(root[i], root[j])
    binary = simhash._binary(fp).to_pylist()
    df = spark.createDataFrame([(bytearray(b),) for b in binary], "fp binary")
    seen = {bytes(b): k for k, b in enumerate(binary)}
    parent = list(range(len(fp)))
    edges = [(seen[bytes(e["a"])], seen[bytes(e["b"])]) for e in simhash.near_edges(df).collect()]
    assert all(near[i, j] for i, j in edges)
    for _ in range(20):
        for i, j in edges:
            parent[i] = parent[j] = min(parent[i], parent[j])
    assert parent == root


def test_simhash_finds_all_pairs_within_the_distance(spark):
    r = np.random.default_rng(9)
    base = r.integers(0, 1 << 63, (400, 2)).astype(np.uint64)
    near = base.copy()
    for k in range(len(near)):
        flips = r.choice(64, 18, replace=False) + k % 2 * 64 if k < 200 else r.choice(128, 18, replace=False)
        for b in flips:
            near[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    binary = simhash._binary(np.concatenate([base, near])).to_pylist()
    df = spark.createDataFrame([(bytearray(b),) for b in binary], "fp binary")
    got = {frozenset((bytes(e["a"]), bytes(e["b"]))) for e in simhash.near_edges(df).collect()}
    assert got == {frozenset((binary[k], binary[k + 400])) for k in range(400)}


def test_simhash_cases(hard):
    got = values(simhash.duplicates(hard))
    assert got == [(1, 1), (3, 2)]
    assert simhash.one_of_each(hard).count() == len(HARD) - 2


def test_components(spark):
    from lodestone.llm.common import components

    chain = [(i, i + 1) for i in range(100)] + [(200, 201), (201, 202), (200, 202)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(101), 0), 200: 200, 201: 200, 202: 200}


def test_token_counts_against_viterbi():
    r = np.random.default_rng(6)
    vocabulary = [("▁", -2.0), ("a", -3.0), ("b", -3.0), ("ab", -4.0), ("▁a", -3.5), ("▁ab", -5.0), ("ba", -6.0), ("aa", -6.0)]
    c = tokencount.Counter(vocabulary, True)
    scores = dict(vocabulary)
    low = min(scores.values()) - tokencount.UNKNOWN

    def plain(text):
        t = "▁" + text.replace(" ", "▁")
        best = [(0.0, 0)] + [(-np.inf, 0)] * len(t)
        for e in range(1, len(t) + 1):
            for s in range(e):
                piece = t[s:e]
                if piece in scores and best[s][0] + scores[piece] > best[e][0]:
                    best[e] = (best[s][0] + scores[piece], best[s][1] + 1)
            if t[e - 1] not in scores and best[e - 1][0] + low > best[e][0]:
                best[e] = (best[e - 1][0] + low, best[e - 1][1] + len(t[e - 1].encode()))
        return best[-1][1]

    for _ in range(500):
        text = "".join(r.choice(list("aab b é"), r.integers(1, 20)))
        assert c.count(text) == plain(text)
    assert c.count("") == 0 and c.count("a\n\nb") == plain("a") + 2 + c._known("b")


def test_token_count_cases(hard):
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.counts(hard).collect()}
    assert got[2] == got[3] == 0 and got[5] > 60_000


def test_importance_takes_the_greatest_keys(spark, hard, labels):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = importance.fit(docs, known)
    t = docs.select(importance._hash(), "text").toArrow().combine_chunks()
    _, keys = importance._keys(model, t.column(0).combine_chunks(), t.column(1), importance.SEED)
    got = importance.sample(docs, known, k=50).collect()
    assert sorted(r["key"] for r in got) == sorted(keys)[-50:]
    assert importance.sample(hard, labels.filter("false")).count() == len(HARD)
    assert importance.sample(hard, labels, k=0).count() == 0 and importance.sample(hard, labels, k=100).count() == len(HARD)


def test_importance_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fit = known.filter("doc_id % 2 = 0")
    kept = {r[0] for r in importance.sample(docs, fit).select("doc_id").collect()}
    rest = known.filter("doc_id % 2 = 1").collect()
    share = {q: np.mean([r["doc_id"] in kept for r in rest if r["quality"] == q]) for q in (0, 1)}
    assert share[1] > 0.97 and share[0] < 0.1
