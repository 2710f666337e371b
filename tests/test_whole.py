"""Queries over whole tables that have no SQL, against brute force."""

import hashlib
import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import tables as T
from lodestone.functions import text as X
from lodestone.operators import comention, conflict, graph, language, retrieval
from lodestone.plans import catalogue, upkeep  # noqa: F401, the second adds to the first's queries
from lodestone.plans.catalogue import QUERIES


def test_comention_over_the_chunks_of_all_documents(spark, tmp_path):
    long = " ".join(f"word{i % 37} term{i % 11}" for i in range(700))
    texts = ["alpha beta gamma the alpha", "beta gamma delta", "", None, "abc", "alphabet soup", long]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "beta questions."), (1, "alpha soup."), (2, "absent.")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = Counter()
    for t in texts:
        for chunk in X.chunk(t or "", 450, 60):
            terms = sorted({w for w in X.tokenize(chunk) if len(w) >= graph.LETTERS and w not in T.STOPWORDS})
            want.update(combinations(terms, 2))
    edges = graph.edges(catalogue._chunks(spark, str(tmp_path)))
    assert {(r["source"], r["target"]): r["weight"] for r in edges.collect()} == want
    ends = Counter(x for pair in want for x in pair)
    sums = Counter()
    for pair, n in want.items():
        for x in pair:
            sums[x] += n
    assert {r["label"]: (r["n_neighbors"], r["weight"]) for r in QUERIES["comention_strength_chunks"](spark, str(tmp_path)).collect()} == {x: (ends[x], sums[x]) for x in ends}
    assert want["beta", "gamma"] == 2 and want["term0", "word0"] > 1
    needles = spark.createDataFrame([("beta",), ("alpha",), ("absent",), ("phab",), ("term",)], "needle string")
    both = lambda df: sorted(tuple(r) for r in df.collect())
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "unit bigint, text string")
    found = both(graph.neighbors_of(needles, chunks))
    assert found == both(graph.neighbors(needles, graph.edges(chunks))) and {x[0] for x in found} == {"beta", "alpha", "phab", "term"}
    got = QUERIES["graph_neighbors_chunks"](spark, str(tmp_path)).collect()
    assert {(r["needle"], r["label"]) for r in got} == {("beta", "beta"), ("alpha", "alpha")}


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest_vectors_against_all_pairs(spark, monkeypatch, metric):
    monkeypatch.setattr(retrieval, "BLOCK", 60)
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").filter("vec_id < 200").collect()
    rows = [(r[0], list(r[1])) for r in rows] + [(1000 + i, list(rows[3][1])) for i in range(25)]
    x = np.array([r[1] for r in rows], np.float64)
    ids = np.array([r[0] for r in rows])
    if metric == "l2":
        d = ((x[:, None] - x[None]) ** 2).sum(2)
    else:
        d = 1 - x @ x.T / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1))
    d = np.round(d, 6)
    want = {(int(ids[i]), r, int(ids[j])) for i in range(len(ids)) for r, j in enumerate(sorted(range(len(ids)), key=lambda j: (d[i, j], ids[j]))[:10], 1)}
    unfit = [(9001, None), (9002, [0.0] * 64), (9003, [1.0]), (9004, [float("nan")] * 64)]
    df = spark.createDataFrame(rows + unfit, "vec_id bigint, embedding array<double>")
    got = retrieval.vector_top(df.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("q")), df, 10, metric)
    assert {(r["question_id"], r["rank"], r["vec_id"]) for r in got.collect()} == want


def shuffled(spark, f):
    """The result of f, and the rows that were shuffled for it."""
    sc = spark.sparkContext
    none = sc._jvm.java.util.ArrayList()

    def at():
        stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    def settled():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return at()

    before = settled()
    out = f()
    return out, settled() - before


def test_bm25_shuffles_no_more_than_the_documents(spark):
    """Every document has a word of every question."""
    n = 2000
    docs = spark.createDataFrame([(i, f"common word {'rare' + str(i % 50)} " + "filler " * (i % 7)) for i in range(n)], "doc_id bigint, text string").repartition(4).localCheckpoint()
    q = spark.createDataFrame([(i, f"common word rare{i}") for i in range(40)], "question_id bigint, question string")
    got, rows = shuffled(spark, lambda: retrieval.bm25(q, docs, 3).collect())
    assert len(got) == 120
    short = lambda i: sorted((d for d in range(n) if d % 50 == i), key=lambda d: (d % 7, d))[:3]
    assert {(r["question_id"], r["rank"]): r["doc_id"] for r in got} == {(i, p): d for i in range(40) for p, d in enumerate(short(i), 1)}
    assert rows < 2 * n


def test_neighbors_of_reads_the_units_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def f(it):
        for b in it:
            seen.add(b.num_rows)
            yield b

    units = spark.createDataFrame([(i, "alpha beta gamma") for i in range(10)], "unit bigint, text string").mapInArrow(f, "unit bigint, text string")
    got = graph.neighbors_of(spark.createDataFrame([("beta",)], "needle string"), units).collect()
    assert {(r["neighbor"], r["weight"]) for r in got} == {("alpha", 10), ("gamma", 10)} and seen.value == 10


def test_conflicts_of_one_group_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(conflict, "BLOCK", 40)
    prices = [i % 3 for i in range(300)]
    df = spark.createDataFrame([("g", i, f"The list price of large parts is {p} usd") for i, p in enumerate(prices)], "group string, position int, text string")
    sizes = [x for x in conflict.conflicts(df).mapInArrow(lambda it: [pa.RecordBatch.from_pydict({"n": [sum(b.num_rows for b in it)]})], "n bigint").toPandas()["n"] if x]
    assert sum(sizes) == sum(a != b for a, b in combinations(prices, 2)) and max(sizes) < sum(sizes) / 2
    lines = [r["line"] for r in conflict.describe(conflict.conflicts(df)).collect()]
    assert sorted(lines) == sorted(f"value: {i} vs {j}" for i, j in combinations(range(300), 2) if prices[i] != prices[j])


def test_strength_shuffles_no_pairs(spark):
    r = np.random.default_rng(1)
    words = [f"word{i}" for i in range(900)]
    texts = [" ".join({words[int(i)] for i in r.zipf(1.3, 150) if i < 900} | ({f"only{n}", f"lone{n}"} if n % 3 == 0 else set())) for n in range(400)] + ["", "single", None]
    units = spark.createDataFrame(list(enumerate(texts)), "unit bigint, text string").repartition(4).localCheckpoint()
    edge = graph.edges(units).localCheckpoint()
    want = sorted(tuple(x) for x in graph.strength(edge).collect())
    for head in (1, 40, comention.HEAD):
        got = comention.strength(graph.terms_of(units), head).collect()
        assert sorted((x["label"], x["n_neighbors"], x["weight"]) for x in got) == want
    docs = units.select(F.col("unit").alias("doc_id"), "text").repartition(4)
    folder = f"{retrieval.cut(docs).sparkSession.sparkContext.getCheckpointDir()}/strength"
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    got, rows = shuffled(spark, lambda: QUERIES["comention_strength_chunks"](spark, folder).collect())
    assert sorted(tuple(x) for x in got) == want and rows < edge.count() / 2


def test_near_duplicates_shuffle_few_of_the_tokens(spark, monkeypatch):
    monkeypatch.setattr(conflict, "KNOWN", 20)
    r = np.random.default_rng(4)
    base = [" ".join(f"w{int(x)}" for x in r.integers(0, 3000, 200)) for _ in range(150)]
    texts = base + [b + " extra" for b in base[:9]] + base[:2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4).localCheckpoint()
    got, rows = shuffled(spark, lambda: conflict.near_duplicates(docs).collect())
    assert sorted((x["doc_id"], x["duplicate_of"], x["reason"]) for x in got) == sorted([(150 + i, i, "near") for i in range(9)] + [(159 + i, i, "exact") for i in range(2)])
    assert rows < 2 * sum(len(set(t.split())) for t in texts)


def test_embedding_shuffles_one_row_a_text(spark, tmp_path):
    """A text of many tokens, and texts of one id, whose counts add up."""
    texts = [(i, f"{' '.join(f'w{i * k % 211}' for k in range(1, 90))} Ünï 東京都") for i in range(150)]
    rows = [*texts, (7, "more of seven"), (7, None), (900, ""), (901, None), (None, "of no id")]
    docs = spark.createDataFrame(rows, "id bigint, text string").repartition(3).localCheckpoint()
    got, moved = shuffled(spark, lambda: {r["id"]: r["v"] for r in retrieval.embedded(docs).collect()})
    want = {}
    for i, t in rows:
        for w in X.tokenize(t or ""):
            want.setdefault(i, np.zeros(64))[hashlib.sha1(w.encode()).digest()[-1] % 64] += 1
    assert set(got) == set(want) and all(np.array_equal(got[i], n / np.sqrt((n * n).sum())) for i, n in want.items())
    assert moved <= len(rows)
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(texts[:3], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got, moved = shuffled(spark, lambda: QUERIES["corpus_ask"](spark, str(tmp_path)).collect())
    assert {r["question_id"]: r["doc_id"] for r in got if r["rank"] == 1} == {0: 0, 1: 1, 2: 2} and moved < 4 * len(texts)


def test_detection_holds_one_text_at_a_time(spark):
    texts = ["der Hund und das Haus", "", None, "12 !", "привет abc", "東京 ab", "abжп", "le chat\x1fet la"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert {r["i"]: tuple(r["d"]) for r in df.select("i", language.detected("text").alias("d")).collect()} == {i: language.detect(t or "") for i, t in enumerate(texts)}
    batch = pa.array(["und der " * 2000 + str(i) for i in range(400)])
    tracemalloc.start()
    try:
        got = language.detected.func(batch)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.to_pylist() == [{"language": "de", "confidence": 1.0, "reliable": True}] * 400 and peak < batch.nbytes / 2
    assert len(language.detected.func(batch[:0])) == 0


def test_bm25_counts_tokens_in_steps(spark, monkeypatch):
    """A document's rows, one of them in other letters, lie in several steps of a batch."""
    monkeypatch.setattr(retrieval, "STEP", 2)
    rows = [(1, "alpha beta"), (2, ""), (3, None), (1, "alpha привет"), (4, "beta beta gamma"), (5, "東京 alpha"), (1, "gamma")]
    held = retrieval.postings(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), ["alpha", "beta", "привет"])
    got = {r["doc_id"]: sorted(zip(r["places"], r["counts"], strict=True)) for r in held.collect()}
    assert got == {1: [(0, 1), (0, 1), (1, 1), (2, 1)], 2: [], 3: [], 4: [(1, 2)], 5: [(0, 1)]}


@pytest.fixture(scope="module")
def common_words(spark, tmp_path_factory):
    """Tables in which every document has all words of every question; the shortest documents rank first."""
    d = tmp_path_factory.mktemp("common")
    words = [f"common{i}" for i in range(12)]
    docs = [(i, " ".join(words) + " filler" * (i % 199), "en", f"src{i % 3}") for i in range(2000)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").repartition(8).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(2000)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(i, f"{' '.join(words[: i + 3])}. {' '.join(words[i:])}.") for i in range(5)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["bm25_topk", "authority_order", "relevance_gate", "score_spread", "verify_report", "weakest_tier", "evaluate_report", "refusal_reasons"])
def test_ranked_queries_shuffle_no_words(spark, common_words, name):
    """A row a document and a label, and the few candidates, whatever the words that documents and questions share."""
    got, rows = shuffled(spark, lambda: QUERIES[name](spark, common_words).collect())
    best = sorted(range(2000), key=lambda i: (i % 199, i))[:10]
    if name == "bm25_topk":
        assert {(r["question_id"], r["rank"]): r["doc_id"] for r in got} == {(q, p): i for q in range(5) for p, i in enumerate(best, 1)}
    elif name == "authority_order":
        assert {(r["question_id"], r["place"]): r["doc_id"] for r in got} == {(q, p): i for q in range(5) for p, i in enumerate(sorted(best, key=lambda i: -(i % 2)), 1)}
    else:
        assert len(got) == {"relevance_gate": 50, "evaluate_report": 1, "refusal_reasons": 1}.get(name, 5)
    assert rows < 3 * 2000
