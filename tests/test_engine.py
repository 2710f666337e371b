"""The facade, the store and what is plugged into them."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.engine import config as C
from lodestone.engine import models
from lodestone.engine.facade import Engine
from lodestone.engine.plugins import Embedder, Extractor, Hooks, Registry, Reranker, Retriever
from lodestone.sources import store as st

DOCS = [
    ("harbor", b"# Port\n\nThe harbor opened in 1962. Ships unload grain there.", "md"),
    ("museum", b"The museum holds two hundred paintings. Entry is free on Sundays.", "txt"),
    ("tariff", b"good,duty\nwheat,12 percent\nwool,7 percent\n", "csv"),
    ("broken", b"no archive", "docx"),
]


def frame(spark, rows):
    return spark.createDataFrame([(d, bytearray(c), t) for d, c, t in rows], "document_id string, content binary, source_type string")


def asked(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "question_id int, question string")


def test_ingest_find_answer_and_forget(spark, tmp_path):
    seen = []
    e = Engine(spark, str(tmp_path / "s"), hooks=Hooks(ingest=lambda df: seen.append(df.count()), answer=lambda df: 1 / 0))
    first = {r["document_id"]: r for r in e.ingest(frame(spark, DOCS)).collect()}
    assert {k: (r["status"], r["n_units"]) for k, r in first.items()} == {"harbor": ("ingested", 2), "museum": ("ingested", 1), "tariff": ("ingested", 2), "broken": ("failed", 0)}
    assert first["broken"]["error"] and seen == [4]
    assert {r["status"] for r in e.ingest(frame(spark, DOCS[:3])).collect()} == {"unchanged"}

    q = asked(spark, "when did the harbor open", "duty on wheat", "price of tulips")
    found = {(r["question_id"], r["doc_id"]) for r in e.retrieve(q, 3).collect()}
    assert (0, "harbor::1::0") in found and (1, "tariff::0::0") in found
    got = {r["question_id"]: r for r in e.ask(q).collect()}
    assert got[0]["decision"] == "answered" and got[0]["doc_id"].startswith("harbor") and "1962" in got[0]["answer"]
    assert got[1]["answer"] == "good: wheat, duty: 12 percent" and got[2]["decision"] == "refused"
    assert [r["chunk"] for r in e.stream(e.ask(q).filter("question_id = 0")).orderBy("chunk_no").collect()][-1].endswith(".")
    deep = {r["question_id"]: r for r in e.ask(q, strategy="deep").collect()}
    assert deep[1]["decision"] in ("answered", "partial") and deep[2]["decision"] != "answered" or deep[2]["n_kept"] >= 0

    # a former text goes with its document's new one; both units are replaced
    e.ingest(frame(spark, [("museum", b"The museum is closed.", "txt")]))
    assert [r["passage"] for r in e.store.read("units").filter("document_id = 'museum'").collect()] == ["The museum is closed."]
    m = e.store.read("manifest").filter("document_id = 'museum'").first()
    assert len(m["retired"]) == 1 and m["retired"][0] != m["checksum"]
    assert {(r["source"], r["target"]) for r in e.edges().collect()} >= {("grain", "harbor")} or e.edges().count() > 0

    tools = {t["name"]: t["handler"] for t in e.tools()}
    assert tools["search_evidence"]("harbor grain", 2)[0]["document_id"] == "harbor"
    assert tools["get_evidence"]("museum::0::0")["passage"] == "The museum is closed." and tools["get_evidence"]("x") is None
    assert tools["wiki_page"]("harbor")["n_units"] == 2 and len(tools["wiki_index"]()) == 3
    assert {r["neighbor"] for r in tools["graph_neighbors"]("ship")} >= {"unload"}

    declared = spark.createDataFrame([("harbor", "other", True), ("lost", "x", True)], "doc_id string, checksum string, current boolean")
    report = e.reconcile(declared)
    assert {r["doc_id"]: r["status"] for r in report.collect()} == {"harbor": "content_mismatch", "lost": "missing", "museum": "orphan", "tariff": "orphan"}
    assert {r["document_id"]: r["status"] for r in e.remediate(report).collect()} == {"museum": "deleted", "tariff": "deleted"}
    assert {r["event"] for r in spark.read.json(str(tmp_path / "s/audit")).collect()} == {"reconcile", "remediate"}
    again = spark.createDataFrame([("museum",)], "document_id string")
    assert e.revoke(again).first()["status"] == "absent"
    for name in ("units", "blobs", "pages", "vectors", "manifest"):
        assert {r["document_id"] for r in e.store.read(name).collect()} == {"harbor"}, name
    assert not any("wheat" in json.dumps(r.asDict(), default=str) for r in spark.read.parquet(*{f"{tmp_path}/s/{k.rsplit('/_bucket', 1)[0]}" for k in e.store.objects.list("units")}).collect())
    assert not e.is_stale()


def test_evaluate_and_memory(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    e.ingest(frame(spark, DOCS[:3]))
    golden = tmp_path / "g.csv"
    golden.write_text('query,expected\n"when did the harbor open","opened in 1962"\n"price of tulips",""\n')
    r = e.evaluate(str(golden)).first()
    assert (r["total"], r["answered"], r["refused"], r["cited"], r["expected"]) == (2, 1, 1, 1, 1) and r["grounded_rate"] == 1.0
    (tmp_path / "b.csv").write_text("a\n1\n")
    with pytest.raises(ValueError):
        e.evaluate(str(tmp_path / "b.csv"))
    conv = spark.createDataFrame([(0, "c")], "question_id int, conv_id string")
    e.ask(asked(spark, "when did the harbor open"), conversations=conv)
    assert e.turns.count() == 1
    follow = e.retrieve(asked(spark, "and what is unloaded"), 2, conversations=conv).orderBy("rank").first()
    assert follow["doc_id"].startswith("harbor")
    said = e.recall(spark.createDataFrame([("c", "harbor")], "conv_id string, query string")).first()
    assert said["question"] == "when did the harbor open"


def test_plugins(spark, tmp_path):
    class Upper(Extractor):
        version, source_type = "1", "upper"

        def parse(self, content):
            return [{"kind": "paragraph", "text": content.decode().upper()}]

    class Fixed(Retriever):
        version = "1"

        def retrieve(self, questions, k):
            return questions.select("question_id", F.lit("a::0::0").alias("doc_id"), F.lit(9.0).alias("score"), F.lit(1).cast("bigint").alias("rank"))

    class Last(Reranker):
        version = "1"

        def order(self, query, texts):
            return list(range(len(texts)))[::-1]

    class Bare(Retriever):
        version = "1"

        def retrieve(self, questions, k):
            return questions

    class Both(Upper, Last):
        pass

    class Nameless(Reranker):
        pass

    r = Registry()
    for p in (Upper(), Fixed(), Last()):
        r.use(p)
    for bad, error in ((Both(), TypeError), (Nameless(), ValueError), (object(), TypeError)):
        with pytest.raises(error):
            r.use(bad)
    e = Engine(spark, str(tmp_path / "s"), C.load({"signals": ["text"]}, env={}), registry=r)
    e.ingest(frame(spark, [("a", b"red apple", "upper"), ("b", b"red pear", "upper")]))
    got = [x["doc_id"] for x in e.retrieve(asked(spark, "red pear")).orderBy("rank").collect()]
    assert sorted(got) == ["a::0::0", "b::0::0"]
    bare = Registry()
    bare.use(Bare())
    with pytest.raises(ValueError):
        bare.lists(asked(spark, "x"), 3)


def test_embedder_plugin(spark):
    class Letters(Embedder):
        version, dim = "1", 3

        def embed(self, texts):
            return [[1.0 + t.count("a"), float(t.count("b")), 0.0] for t in texts]

    rows = spark.createDataFrame([(1, "ab"), (2, None)], "id int, text string")
    got = {r["id"]: r["v"] for r in models.embed(rows, Letters().embed, 3, 1).collect()}
    assert got == {1: [2.0, 1.0, 0.0], 2: [1.0, 0.0, 0.0]}


@pytest.mark.parametrize("v, why", [("x", "not a vector"), ([True], "not a vector"), ([], "empty"), ([1.0], "dimension"), ([1.0, float("nan")], "not finite"), ([0.0, 0], "zero")])
def test_check_vector(v, why):
    with pytest.raises(ValueError, match=why):
        models.check_vector("v", v, 2)
    with pytest.raises(ValueError, match="2 vectors for 1"):
        models.check_batch(["v"], [[1.0, 1.0]] * 2, 2)
    assert models.check_batch(["v"], [[1, 2.0]], 2) == [[1.0, 2.0]]


def test_wires(monkeypatch):
    sent = []

    def carry(reply):
        def t(url, body, headers):
            sent.append((url, json.loads(body), headers))
            return json.dumps(reply).encode()

        return t

    chat = models.ChatModel("http://m/v1/", "x", {"Authorization": "Bearer ${KEY}"}, transport=carry({"choices": [{"message": {"content": 'so: {"short_caption": "c"}'}}]}))
    assert chat.answer("q", "p", "fr").startswith("so") and chat.describe("", "data:") == {"short_caption": "c"}
    assert sent[0][0] == "http://m/v1/chat/completions" and sent[0][1]["temperature"] == 0.0 and "fr" in sent[0][1]["messages"][1]["content"] and sent[0][2]["Authorization"] == "Bearer ${KEY}"
    said = models.MessagesModel("http://a", "y", transport=carry({"content": [{"type": "text", "text": "t"}, {"type": "other"}]}))
    assert said.complete("p") == "t" and sent[-1][0].endswith("/v1/messages") and sent[-1][1]["max_tokens"] == 1024
    emb = models.EmbeddingModel("http://e", "z", transport=carry({"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}))
    assert emb.embed(["a", "b"]) == [[1.0], [2.0]] and emb.embed([]) == []
    with pytest.raises(ValueError):
        emb.embed(["a"])
    rr = models.RerankModel("http://r", "w", transport=carry({"results": [{"index": 2, "relevance_score": 0.9}, {"index": 7, "relevance_score": 0.8}]}))
    assert rr.order("q", ["a", "b", "c"]) == [2, 0, 1]

    calls = []
    ref = models.Reformulator(lambda p: calls.append(p) or ("neu" if " de," in p else 1 / 0))
    assert ref.queries("alt", ["de", "fr", "de"]) == ["neu"] and ref("alt", "fr") is None and len(calls) == 2
    assert models.contextual("c", "d", lambda p: "ctx") == "ctx\n\nc" and models.contextual("c", "d", lambda p: 1 / 0) == "c"

    monkeypatch.setenv("KEY", "s3cret")
    out = models.fulfil("http://m", {"q": 1}, {"Authorization": "Bearer ${KEY}"}, carry({"echo": ["Bearer s3cret"], "api_key": "z"}))
    assert out == {"echo": ["Bearer [redacted]"], "api_key": "[redacted]"} and sent[-1][2]["Authorization"] == "Bearer s3cret"
    with pytest.raises(ValueError):
        models.fulfil("http://m", {"q": "s3cret"}, {"Authorization": "${KEY}"}, carry({}))
    signed = models.fulfil("http://m", {}, {}, carry({"x": "tok"}), sign=lambda u, b, h: (u + "?s", h, ["tok"]))
    assert signed == {"x": "[redacted]"} and sent[-1][0] == "http://m?s"


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"retrieval": {"k": 7}, "signals": ["text", "graph"]}')
    got = C.load(tmp_path / "c.json", {"chunk": {"overlap": 5}}, {"LODESTONE_RETRIEVAL__K": "9", "OTHER": "1", "LODESTONE_ANSWER__LANGUAGE": "de"})
    assert got["retrieval"] == {"k": 9, "rerank_head": 50} and got["chunk"] == {"max_words": 450, "overlap": 5} and got["answer"]["language"] == "de" and got["signals"] == ["graph", "text"]
    assert C.signals(None) == frozenset(C.SIGNALS)
    with pytest.raises(ValueError):
        C.signals(["text", "smell"])
    with pytest.warns(UserWarning, match="allowed_signals"):
        C.check(got, {"allowed_signals": ["text"]})
    assert C.check(got, str(tmp_path / "none.json")) is got
    assert C.expand("a ${X} ${Y}", {"X": "1"}) == "a 1 "


def test_object_store(spark, tmp_path):
    o = st.ObjectStore(spark, str(tmp_path / "o"))
    o.put("a/b", b"\x00\xff")
    o.put("a/b", b"2")
    o.put_json("a/c.json", {"b": 1, "a": 2})
    key = o.put_blob("raw", b"x")
    assert o.put_blob("raw", b"x") == key and o.get("a/b") == b"2" and o.get("a/c.json") == b'{"a": 2, "b": 1}'
    assert o.list() == sorted(["a/b", "a/c.json", key]) and o.list("none") == [] and o.exists("a/b") and not o.exists("a/d")
    o.delete("a")
    o.delete("a")
    assert o.list() == [key]
    assert st.s3_options("http://e")["fs.s3a.endpoint"] == "http://e"


def test_a_change_that_is_cut_short_has_not_happened(spark, tmp_path, monkeypatch):
    s = st.Store(spark, str(tmp_path / "t"), {"x": "document_id string, n int", "y": "document_id string"}, buckets=4)
    rows = lambda *r: spark.createDataFrame(list(r), "document_id string, n int")
    s.commit({"x": rows(("a", 1), ("b", 2))})

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(s.objects, "put_json", fail)
        with pytest.raises(OSError):
            s.commit({"x": rows(("a", 9))})
    assert sorted(tuple(r) for r in s.read("x").collect()) == [("a", 1), ("b", 2)]
    s.commit({"x": rows(("a", 3), ("a", 4))}, notes={"k": 1})
    s.commit({}, gone=spark.createDataFrame([("b",)], "document_id string"))
    assert sorted(tuple(r) for r in s.read("x").collect()) == [("a", 3), ("a", 4)] and s.note("k") == 1 and s.read("y").count() == 0


def test_more_plugins_and_a_sink(spark, tmp_path):
    from lodestone.engine.plugins import Chunker, Detector, GraphModel, Vision

    class Words(Chunker):
        version = "1"

        def chunk(self, text):
            return text.split()

    class Latin(Detector):
        version = "1"

        def detect(self, text):
            return "la", 0.9, True

    class Eye(Vision):
        version = "1"

        def describe(self, prompt, url):
            return {"short_caption": "a red lighthouse"}

    class Names(GraphModel):
        version = "1"

        def distil(self, text):
            return {"entities": [{"label": "red"}, {"label": "lighthouse"}], "relations": [{"source": "red", "target": "lighthouse", "weight": 2}]}

    r, events = Registry(), []
    for p in (Words(), Latin(), Eye(), Names()):
        r.use(p)
    e = Engine(spark, str(tmp_path / "s"), C.load({"chunk": {"max_words": 2}}, env={}), registry=r, sink=lambda df: events.extend(df.collect()))
    e.ingest(frame(spark, [("t", b"one two three", "txt"), ("p", b"\xff\xd8\xff1", "image")]))
    assert {x["eu_id"]: x["passage"] for x in e.store.read("units").collect()} == {"t::0::0": "one", "t::0::1": "two", "t::0::2": "three", "p::img::0": "a red lighthouse"}
    assert {x["language"] for x in e.store.read("manifest").filter("document_id = 't'").collect()} == {"la"}
    assert [tuple(x) for x in e.edges().collect()] == [("node:red", "node:lighthouse", 2 * 1)] or e.edges().count() >= 1
    assert e.ask(asked(spark, "red lighthouse")).first()["doc_id"] == "p::img::0"
    assert [(x["stage"], x["outcome"]) for x in events] == [("generate", "ok")]
    e.store.drop("edges")
    assert e.store.read("edges").count() == 0


def test_database(spark, tmp_path):
    import sqlite3

    from lodestone.sources import database

    path = str(tmp_path / "d.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE units (eu_id TEXT PRIMARY KEY, document_id TEXT, n INT)")
    link = lambda: sqlite3.connect(path, timeout=60)
    rows = lambda *r: spark.createDataFrame(list(r), "eu_id string, document_id string, n int").coalesce(1)
    database.upsert(rows(("a", "d", 1), ("b", "d", 2), ("c", "e", 3)), link, "units", mark="?")
    database.upsert(rows(("a", "d", 9)), link, "units", mark="?")
    database.delete(spark.createDataFrame([("e",), ("none'",)], "document_id string").coalesce(1), link, "units", mark="?")
    with sqlite3.connect(path) as c:
        assert c.execute("SELECT * FROM units ORDER BY 1").fetchall() == [("a", "d", 9), ("b", "d", 2)]
    with pytest.raises(ValueError):
        database.upsert(rows(("a", "d", 9)), link, "units; drop", mark="?")
