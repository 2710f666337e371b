import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import gate as G
from lodestone.functions import text as X
from lodestone.operators import conflict, grounding, jobs
from lodestone.sources import extract


def test_tokenizers_agree_on_latin_text(spark):
    texts = ["Straße Nr. 5, Élan!", "", "a-b_c 12x", "ÀÉÎ über"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.tokens_latin(F.col("t")), X.tokens_unicode("t")).collect()
    assert all(a == b for a, b in got)


def test_continuous_scripts_give_pairs():
    assert X.tokenize("東京都 abc") == ["東京", "京都", "abc"]


@pytest.mark.parametrize("text, n", [("One. Two! Three?", 3), ("It cost 3.5 eur. Yes.", 2), ("Dr. No came.", 1), ("a\nb", 2), ("", 0), ("見た。来た。", 2)])
def test_claims(text, n):
    assert len(X.split_claims(text)) == n


def test_gate():
    assert G.supported("the notice period is 30 days", "By law the notice period is at least 30 days.")
    assert not G.supported("the period is 30 days", "the period is not 30 days")
    assert not G.supported("days 30", "30 days")
    assert not G.supported("", "x") and not G.supported("x", "")
    assert not G.supported("a b", "a x x x x x a b")  # the earliest of tied paths stays


def test_align_against_the_plain_recurrence():
    def plain(c, p):
        paths = {j: (0, 0, j) for j, t in enumerate(p) if t == c[0]}
        for t in c[1:]:
            grown = {}
            for j in (j for j, x in enumerate(p) if x == t):
                before = [e for e in sorted(paths) if e < j]
                if not before:
                    continue
                e = min(before, key=lambda e: (paths[e][0], e))
                s, w, b = paths[e]
                if j - e - 1 <= 4 and s + j - e - 1 <= 8:
                    grown[j] = (s + j - e - 1, max(w, j - e - 1), b)
            if not grown:
                return None
            paths = grown
        if not paths:
            return None
        end = min(paths, key=lambda j: (paths[j][0], j))
        return paths[end][2], end, paths[end][0], paths[end][1]

    r = random.Random(3)
    for _ in range(3000):
        c, p = r.choices("abc", k=r.randint(1, 5)), r.choices("abcd", k=r.randint(1, 25))
        assert G.align(c, p) == plain(c, p)


def test_chunks():
    words = [f"w{i}" for i in range(1000)]
    out = X.chunk(" ".join(words), 100, 10)
    assert X.chunk("  a b ") == ["a b"] and X.chunk("") == []
    assert {w for c in out for w in c.split()} == set(words) and max(len(c.split()) for c in out) <= 110


def test_conflicts(spark):
    texts = [
        "The notice period for tenants is 30 days",
        "The notice period for tenants is 60 days",
        "The notice period for tenants is not 30 days",
        "Sales rose in the northern region market",
        "Sales fell in the northern region market",
        "Short",
    ]
    df = spark.createDataFrame([("g", i, t) for i, t in enumerate(texts)], "group string, position int, text string")
    got = {(r["left"], r["right"]): r["rule"] for r in conflict.conflicts(df).collect()}
    assert got == {(0, 1): "value", (0, 2): "negation", (1, 2): "negation", (3, 4): "antonym"}


def test_conflicts_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(conflict, "BLOCK", 4)
    r = random.Random(3)
    texts = [f"{r.choice(['Sales', 'Yearly sales', 'Prices'])} {r.choice(['rose', 'fell', 'not fell'])} in the {r.choice(['northern', 'large northern', 'southern'])} market to {r.choice([10, 20, 30, '10 and 20'])} {r.choice(['usd', 'percent', ''])}" for _ in range(40)]
    rows = [(g, i, t) for g, n in (("g", 30), ("h", 10), ("one", 1)) for i, t in enumerate(texts[:n])]
    df = spark.createDataFrame(rows, "group string, position int, text string")
    f = df.select("group", "position", conflict.features(F.col("text")).alias("f"))
    left, right = (f.select("group", F.col("position").alias(p), F.col("f").alias(c)) for p, c in (("left", "a"), ("right", "b")))
    pairs = left.join(right, "group").filter("left < right").select("group", "left", "right", conflict.finding("a", "b").alias("rule"))
    want = sorted(tuple(x) for x in pairs.filter("rule IS NOT NULL").collect())
    assert sorted(tuple(x) for x in conflict.conflicts(df).collect()) == want
    assert {x[3] for x in want} == {"antonym", "negation", "value"} and max(x[2] for x in want) > conflict.WINDOW
    assert sorted(tuple(x) for x in conflict.conflicts(df, conflict.WINDOW).collect()) == [x for x in want if x[2] < conflict.WINDOW]


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(5)
    base = [" ".join(r.choices([f"w{i}" for i in range(60)], k=20)) for _ in range(30)]
    texts = base + [b + " extra" for b in base[:10]] + base[:3] + ["", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(x["doc_id"], x["duplicate_of"]) for x in conflict.near_duplicates(docs).collect()}
    want, first = set(), {}
    for i, t in enumerate(texts):
        if t in first:
            want.add((i, first[t]))
        else:
            first[t] = i
    reps = list(first.values())
    for a in reps:
        for b in reps:
            s, u = set(texts[a].split()), set(texts[b].split())
            if a > b and s | u and len(s & u) / len(s | u) >= 0.8 and abs(len(texts[a].split()) - len(texts[b].split())) <= 2:
                want.add((a, b))
    assert got == want


def test_coverage_against_all_pairs(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    claims = [" ".join(r.sample(words, 6)) for _ in range(20)] + ["the of"]
    docs = [" ".join(r.sample(words, 15)) for _ in range(40)]
    c = spark.createDataFrame(list(enumerate(claims)), "claim_id bigint, claim string")
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    for least in (1.0, 0.8, 0.5):
        got = {(x[0], x[1]) for x in grounding.coverage_pairs(c, d, least).collect()}
        assert got == {(i, j) for i, x in enumerate(claims[:-1]) for j, y in enumerate(docs) if len(set(x.split()) & set(y.split())) / 6 >= least - 1e-9}


def test_jobs(spark):
    seq = {"a": ["lease", "done", "fail"], "b": ["lease", "fail"] * 3 + ["lease"], "c": ["lease", "fail"] * 3 + ["redrive"], "d": ["done"]}
    df = spark.createDataFrame([(j, i, k) for j, ks in seq.items() for i, k in enumerate(ks)], "job string, at int, kind string")
    assert {r["job"]: (r["status"], r["attempts"]) for r in jobs.fold(df).collect()} == {"a": ("done", 0), "b": ("dead", 3), "c": ("queued", 0), "d": ("queued", 0)}


def test_extractors(spark):
    page = b"<h1>T</h1><script>x</script><p>a <a href='/u'>link</a></p><ul><li>x<li>y</ul><table><tr><th>k</th></tr><tr><td>v</td></tr></table><pre>c</pre><div>gone</div>"
    assert [(b["kind"], b["text"]) for b in extract.html(page)] == [("heading", "T"), ("paragraph", "a[link](/u)"), ("list", "- x\n- y"), ("table", "k: v"), ("code", "c")]
    md = extract.markdown(b"# A\ntext\n\n## B\n```\ncode\n```\n")
    assert [(b["kind"], b["text"]) for b in md] == [("heading", "A"), ("paragraph", "text"), ("heading", "B"), ("code", "code")] and md[3]["path"] == ["A", "B"]
    assert [b["text"] for b in extract.txt(b"a\n\nb\n \nc")] == ["a", "b", "c"]
    assert [b.get("path") for b in extract.code(b"import x\ndef f():\n    pass\nclass C:\n    pass\n")][1:] == [["f"], ["C"]]
    sql = "-- create table no (\nCREATE TABLE a (id int, s text default ');');\ncreate table if not exists b (x int references a(id));"
    assert [t[2] for t in extract.ddl_tables(sql)] == ["a", "b"] and extract.foreign_keys(sql) == [("b", "a")]
    assert [b["path"][-1] for b in extract.openapi(b'{"paths": {"/p": {"get": 1}}, "components": {"schemas": {"S": {"type": "object"}}}}')] == ["/p", "S"]
    df = spark.createDataFrame([("d", bytearray(b"h,i\n1,2\n3,4\n"), "csv"), ("e", None, "txt")], "document_id string, content binary, source_type string")
    blocks = extract.extract(df)
    assert [r["text"] for r in blocks.orderBy("block").collect()] == ["h: 1, i: 2", "h: 3, i: 4"]
    assert extract.to_markdown(blocks).first()["markdown"] == "| h | i |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |"


def test_ingest_stream(spark, tmp_path):
    from lodestone.streaming import ingest

    folder = str(tmp_path / "store")
    rows = lambda x: spark.createDataFrame(x, "doc_id bigint, text string")
    ingest.take(rows([(1, "a"), (2, "b"), (3, None)]), 0, folder)
    ingest.take(rows([(1, "a"), (2, "c")]), 1, folder)
    ingest.take(rows([(1, "a"), (2, "c")]), 1, folder)  # again
    assert {(r["document_id"], r["passage"]) for r in ingest.current_units(spark, folder).collect()} == {("1", "a"), ("2", "c")}


def test_ingest_takes_the_later_version_and_compacts(spark, tmp_path, monkeypatch):
    from lodestone.streaming import ingest

    monkeypatch.setattr(ingest, "SNAPSHOT", 2)
    folder = str(tmp_path / "store")
    for n in range(5):
        rows = spark.createDataFrame([(1, f"text {n}", 2), (1, "z older", 1), (n, "own", 1)], "doc_id bigint, text string, seq int")
        ingest.take(rows, n, folder)
    got = {r["document_id"]: r["passage"] for r in ingest.current_units(spark, folder).collect()}
    assert got == {"0": "own", "1": "text 4", "2": "own", "3": "own", "4": "own"}
    assert sorted(p.name for p in (tmp_path / "store/snapshot").iterdir()) == ["part=1", "part=3"]
    assert ingest.manifest_before(spark, folder, 1).count() == 2


def test_stream_of_documents(spark, tmp_path):
    from lodestone.streaming import ingest

    src, folder = str(tmp_path / "in"), str(tmp_path / "store")
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string").write.parquet(src)
    for _ in range(2):
        ingest.start(spark.readStream.schema("doc_id bigint, text string").parquet(src), folder).awaitTermination()
    assert {r["passage"] for r in ingest.current_units(spark, folder).collect()} == {"a", "b"}


def test_closest_alignment_against_all_paths():
    from itertools import combinations

    r = random.Random(6)
    for _ in range(1500):
        c, p = r.choices("abc", k=r.randint(1, 4)), r.choices("abcd", k=r.randint(1, 12))
        best = None
        for at in combinations(range(len(p)), len(c)):
            gaps = [b - a - 1 for a, b in zip(at, at[1:])]
            if [p[i] for i in at] == c and all(g <= 4 for g in gaps) and sum(gaps) <= 8:
                best = min(best or (99, 99), (sum(gaps), at[-1]))
        got = G.align_closest(c, p)
        assert (None if got is None else (got[2], got[1])) == best
        if G.align(c, p) is not None:
            assert got is not None
    assert G.align_closest(list("ab"), "a x x x x x a b".split()) == (6, 7, 0, 0)
