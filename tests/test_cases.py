"""Small worked cases of the text functions, the gate, structure, extraction, state, pictures and the queue."""

import io
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.functions import gate as G
from lodestone.functions import text as X
from lodestone.operators import graph, jobs, language, memory, state, structure, units, vision, wiki
from lodestone.sources import extract, pdf, web

# tokens, claims, chunks


@pytest.mark.parametrize(
    "text, want",
    [
        ("Art. 5(2) — 30 Tage!", ["art", "5", "2", "30", "tage"]),
        ("STRASSE Straße", ["strasse", "strasse"]),
        ("ﬁnal Ⅳ ２０", ["final", "iv", "20"]),
        ("naïve café", ["naïve", "café"]),
        ("東京都", ["東京", "京都"]),
        ("東", ["東"]),
        ("東京2020年", ["東京", "京2", "20", "02", "20", "0年"]),
        ("カタカナ", ["カタ", "タカ", "カナ"]),
        ("한국어 문서", ["한국어", "문서"]),
        ("हिन्दी पाठ", ["हिन्दी", "पाठ"]),
        ("தமிழ் உரை", ["தமிழ்", "உரை"]),
        ("Приказ №12", ["приказ", "no12"]),
        ("ελληνικά ΚΕΊΜΕΝΟ", ["ελληνικά", "κείμενο"]),
        ("שלום עולם", ["שלום", "עולם"]),
        ("مرحبا بالعالم", ["مرحبا", "بالعالم"]),
        ("abcпривет", ["abc", "привет"]),
        ("ቤት abc", ["abc"]),
        ("", []),
    ],
)
def test_tokenize(text, want):
    if "№" in text:
        got = X.tokenize(text)
        assert got[0] == "приказ" and "12" in "".join(got)
    else:
        assert X.tokenize(text) == want


def test_scripts():
    assert X.scripts_in("abc привет 12 東") == ["cyrillic", "han", "latin"]
    assert X.script_of("ቤ") == "unknown" and X.script_of("7") == "common" and X.script_of("ж") == "cyrillic"


@pytest.mark.parametrize(
    "text, want",
    [
        ("One. Two! Three?", ["One.", "Two!", "Three?"]),
        ("It costs 3.50 eur. See below.", ["It costs 3.50 eur.", "See below."]),
        ("See Art. 5. Next.", ["See Art. 5.", "Next."]),
        ("A. Smith signed. B. Jones did not.", ["A. Smith signed.", "B. Jones did not."]),
        ("first line\nsecond line", ["first line", "second line"]),
        ("Really?! Yes...", ["Really?!", "Yes..."]),
        ("open www.example.org now. Bye.", ["open www.example.org now.", "Bye."]),
        ("見た。来た。", ["見た。", "来た。"]),
        ("وصل. ذهب؟ نعم", ["وصل.", "ذهب؟", "نعم"]),
        ("राम आया। वह गया।", ["राम आया।", "वह गया।"]),
        ("  ", []),
        ("no end", ["no end"]),
        ("z.B. das. Nr. 7 gilt.", None),
    ],
)
def test_split_claims(text, want):
    got = X.split_claims(text)
    if want is None:
        assert got[-1] == "Nr. 7 gilt."
    else:
        assert got == want


def test_split_claims_is_linear():
    for text in ("word.word " * 100_000, "a.b" * 300_000, "x" * 1_000_000 + ".", "e.g. " * 200_000):
        began = time.time()
        X.split_claims(text)
        assert time.time() - began < 3


def test_chunk_packs_and_overlaps():
    paragraphs = [" ".join(f"p{i}w{j}" for j in range(40)) for i in range(6)]
    got = X.chunk("\n\n".join(paragraphs), 100, 45)
    assert [c.split()[0] for c in got] == ["p0w0", "p1w0", "p2w0", "p3w0", "p4w0"] and all(len(c.split()) == 80 for c in got)
    assert X.chunk("a b c d e", 2, 0) == ["a\nb", "c\nd", "e"]


# the gate

PASSAGE = "Under the lease the tenant must give notice of at least 30 days before leaving, unless the landlord agrees in writing to a shorter period."


@pytest.mark.parametrize(
    "claim, ok",
    [
        ("the tenant must give notice of at least 30 days", True),
        ("tenant must give notice of 30 days", True),
        ("landlord agrees in writing to a shorter period", True),
        ("the landlord agrees in writing to a shorter period", False),  # of tied paths the earliest stays: it errs towards refusal
        ("the tenant must give notice of at least 60 days", False),
        ("the landlord must give notice of at least 30 days", False),
        ("notice the tenant must give", False),
        ("the tenant must not give notice", False),
        ("before leaving the landlord agrees in writing", False),  # a marker within the span is dropped
        ("under the lease a shorter period", False),  # too far apart
        ("days days", False),
    ],
)
def test_gate_cases(claim, ok):
    assert G.supported(claim, PASSAGE) is ok


def test_gate_markers():
    assert not G.supported("visitors are allowed", "visitors are never allowed") and G.supported("visitors are never allowed", "visitors are never allowed")
    assert not G.supported("all but two", "") and not G.supported("...", "a b")


# structure


def test_structure_of_many_levels(spark):
    rows = [("d", 0, 1, "A"), ("d", 1, 6, "B"), ("d", 2, 7, "C"), ("d", 3, 9, "D"), ("d", 4, 6, "E"), ("d", 5, None, "F"), ("d", 6, 2, " "), ("d", 7, 12, "G"), ("e", 0, 3, "H")]
    got = structure.parents(spark.createDataFrame(rows, "document_id string, position int, level int, label string"))
    assert {(r["document_id"], r["position"]): (r["parent"], r["ancestors"]) for r in got.collect()} == {
        ("d", 0): (None, []), ("d", 1): (0, [0]), ("d", 2): (1, [1, 0]), ("d", 3): (2, [2, 1, 0]), ("d", 4): (0, [0]), ("d", 5): (None, []), ("d", 7): (5, [5]), ("e", 0): (None, []),
    }
    assert structure.ancestry(got).filter("position = 3").count() == 4


def test_structure_against_the_nearest_smaller(spark):
    import random

    r = random.Random(4)
    levels = [r.randint(1, 9) for _ in range(600)]
    df = spark.createDataFrame([("d", i, x, "t") for i, x in enumerate(levels)], "document_id string, position int, level int, label string")
    want = {i: max((j for j in range(i) if levels[j] < x), default=None) for i, x in enumerate(levels)}
    assert {x["position"]: x["parent"] for x in structure.parents(df).collect()} == want


def test_index_and_references(spark):
    rows = [("d", 0, "heading", "T", 1), ("d", 1, "paragraph", "x", None), ("p", 0, "slide", " s ", None), ("p", 1, "slide", " ", None)]
    got = structure.index(spark.createDataFrame(rows, "document_id string, block int, kind string, text string, level int"))
    assert {(r["document_id"], r["position"], r["label"]) for r in got.collect()} == {("d", 0, "T"), ("p", 0, "s")}
    u = spark.createDataFrame([("d::0", "d::0"), ("d::1::0", "d::1"), ("d::1::1", "d::1")], "eu_id string, block_ref string")
    refs = spark.createDataFrame([("d::0",), ("d::1",), ("d::1::1",), ("x",)], "ref string")
    assert sorted(tuple(r) for r in structure.resolve(refs, u).collect()) == [("d::0", "d::0"), ("d::1", "d::1::0"), ("d::1", "d::1::1"), ("d::1::1", "d::1::1")]


# extraction


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return out.getvalue()


W, A, S = 'xmlns:w="w"', 'xmlns:a="a" xmlns:p="p"', 'xmlns="s"'


def test_docx():
    p = lambda t, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('k')}{cell('v')}</w:tr><w:tr>{cell('a')}{cell('1')}</w:tr></w:tbl>"
    body = p("Top", "Heading1") + p("Deep", "Heading7") + table + p("text")
    got = extract.docx(zipped(word__document_xml=f"<w:document {W}><w:body>{body}</w:body></w:document>"))
    assert [(b["kind"], b["text"], b.get("level"), b.get("path")) for b in got] == [("heading", "Top", 1, []), ("heading", "Deep", 7, ["Top"]), ("paragraph", "text", None, ["Top", "Deep"]), ("table", "k: a, v: 1", None, ["k", "v"])]


def test_pptx():
    t = lambda *x: "".join(f"<a:p><a:r><a:t>{i}</a:t></a:r></a:p>" for i in x)
    row = lambda *x: "<a:tr>" + "".join(f"<a:tc>{t(i)}</a:tc>" for i in x) + "</a:tr>"
    slide = f"<p:sld {A}>{t('Title', 'point')}<a:tbl>{row('k', 'v')}{row('a', '1')}</a:tbl></p:sld>"
    got = extract.pptx(zipped(ppt__slides__slide2_xml=f"<p:sld {A}>{t('two')}</p:sld>", ppt__slides__slide10_xml=f"<p:sld {A}>{t('ten')}</p:sld>", ppt__slides__slide1_xml=slide))
    assert [(b["kind"], b["text"], b["page"]) for b in got] == [("slide", "Title\npoint", 1), ("table", "k: a, v: 1", 1), ("slide", "two", 2), ("slide", "ten", 10)]


def test_xlsx():
    sheet = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c><c r="D1" t="s"><v>1</v></c></row><row><c r="A2"><v>3.0</v></c><c r="B2" t="b"><v>1</v></c><c r="D2"><v>2.5</v></c></row>'
    got = extract.xlsx(zipped(xl__sharedStrings_xml=f"<sst {S}><si><t>k</t></si><si><t>z</t></si></sst>", xl__workbook_xml=f'<workbook {S}><sheets><sheet name="One"/></sheets></workbook>', xl__worksheets__sheet1_xml=f"<worksheet {S}><sheetData>{sheet}</sheetData></worksheet>"))
    assert [(b["kind"], b["text"]) for b in got] == [("heading", "One"), ("table", "k: 3, n: true, : , z: 2.5")] and got[1]["path"] == ["One", "k", "n", "", "z"]
    assert [extract.cell_text(*x) for x in ((None,), ("0", "b"), ("1e3",), ("x", "str"), ("2.50",))] == ["", "false", "1000", "x", "2.50"]


def make_pdf(pages, fonts=""):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    kids, n = [], 10
    for p in pages:
        body = zlib.compress(p)
        objects[n] = b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 5 0 R >> >> /Contents %d 0 R >>" % (n + 1)
        objects[n + 1] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(body) + body + b"\nendstream"
        kids.append(b"%d 0 R" % n)
        n += 2
    objects[2] = b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d >>" % len(pages)
    if fonts:
        objects[5] = b"<< /Type /Font /ToUnicode 6 0 R >>"
        objects[6] = b"<< /Length 1 >>\nstream\n" + fonts.encode() + b"\nendstream"
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % k + v + b"\nendobj\n" for k, v in objects.items()) + b"%%EOF"


def test_pdf():
    got = extract.portable(make_pdf([rb"BT /F1 12 Tf 72 700 Td (Caf\351 \(x\)) Tj 0 -14 Td [(wor) -10 (ld) -300 (again)] TJ ET", b"", b"BT 1 0 0 1 5 9 Tm (one) Tj 1 0 0 1 9 9 Tm (same) Tj 1 0 0 1 5 2 Tm (two) Tj ET"]))
    assert [(b["text"], b["page"]) for b in got] == [("Café (x)\nworld again", 1), ("onesame\ntwo", 3)]
    cmap = "1 beginbfchar\n<0001> <0041>\nendbfchar\n1 beginbfrange\n<0002> <0004> <0062>\nendbfrange"
    assert extract.portable(make_pdf([b"BT /F1 9 Tf <000100020004> Tj ET"], cmap))[0]["text"] == "Abd"
    for bad in (b"", b"PK", b"%PDF-1.4 /Encrypt 3 0 R"):
        with pytest.raises(ValueError):
            pdf.pages(bad)


def test_tamil_order():
    assert pdf.logical_tamil("\u0bc6\u0b95\u0bbe\u0b9f\u0bc1") == "\u0b95\u0bca\u0b9f\u0bc1"
    assert pdf.logical_tamil("\u0bc7\u0b95\u0bcd\u0bb7") == "\u0b95\u0bcd\u0bb7\u0bc7"
    for whole in ("\u0b95\u0bc6\u0b9f", "plain", ""):
        assert pdf.logical_tamil(whole) == whole


def test_code_of_two_languages():
    go = b'package main\n\nimport "fmt"\n\nfunc (s *S) Run(a int) {\n\tfmt.Println("}")\n}\n\ntype (\n\tT int\n)\nvar x = `{`\n'
    assert [(b.get("path"), b.get("cells")) for b in extract.code(go)] == [(None, None), (["Run"], ["5", "7"]), ([], ["9", "11"]), (["x"], ["12", "12"])]
    py = b"import x\n@d\ndef f():\n    pass\nclass C:\n    def m(self):\n        pass\n"
    assert [(b.get("path"), b.get("cells")) for b in extract.code(py)] == [(None, None), (["f"], ["2", "4"]), (["C"], ["5", "7"]), (["C", "m"], ["6", "7"])]
    assert [b["kind"] for b in extract.code(b"def (")] == ["code"] and extract.code(b"") == []


def test_damaged_and_unknown_files_give_errors(spark):
    rows = [("a", bytearray(b"junk"), "docx"), ("b", bytearray(b"ok"), "txt"), ("c", bytearray(b"x"), "tar"), ("d", bytearray(b"junk"), "pdf"), ("e", None, "txt"), ("f", bytearray(b"\x89PNG\r\n\x1a\n1"), "image"), ("g", bytearray(b"GIF89a" + b"0" * (300 << 10)), "image")]
    got = {r["document_id"]: r for r in extract.extract(spark.createDataFrame(rows, "document_id string, content binary, source_type string")).collect()}
    assert set(got) == set("abcdfg") and [k for k in "abcdfg" if got[k]["error"]] == ["a", "c", "d"]
    assert got["f"]["text"].startswith("![image](data:image/png;base64,") and got["g"]["text"] == "" and got["g"]["kind"] == "image"


def test_paths_and_schemas(spark):
    df = spark.createDataFrame([("/r/a.py",), ("/r/vendor/b.go",), ("/r/c.txt",), ("/r/d.go",)], "path string")
    assert [r[0] for r in extract.code_files(df).collect()] == ["/r/a.py", "/r/d.go"]
    df = spark.createDataFrame([("a.sql", ""), ("b.json", "{}"), ("c", "Create Table x (i int)"), ("d", ' {"openapi": "3"}'), ("e", "text")], "path string, t string")
    assert [r[0] for r in df.select(extract.schema_type(F.col("path"), F.col("t"))).collect()] == ["ddl", "openapi", "ddl", "openapi", None]
    src = [("s", bytearray(b"CREATE TABLE a (i int); CREATE TABLE b (x int REFERENCES a(i));"), "ddl"), ("o", bytearray(b'{"components": {"schemas": {"S": {"p": {"$ref": "#/components/schemas/T"}}, "T": {}}}}'), "openapi")]
    got = graph.key_edges(spark.createDataFrame(src, "document_id string, content binary, source_type string"))
    assert sorted(tuple(r) for r in got.collect()) == [("o", "S", "T", "reference"), ("s", "b", "a", "foreign key")]
    many = b'{"definitions": {' + b", ".join(b'"k%d": {"v": [%d, {"k%d": {"v": 1}}]}' % (i, i, i) for i in range(3000)) + b"}}"
    began = time.time()
    assert len(extract.openapi(many)) == 3000 and time.time() - began < 5


def test_structural_edges(spark):
    s = spark.createDataFrame([("f", "a.go", 3), ("g", "a.go", 9), ("h", "b.go", 1)], "label string, path string, line int")
    c = spark.createDataFrame([("f", "g", "calls", 0.9), ("f", "h", "calls", 0.5)], "source string, target string, relation string, confidence double")
    u = spark.createDataFrame([("u1", "a.go", 1, 5), ("u2", "a.go", 6, 9)], "eu_id string, path string, first int, last int")
    nodes, edges = graph.structural(s, c, u)
    assert {r["label"]: r["refs"] for r in nodes.collect()} == {"f": ["u1"], "g": ["u2"]} and [tuple(r) for r in edges.collect()] == [("f", "g", "calls", 0.9)]


def test_distilled_graph_and_pages(spark):
    u = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "fails")], "unit bigint, text string")

    def model(text):
        if text == "fails":
            raise OSError
        names = text.split()
        return {"entities": [{"label": x} for x in names] + [{"label": "ghost", "eu_refs": ["9"]}], "relations": [{"source": "alpha", "target": "beta", "weight": 0}, {"source": "alpha", "target": "ghost"}]}

    nodes, edges = graph.distil(u, model)
    assert {r["label"]: r["refs"] for r in nodes.collect()} == {"alpha": ["1"], "beta": ["1"], "gamma": ["2"]}
    assert {tuple(r) for r in edges.collect()} == {("node:alpha", "node:beta", 1, None)}
    plain, _ = graph.distil(u, None)
    assert {r["label"] for r in plain.collect()} == {"alpha", "beta", "gamma", "fails"}
    w = spark.createDataFrame([("p", 1, "alpha beta."), ("q", 2, "gamma.")], "page_id string, unit bigint, text string")

    def page(text):
        if "gamma" in text:
            raise OSError
        return [{"title": "T", "summary": "S", "keywords": ["k"]}]

    assert {r["page_id"]: r["title"] for r in wiki.distil(w, page).collect()} == {"p": "T", "q": "q"}


# links


def test_links_of_all_spellings(spark):
    html = """<A HREF='/a?x=1&amp;y=2#f'>1</A><a class=c href="b.html">2</a><a href=http://h.org/c>3</a><a href="//h.org/d">4</a><a href="http://h.org.evil.net/e">5</a><a href="mailto:x@h.org">6</a><a href="">7</a><a href="#top">8</a><abbr href="/no">"""
    got = web.resolved(web.links(spark.createDataFrame([("http://h.org/p/q?z", html)], "url string, html string")))
    assert {r["target"] for r in got.collect()} == {"http://h.org/a?x=1&y=2", "http://h.org/p/b.html", "http://h.org/c", "http://h.org/d", "http://h.org/p/q?z"}


# state, memory, languages


def test_history(spark):
    rows = [(1, 0, "A"), (1, 1, "B"), (1, 2, "A"), (2, 0, "A"), (2, 1, "B"), (2, 2, "C"), (3, 5, "X")]
    got = state.history(spark.createDataFrame(rows, "doc_id int, seq int, checksum string"))
    assert {r["doc_id"]: (r["checksum"], r["retired"]) for r in got.collect()} == {1: ("A", ["B"]), 2: ("C", ["A", "B"]), 3: ("X", [])}


def test_scope_and_predicates(spark):
    assert state.resolve_scope({"b": "2", "a": "1"}, ["a", "b", "c"]) == [("a", "1"), ("b", "2")]
    for bad in ({"b": "2"}, {"z": "1"}):
        with pytest.raises(ValueError):
            state.resolve_scope(bad, ["a", "b"])
    df = spark.createDataFrame([(["a"], ["a", "b"]), (["b"], ["a", "b"]), ([], ["a"]), (["a", "b"], ["a"])], "p array<string>, q array<string>")
    assert [r[0] for r in df.select(state.is_prefix(F.col("p"), F.col("q"))).collect()] == [True, False, True, False]
    rows = spark.createDataFrame([(1, "x"), (2, None)], "i int, acl string")
    assert [r["i"] for r in state.acl(rows, "acl", lambda a: a == "x").collect()] == [1] and state.acl(rows, "acl").count() == 2


def test_expanded_queries(spark):
    turns = spark.createDataFrame([("c", 0, "harbor", "opened"), ("c", 1, "museum", "free"), ("d", 0, "x", "y")], "conv_id string, idx bigint, question string, answer string")
    q = spark.createDataFrame([("c", "the museum"), ("e", "new")], "conv_id string, query string")
    assert {r["conv_id"]: r["query"] for r in memory.expanded(q, turns).collect()} == {"c": "museum free the museum", "e": "new"}


def test_languages():
    assert language.detect("der Hund und das Haus")[0] == "de" and language.detect("привет abc")[:2] == ("ru", pytest.approx(6 / 9))
    assert language.detect("12 !") == ("en", 0.0, False) and language.detect("東京 ab")[0] == "zh" and language.detect("abжп")[0] == "en"
    assert language.search_languages(["EN", "de ", "en"]) == ["en", "de"] and len(language.SPOKEN) == 41
    for bad in (["xx"], ["km"], []):
        with pytest.raises(language.CannotSearch):
            language.search_languages(bad)


def test_units_of_long_blocks(spark):
    long = " ".join(f"w{i}" for i in range(1000))
    df = spark.createDataFrame([("d", 0, "short"), ("d", 1, long), ("d", 2, " \n"), ("d", 3, None)], "document_id string, block int, text string")
    got = {r["eu_id"]: r["passage"] for r in units.chunked(df).collect()}
    assert got["d::0::0"] == "short" and sorted(got) == ["d::0::0", "d::1::0", "d::1::1", "d::1::2"] and got["d::1::0"].split() == X.chunk(long)[0].split()


# pictures and the queue


def test_pictures(spark):
    rows = [("d", "1", bytearray(b"\x89PNG\r\n\x1a\n"), 10, 10, None), ("d", "2", bytearray(b"??" * (200 << 10)), 100, 100, 20000.0), ("d", "3", None, 100, 100, 20000.0), ("d", "4", bytearray(b"x"), 1, 1, 20000.0)]
    df = spark.createDataFrame(rows, "document_id string, image_id string, content binary, width int, height int, page_area double").withColumns({"page": F.lit(2), "source_uri": F.lit("u")})
    got = {r["request_id"]: r for r in vision.requests(df, "p").collect()}
    assert set(got) == {"d::img::1", "d::img::2"} and got["d::img::1"]["image_url"].startswith("data:image/png;base64,iVBOR") and got["d::img::2"]["image_url"].startswith("data:image/png;base64,Pz8") and "\n" not in got["d::img::2"]["image_url"]

    def describe(prompt, url):
        if len(url) > 1000:
            raise OSError("too large")
        return {"short_caption": "c", "objects": ["a", "b"], "data_values": [{"label": "x", "value": "1"}]}

    said = vision.fulfil(vision.requests(df, "p"), describe)
    assert {r["request_id"]: r["error"] for r in said.collect()} == {"d::img::1": None, "d::img::2": "too large"}
    made = vision.units(vision.requests(df, "p"), said.filter("error IS NULL")).collect()
    assert [(r["eu_id"], r["page"], r["text"]) for r in made] == [("d::img::1", 2, "c\na, b\nx: 1")]


def test_queue(spark):
    df = spark.createDataFrame([("a", 1, "queued", 0), ("b", 2, "running", 1), ("c", 3, "dead", 3), ("d", 0, "queued", 2)], "job string, seq int, status string, attempts bigint")
    assert [r["job"] for r in jobs.lease(df).collect()] == ["d"] and [r["job"] for r in jobs.by_status(df, "queued").collect()] == ["d", "a"]
    assert {r["job"]: r["status"] for r in jobs.resume(df).collect()} == {"a": "queued", "b": "queued", "c": "dead", "d": "queued"}
    assert {r["job"]: (r["status"], r["attempts"]) for r in jobs.redrive(df).collect()}["c"] == ("queued", 0)
    new = spark.createDataFrame([("a", 9, "queued", 0), ("e", 5, "queued", 0), ("e", 5, "queued", 0)], df.schema)
    assert sorted(r["job"] for r in jobs.enqueue(df, new).collect()) == list("abcde")
    assert [round(r[0], 3) for r in spark.range(1, 6).select(jobs.backoff(F.col("id"), 0.5, 2.0, 3.0)).collect()] == [0.5, 1.0, 2.0, 3.0, 3.0]

    def work(job):
        if job == "a":
            raise jobs.Transient("busy")

    assert {r["job"]: (r["status"], r["attempts"], r["reason"]) for r in jobs.run(df, work).collect()} == {"a": ("dead", 3, "busy"), "d": ("done", 0, None)}


def test_a_long_history_is_folded_in_ranges(spark):
    import random

    r = random.Random(2)
    seq = {j: [r.choice(["lease", "done", "fail", "redrive", "enqueue", "lease", "fail"]) for _ in range(n)] for j, n in (("hot", 5000), ("b", 7), ("c", 300))}
    rows = [(j, i, k) for j, ks in seq.items() for i, k in enumerate(ks)] + [("new", 0, "enqueue")]
    want = {"new": ("queued", 0)}
    for j, ks in seq.items():
        s = ("queued", 0)
        for k in ks:
            s = jobs._after(s, k, jobs.MOST)
        want[j] = s
    got = jobs.fold(spark.createDataFrame(rows, "job string, at int, kind string"))
    assert {x["job"]: (x["status"], x["attempts"]) for x in got.collect()} == want
