"""Documents to ordered blocks: (document_id, block, kind, text, level, page, path, cells).

``extract`` maps rows (document_id, content, source_type) through the parser of
their type; parsers are plain functions over bytes and need only the standard
library.
"""

from __future__ import annotations

import ast
import base64
import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources import pdf

SCHEMA = "document_id string, block int, kind string, text string, level int, page int, path array<string>, cells array<string>, error string"
Block = dict
EXTENSIONS = {"txt": "txt", "text": "txt", "csv": "csv", "md": "md", "markdown": "md", "html": "html", "htm": "html", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "pdf": "pdf", "py": "code", "go": "code", "sql": "ddl", "json": "openapi", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "webp": "image"}


def source_type(path: Column) -> Column:
    """By the file's extension; ``plain`` for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("plain")
    for k, v in EXTENSIONS.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def _block(text: str, kind: str = "paragraph", **more) -> Block:
    return {"kind": kind, "text": text, **more}


def plain(content: bytes) -> list[Block]:
    return [_block(content.decode(errors="replace"))]


def txt(content: bytes) -> list[Block]:
    """Paragraphs, parted by blank lines."""
    return [_block(p.strip()) for p in re.split(r"\n[ \t]*\n+", content.decode(errors="replace").replace("\r\n", "\n")) if p.strip()]


def table(content: bytes) -> list[Block]:
    rows = list(csv.reader(io.StringIO(content.decode(errors="replace"))))
    return _table_blocks(rows)


def _table_blocks(rows: list[list[str]]) -> list[Block]:
    if not rows:
        return []
    head = rows[0]
    return [_block(", ".join(f"{k}: {v}" for k, v in zip(head, r, strict=False)), "table", path=head, cells=r) for r in rows[1:]]


def markdown(content: bytes) -> list[Block]:
    """Headings with the headings above them, paragraphs, fenced code."""
    out: list[Block] = []
    above: list[tuple[int, str]] = []
    held: list[str] = []
    fence = None

    def flush(kind: str = "paragraph") -> None:
        if text := "\n".join(held).strip("\n") if kind == "code" else " ".join(x.strip() for x in held).strip():
            out.append(_block(text, kind, path=[t for _, t in above]))
        held.clear()

    for line in content.decode(errors="replace").splitlines():
        mark = re.match(r"\s{0,3}(```+|~~~+)", line)
        if fence:
            if mark and mark[1][0] == fence:
                flush("code")
                fence = None
            else:
                held.append(line)
        elif mark:
            flush()
            fence = mark[1][0]
        elif h := re.match(r"\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line):
            flush()
            while above and above[-1][0] >= len(h[1]):
                above.pop()
            out.append(_block(h[2], "heading", level=len(h[1]), path=[t for _, t in above]))
            above.append((len(h[1]), h[2]))
        elif not line.strip():
            flush()
        else:
            held.append(line)
    flush("code" if fence else "paragraph")
    return out


class _Page(HTMLParser):
    """Collects prose, tables, code and captions apart."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.prose: list[Block] = []
        self.tables: list[list[list[str]]] = []
        self.code: list[str] = []
        self.captions: list[str] = []
        self.skip = 0
        self.open: list[tuple[str, list[str]]] = []
        self.lists: list[list] = []
        self.href: list[tuple[str | None, int]] = []

    TEXT = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "pre", "caption", "figcaption", "td", "th"}

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("ul", "ol"):
            self.lists.append([tag, [], None])
        elif tag == "li" and self.lists:
            self._close_item()
            self.lists[-1][2] = []
        elif tag == "a" and self._sink() is not None:
            self.href.append((dict(attrs).get("href"), len(self._sink())))
        elif tag in self.TEXT and not self.lists:
            if self.open and self.open[-1][0] == "p":
                self._close()
            self.open.append((tag, []))

    def _sink(self) -> list[str] | None:
        if self.lists and self.lists[-1][2] is not None:
            return self.lists[-1][2]
        return self.open[-1][1] if self.open else None

    def handle_data(self, data):
        sink = self._sink()
        if not self.skip and sink is not None:
            sink.append(data if self.open and self.open[-1][0] == "pre" else data.strip())

    def _close_item(self) -> None:
        top = self.lists[-1]
        if top[2] is not None:
            if text := "".join(top[2]).strip():
                top[1].append(text)
            top[2] = None

    def _close(self) -> None:
        tag, parts = self.open.pop()
        text = "".join(parts)
        text = text if tag == "pre" else text.strip()
        if tag in ("td", "th"):
            if self.tables and self.tables[-1]:
                self.tables[-1][-1].append(text)
        elif not text.strip():
            pass
        elif tag == "pre":
            self.code.append(text)
        elif tag in ("caption", "figcaption"):
            self.captions.append(text)
        elif tag == "p":
            self.prose.append(_block(text))
        else:
            self.prose.append(_block(text, "heading", level=int(tag[1])))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("ul", "ol") and self.lists:
            self._close_item()
            kind, items, _ = self.lists.pop()
            lines = [f"{k}. {t}" if kind == "ol" else f"- {t}" for k, t in enumerate(items, 1)]
            if self.lists and self.lists[-1][2] is not None:
                self.lists[-1][2] += items
            elif lines:
                self.prose.append(_block("\n".join(lines), "list"))
        elif tag == "li" and self.lists:
            self._close_item()
        elif tag == "a" and self.href:
            url, at = self.href.pop()
            sink = self._sink()
            if url and sink is not None and (text := "".join(sink[at:])):
                sink[at:] = [f"[{text}]({url})"]
        elif tag in self.TEXT and any(t == tag for t, _ in self.open):
            while self.open[-1][0] != tag:
                self._close()
            self._close()


def html(content: bytes) -> list[Block]:
    """Headings, paragraphs and lists in their order, then table rows, code and captions; scripts, styles and text elsewhere are dropped."""
    p = _Page()
    p.feed(content.decode(errors="replace"))
    while p.open:
        p._close()
    rows = [b for t in p.tables for b in _table_blocks([r for r in t if r])]
    return p.prose + rows + [_block(c, "code") for c in p.code] + [_block(c, "caption") for c in p.captions]


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(z.read(name))


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _texts(e: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in e.iter() if _tag(x) == "t")


def docx(content: bytes) -> list[Block]:
    """Headings and paragraphs, then table rows."""
    out: list[Block] = []
    tables: list[list[list[str]]] = []
    above: list[tuple[int, str]] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = next(e for e in _xml(z, "word/document.xml").iter() if _tag(e) == "body")
    for e in body:
        if _tag(e) == "tbl":
            tables.append([[_texts(c) for c in r if _tag(c) == "tc"] for r in e if _tag(r) == "tr"])
        elif _tag(e) == "p" and (text := _texts(e).strip()):
            style = next((v for x in e.iter() if _tag(x) == "pStyle" for k, v in x.attrib.items() if k.endswith("val")), "")
            if m := re.fullmatch(r"(?i)heading\s*(\d)", style):
                level = int(m[1])
                while above and above[-1][0] >= level:
                    above.pop()
                out.append(_block(text, "heading", level=level, path=[t for _, t in above]))
                above.append((level, text))
            else:
                out.append(_block(text, path=[t for _, t in above]))
    return out + [b for t in tables for b in _table_blocks(t)]


def pptx(content: bytes) -> list[Block]:
    """A block a slide, followed by its table rows."""
    out: list[Block] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for no, name in slides:
            root = _xml(z, name)
            tables = [e for e in root.iter() if _tag(e) == "tbl"]
            inside = {id(x) for t in tables for x in t.iter()}
            lines = [_texts(e).strip() for e in root.iter() if _tag(e) == "p" and id(e) not in inside]
            out.append(_block("\n".join(x for x in lines if x), "slide", page=no))
            for t in tables:
                rows = [[_texts(c) for c in r if _tag(c) == "tc"] for r in t if _tag(r) == "tr"]
                out += [b | {"page": no} for b in _table_blocks(rows)]
    return out


def cell_text(value: str | None, kind: str = "n") -> str:
    """Nothing for an empty cell, true or false, whole numbers without a fraction."""
    if value is None or value == "":
        return ""
    if kind == "b":
        return "true" if value in ("1", "true", "True") else "false"
    try:
        number = float(value)
    except ValueError:
        return value
    return str(int(number)) if kind == "n" and number.is_integer() else value


def xlsx(content: bytes) -> list[Block]:
    """A heading a sheet, then its rows under the header."""
    out: list[Block] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = [_texts(e) for e in _xml(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        titles = [e.attrib.get("name", "") for e in _xml(z, "xl/workbook.xml").iter() if _tag(e) == "sheet"]
        sheets = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
        for k, (_, name) in enumerate(sheets):
            title = titles[k] if k < len(titles) else name
            out.append(_block(title, "heading", level=1))
            rows = []
            for r in (e for e in _xml(z, name).iter() if _tag(e) == "row"):
                cells: list[str] = []
                for c in (e for e in r if _tag(e) == "c"):
                    at = 0
                    for ch in re.match("[A-Z]*", c.attrib.get("r", ""))[0]:
                        at = at * 26 + ord(ch) - 64
                    cells += [""] * (at - 1 - len(cells))
                    kind = c.attrib.get("t", "n")
                    v = next((x.text for x in c if _tag(x) == "v"), None)
                    cells.append(_texts(c) if kind == "inlineStr" else shared[int(v)] if kind == "s" and v else cell_text(v, kind))
                rows.append(cells)
            out += [b | {"path": [title, *b["path"]]} for b in _table_blocks(rows)]
    return out


_GO = re.compile(r"^(?:func|type|const|var)\b", re.M)


def code(content: bytes) -> list[Block]:
    """Functions, classes and their methods of a Python or Go source word for word, with their first and last line in ``cells``; what precedes them is one block, and so is a source that doesn't parse."""
    text = content.decode(errors="replace")
    if re.search(r"^package\s+\w+", text, re.M):
        return _go(text)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return [_block(text, "code")] if text.strip() else []
    lines = text.splitlines()
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    begin = lambda n: min([n.lineno, *(d.lineno for d in n.decorator_list)])
    symbols = [(n, [n.name]) for n in tree.body if isinstance(n, kinds)]
    first = begin(symbols[0][0]) if symbols else len(lines) + 1
    symbols = [x for n, path in symbols for x in [(n, path), *((m, [*path, m.name]) for m in (n.body if isinstance(n, ast.ClassDef) else []) if isinstance(m, kinds[:2]))]]
    head = "\n".join(lines[: first - 1]).strip()
    out = [_block(head, "code")] if head else []
    return out + [_block("\n".join(lines[begin(n) - 1 : n.end_lineno]), "code", path=path, cells=[str(begin(n)), str(n.end_lineno)]) for n, path in symbols]


def _go(text: str) -> list[Block]:
    """Declarations at the left margin, each up to the bracket that closes it or its line's end."""
    bare = re.sub(r"`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|//[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    out: list[Block] = []
    end = 0
    for m in _GO.finditer(bare):
        if m.start() < end:
            continue
        depth, i = 0, m.start()
        while i < len(bare) and not (bare[i] == "\n" and depth == 0):
            depth += {"(": 1, "{": 1, "[": 1, ")": -1, "}": -1, "]": -1}.get(bare[i], 0)
            i += 1
        if not out and (head := text[: m.start()].strip()):
            out.append(_block(head, "code"))
        name = re.match(r"func\s*(?:\([^)]*\)\s*)?(\w+)|(?:type|const|var)\s+(\w+)", bare[m.start() : i])
        lines = [text.count("\n", 0, m.start()) + 1, text.count("\n", 0, i) + 1]
        out.append(_block(text[m.start() : i].rstrip(), "code", path=[name[1] or name[2]] if name else [], cells=[str(x) for x in lines]))
        end = i
    return out or ([_block(text, "code")] if text.strip() else [])


VENDORED = frozenset(".git node_modules vendor venv .venv __pycache__ build dist target".split())


def code_files(files: DataFrame) -> DataFrame:
    """The Python and Go files of (path, ...), those of vendored and built directories left out."""
    inside = F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in sorted(VENDORED)]))
    return files.filter(F.col("path").rlike(r"\.(py|go)$") & ~inside)


def schema_type(path: Column, text: Column) -> Column:
    """``ddl`` or ``openapi`` by the file's name, else by its text; null for what is neither."""
    json_like = F.ltrim(text).startswith("{") & text.rlike(r'"(openapi|swagger|\$defs|definitions|\$schema)"')
    return F.when(F.lower(path).endswith(".sql"), "ddl").when(F.lower(path).rlike(r"\.(json|ya?ml)$|openapi"), "openapi").when(text.rlike(r"(?i)\bcreate\s+table\b"), "ddl").when(json_like, "openapi")


def image(content: bytes) -> list[Block]:
    """One block: the picture inlined if it is of a known type and no larger than ``INLINE_BYTES``, else without text; what isn't inlined is still sent to a model from its bytes."""
    kinds = ((b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpeg"), (b"GIF87a", "gif"), (b"GIF89a", "gif"))
    kind = next((k for magic, k in kinds if content.startswith(magic)), "webp" if content[:4] == b"RIFF" and content[8:12] == b"WEBP" else None)
    if kind is None or len(content) > INLINE_BYTES:
        return [_block("", "image")]
    return [_block(f"![image](data:image/{kind};base64,{base64.b64encode(content).decode()})", "image")]


INLINE_BYTES = 256 << 10


def portable(content: bytes) -> list[Block]:
    """A paragraph block for each page of a PDF file that draws text."""
    return [_block(pdf.logical_tamil(text), page=no) for no, text in enumerate(pdf.pages(content), 1) if text]


_SKIP = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/", re.S)


def ddl_tables(sql: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of each CREATE TABLE statement; quoted text and comments are passed over."""
    bare = _SKIP.sub(lambda m: m[0] if m[0][0] == '"' else " " * len(m[0]), sql)
    out = []
    for m in re.finditer(r"(?i)\bcreate\s+(?:(?:global|local|temp|temporary|unlogged|external)\s+)*table\s+(?:if\s+not\s+exists\s+)?([\w.\"`\[\]]+)\s*\(", bare):
        depth, i = 1, m.end()
        while i < len(bare) and depth:
            depth += {"(": 1, ")": -1}.get(bare[i], 0)
            i += 1
        end = bare.find(";", i)
        out.append((m.start(), end + 1 if end >= 0 else len(sql), m[1].strip('"`[]')))
    return out


def ddl(content: bytes) -> list[Block]:
    text = content.decode(errors="replace")
    return [_block(text[a:b].strip(), "schema", path=[name]) for a, b, name in ddl_tables(text)]


def foreign_keys(sql: str) -> list[tuple[str, str]]:
    """(table, referenced table) of each REFERENCES clause."""
    return [(name, m[1].strip('"`[]')) for a, b, name in ddl_tables(sql) for m in re.finditer(r"(?i)\breferences\s+([\w.\"`\[\]]+)", _SKIP.sub(lambda m: m[0] if m[0][0] == '"' else " ", sql[a:b]))]


def references(text: str) -> list[tuple[str, str]]:
    """(part, part that it refers to) of each ``$ref`` in an OpenAPI or JSON-Schema text, by their names."""
    try:
        doc = json.loads(text)
    except ValueError:
        return []
    out = []
    for group in _GROUPS:
        for name, value in _parts(doc, group):
            found = re.findall(r'"\$ref":\s*"([^"]+)"', json.dumps(value))
            out += [(name, r.rstrip("/").split("/")[-1]) for r in found]
    return out


_GROUPS = (("paths",), ("components", "schemas"), ("definitions",), ("$defs",))


def _parts(doc: object, group: tuple[str, ...]) -> list[tuple[str, object]]:
    for k in group:
        doc = doc.get(k) if isinstance(doc, dict) else None
    return list(doc.items()) if isinstance(doc, dict) else []


def openapi(content: bytes) -> list[Block]:
    """The objects under paths, components.schemas, definitions and $defs, as they stand in the text."""
    text = content.decode(errors="replace")
    try:
        doc = json.loads(text)
    except ValueError:
        return [_block(text)] if text.strip() else []
    out: list[Block] = []
    for group in _GROUPS:
        at = max(0, text.find(json.dumps(group[-1])))
        for name, value in _parts(doc, group):
            found = _span(text, at, name, value)
            out.append(_block(text[slice(*found)] if found else json.dumps(value), "schema", path=[*group, name]))
            at = found[1] if found else at  # parts come in their order, so the text is gone through once a group
    return out


def _span(text: str, at: int, name: str, value: object) -> tuple[int, int] | None:
    decode = json.JSONDecoder().raw_decode
    for m in re.compile(re.escape(json.dumps(name)) + r"\s*:\s*").finditer(text, at):
        got, end = decode(text, m.end())
        if got == value:
            return m.start(), end
    return None


PARSERS: dict[str, Callable[[bytes], list[Block]]] = {"plain": plain, "txt": txt, "csv": table, "md": markdown, "html": html, "docx": docx, "pptx": pptx, "xlsx": xlsx, "code": code, "ddl": ddl, "openapi": openapi, "pdf": portable, "image": image}


def extract(documents: DataFrame, more: dict[str, Callable[[bytes], list[Block]]] | None = None) -> DataFrame:
    """Blocks of rows (document_id, content, source_type); null content has no block.

    A document that can't be parsed, or whose type has no parser, gives one row
    with ``error`` and no text, and stops no other. ``more``: parsers by type, before those of ``PARSERS``.
    """
    parsers = PARSERS | (more or {})

    def f(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for doc, content, kind in b.itertuples(index=False):
                if content is None:
                    continue
                if kind not in parsers:
                    rows.append((doc, None, None, None, None, None, None, None, f"no parser for {kind}"))
                    continue
                try:
                    found = parsers[kind](bytes(content))
                except Exception as e:  # whatever a damaged file makes a parser raise
                    rows.append((doc, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                for k, x in enumerate(found):
                    rows.append((doc, k, x["kind"], x["text"], x.get("level"), x.get("page"), x.get("path", []), x.get("cells", []), None))
            out = pd.DataFrame(rows, columns=["document_id", "block", "kind", "text", "level", "page", "path", "cells", "error"])
            yield out.astype({"block": "Int32", "level": "Int32", "page": "Int32"})

    return documents.select(F.col("document_id").cast("string"), F.col("content").cast("binary"), "source_type").mapInPandas(f, SCHEMA)


def to_markdown(blocks: DataFrame) -> DataFrame:
    """(document_id, markdown): blocks in order; neighbouring rows of one header form one table."""
    w = Window.partitionBy("document_id").orderBy("block")
    table_row = F.col("kind") == "table"
    new = table_row & ~(F.coalesce(F.lag("kind").over(w) == "table", F.lit(False)) & F.col("path").eqNullSafe(F.lag("path").over(w)))
    line = lambda c: F.concat(F.lit("| "), F.array_join(F.transform(c, lambda x: F.replace(x, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size("path")))
    body = (
        F.when(F.col("_new"), F.concat_ws("\n", line(F.col("path")), rule, line(F.col("cells"))))
        .when(table_row, line(F.col("cells")))
        .when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(1))), F.lit(" "), F.col("text")))
        .when(F.col("kind") == "code", F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```")))
        .otherwise(F.col("text"))
    )
    rows = blocks.withColumn("_new", new).select("document_id", "block", F.concat(F.when(table_row & ~F.col("_new"), F.lit("\n")).otherwise(F.lit("\n\n")), body).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda s: s["part"]), "")
    return rows.groupBy("document_id").agg(F.ltrim(joined, F.lit("\n")).alias("markdown"))
