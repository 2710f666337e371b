"""Text of PDF files, a block a page, by the standard library alone.

Objects are found in the file itself and in its object streams; streams may be
plain, Flate or hexadecimal. Text is drawn by the show operators, in the order
of the page's stream; a font's ToUnicode map gives the characters, else they are
read as Windows-1252. A move of the text's place down the page starts a new line.
Encrypted files are an error.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"(<<.*?>>)\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?[\d.]+|[A-Za-z'\"*]+|<<|>>", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _decoded(head: bytes, data: bytes) -> bytes:
    if b"ASCIIHexDecode" in head:
        data = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", data).decode())
    if b"FlateDecode" in head:
        data = zlib.decompressobj().decompress(data)
    return data


def _objects(content: bytes) -> dict[int, tuple[bytes, bytes | None]]:
    """Dictionary and stream of each object."""
    out: dict[int, tuple[bytes, bytes | None]] = {}
    for m in _OBJECT.finditer(content):
        body = m[3]
        s = _STREAM.search(body)
        out[int(m[1])] = (s[1], s[2]) if s else (body, None)
    for head, data in list(out.values()):
        if data is not None and b"/ObjStm" in head:
            raw = _decoded(head, data)
            first = int(re.search(rb"/First\s+(\d+)", head)[1])
            marks = [int(x) for x in raw[:first].split()]
            starts = marks[1::2]
            for k, n in enumerate(marks[::2]):
                end = starts[k + 1] if k + 1 < len(starts) else len(raw) - first
                out[n] = (raw[first + starts[k] : first + end], None)
    return out


def _pages(objects: dict[int, tuple[bytes, bytes | None]]) -> list[bytes]:
    """Dictionaries of the pages, in the order of the tree."""
    heads = {n: h for n, (h, _) in objects.items()}
    roots = [n for n, h in heads.items() if re.search(rb"/Type\s*/Catalog\b", h)]
    out: list[bytes] = []
    seen: set[int] = set()

    def walk(n: int, inherited: bytes) -> None:
        if n in seen or n not in heads:
            return
        seen.add(n)
        h = heads[n]
        if b"/Resources" not in h:
            h += inherited
        kids = re.search(rb"/Kids\s*\[(.*?)\]", h, re.S)
        if kids:
            own = re.search(rb"/Resources\s+\d+\s+\d+\s+R|/Resources\s*<<.*?>>\s*>>", h, re.S)
            for k in _REF.findall(kids[1]):
                walk(int(k), own[0] if own else b"")
        else:
            out.append(h)

    for r in roots:
        if m := re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", heads[r]):
            walk(int(m[1]), b"")
    return out or [h for h in heads.values() if re.search(rb"/Type\s*/Page\b", h)]


def _literal(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1]).decode()
        return bytes.fromhex(digits + "0" * (len(digits) % 2))
    out, i, body = bytearray(), 0, token[1:-1]
    while i < len(body):
        ch = body[i : i + 1]
        if ch != b"\\":
            out += ch
            i += 1
        elif m := re.match(rb"\\([0-7]{1,3})", body[i:]):
            out.append(int(m[1], 8) & 255)
            i += len(m[0])
        else:
            nxt = body[i + 1 : i + 2]
            out += b"" if nxt in (b"\n", b"\r") else _ESCAPES.get(nxt, nxt)
            i += 2
    return bytes(out)


def _cmap(raw: bytes) -> tuple[dict[int, str], int]:
    """Characters by code, and the bytes of a code."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out: dict[int, str] = {}
    width = 1
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", raw, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            width = max(width, len(a) // 2)
            out[int(a, 16)] = text(b)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", raw, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            width = max(width, len(a) // 2)
            begin = text(c)
            for k in range(int(b, 16) - int(a, 16) + 1):
                out[int(a, 16) + k] = begin[:-1] + chr(ord(begin[-1]) + k)
        for a, listed in re.findall(rb"<([0-9A-Fa-f]+)>\s*<[0-9A-Fa-f]+>\s*\[(.*?)\]", part, re.S):
            width = max(width, len(a) // 2)
            for k, c in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", listed)):
                out[int(a, 16) + k] = text(c)
    return out, width


def _fonts(page: bytes, objects: dict[int, tuple[bytes, bytes | None]]) -> dict[bytes, tuple[dict[int, str], int]]:
    res = page
    if m := re.search(rb"/Resources\s+(\d+)\s+\d+\s+R", page):
        res += objects.get(int(m[1]), (b"", None))[0]
    if m := re.search(rb"/Font\s+(\d+)\s+\d+\s+R", res):
        res += b" /Font <<" + objects.get(int(m[1]), (b"", None))[0] + b">>"
    out = {}
    for listed in re.findall(rb"/Font\s*<<(.*?)>>", res, re.S):
        for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", listed):
            head = objects.get(int(n), (b"", None))[0]
            if u := re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", head):
                h, data = objects.get(int(u[1]), (b"", None))
                if data is not None:
                    out[name] = _cmap(_decoded(h, data))
    return out


def _drawn(stream: bytes, fonts: dict[bytes, tuple[dict[int, str], int]]) -> str:
    lines: list[str] = [""]
    font: tuple[dict[int, str], int] | None = None
    stack: list[bytes] = []
    height: float | None = None

    def say(token: bytes) -> None:
        raw = _literal(token)
        if font:
            held, width = font
            lines[-1] += "".join(held.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))
        else:
            lines[-1] += raw.decode("cp1252", "replace")

    number = lambda t: float(t) if re.fullmatch(rb"[-+]?\d*\.?\d+|[-+]?\d+\.", t) else 0.0
    for t in _TOKEN.findall(stream):
        if not t[:1].isalpha() and t not in (b"'", b'"', b"T*"):
            stack.append(t)
            continue
        if t in (b"Tj", b"'", b'"'):
            if t != b"Tj":
                lines.append("")
            if stack and stack[-1][:1] in b"(<":
                say(stack[-1])
        elif t == b"TJ":
            begin = max((i for i, x in enumerate(stack) if x == b"["), default=-1)
            for x in stack[begin + 1 :]:
                if x[:1] in b"(<" and x != b"<<":
                    say(x)
                elif x != b"]" and number(x) < -200:  # a gap as wide as a space
                    lines[-1] += " "
        elif t == b"Tf" and len(stack) >= 2:
            font = fonts.get(stack[-2][1:])
        elif t in (b"Td", b"TD") and len(stack) >= 2:
            if number(stack[-1]):
                lines.append("")
            elif lines[-1] and number(stack[-2]):
                lines[-1] += " "
        elif t == b"Tm" and len(stack) >= 6:
            at = number(stack[-1])
            if height is not None and at != height:
                lines.append("")
            height = at
        elif t in (b"T*", b"BT"):
            lines.append("")
        stack = []
    return "\n".join(x for x in (re.sub(r"[ \t]+", " ", x).strip() for x in lines) if x)


def pages(content: bytes) -> list[str]:
    """The text of each page, in order; empty for a page that draws none."""
    if not content.lstrip().startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
        raise ValueError("the file is encrypted")
    objects = _objects(content)
    out = []
    for page in _pages(objects):
        m = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
        streams = [objects.get(int(n), (b"", None)) for n in _REF.findall(m[1])] if m else []
        body = b"\n".join(_decoded(h, d) for h, d in streams if d is not None)
        out.append(_drawn(body, _fonts(page, objects)))
    return out


_LEFT = "\u0bc6\u0bc7\u0bc8"
_JOINED = (("\u0bc6\u0bbe", "\u0bca"), ("\u0bc7\u0bbe", "\u0bcb"), ("\u0bc6\u0bd7", "\u0bcc"))
_CLUSTER = re.compile("([\u0bc6-\u0bc8])([\u0b95-\u0bb9](?:\u0bcd[\u0b95-\u0bb9])*)")


def logical_tamil(text: str) -> str:
    """Tamil text whose vowel signs stand where they are drawn, before their consonants, put in the order of its letters.

    Only where a sign stands that no consonant precedes, which no text in the
    order of its letters has; other texts come back as they are.
    """
    if not any(ch in _LEFT and not (i and "\u0b95" <= text[i - 1] <= "\u0bb9") for i, ch in enumerate(text)):
        return text
    text = _CLUSTER.sub(r"\2\1", text)
    for parts, whole in _JOINED:
        text = text.replace(parts, whole)
    return text
