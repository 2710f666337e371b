"""Text functions as Spark columns.

``tokens`` is the ASCII tokenizer and ``tokens_latin`` the Unicode one for Latin
text; both are JVM expressions. ``tokens_unicode`` is the general Unicode
tokenizer as an Arrow function: NFKC and case folding, runs of letters, numbers
and marks of one script, character pairs for scripts without spaces.
``tokens_any`` is the latter for every text, but hands over to Python only what
the JVM's can't tell.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lodestone.functions import tables as T

SUPPORTED = frozenset("arabic bengali cyrillic devanagari greek han hangul hebrew hiragana katakana latin tamil telugu thai".split())
CONTINUOUS = frozenset("han hiragana katakana khmer lao myanmar thai".split())

_BLOCKS = """
latin 41-5a 61-7a aa-aa ba-ba c0-2af 1e00-1eff ff21-ff3a ff41-ff5a
common 300-36f 1dc0-1dff 20d0-20ff
greek 370-3ff 1f00-1fff
cyrillic 400-52f
armenian 531-58f
hebrew 591-5f4
arabic 600-6ff 750-77f 870-8ff
devanagari 900-97f
bengali 980-9ff
gurmukhi a00-a7f
gujarati a80-aff
oriya b00-b7f
tamil b80-bff
telugu c00-c7f
kannada c80-cff
malayalam d00-d7f
sinhala d80-dff
thai e00-e7f
lao e80-eff
tibetan f00-fff
myanmar 1000-109f
georgian 10a0-10ff
hangul 1100-11ff 3130-318f ac00-d7af
khmer 1780-17ff
hiragana 3041-309f
katakana 30a0-30ff 31f0-31ff ff66-ff9f
han 3005-3007 3400-4dbf 4e00-9fff f900-faff 20000-2fa1f
"""
_RANGES = sorted((int(a, 16), int(b, 16), name) for name, *spans in map(str.split, _BLOCKS.strip().splitlines()) for a, b in (s.split("-") for s in spans))
_STARTS = [r[0] for r in _RANGES]


def script_of(ch: str) -> str:
    """Script of a character: ``common`` for digits and combining marks, ``unknown`` outside the table."""
    if "0" <= ch <= "9":
        return "common"
    k = bisect_right(_STARTS, ord(ch)) - 1
    return _RANGES[k][2] if k >= 0 and ord(ch) <= _RANGES[k][1] else "unknown"


def _is_word(ch: str) -> bool:
    return unicodedata.category(ch)[0] in "LNM"


def scripts_in(text: str) -> list[str]:
    return sorted({script_of(c) for c in text if _is_word(c)} - {"common"})


_ASCII_RUN = re.compile("[a-z0-9]+")


def tokenize(text: str) -> list[str]:
    """The Unicode tokenizer."""
    if text.isascii():
        return _ASCII_RUN.findall(text.lower())
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    out: list[str] = []
    run, script = "", "common"
    for ch in text + "\0":
        word = _is_word(ch)
        own = script_of(ch) if word else "common"
        if run and (not word or own != script and "common" not in (own, script)):
            if script in CONTINUOUS and len(run) > 1:
                out += [run[i : i + 2] for i in range(len(run) - 1)]
            elif script != "unknown":
                out.append(run)
            run, script = "", "common"
        if word:
            run += ch
            script = own if script == "common" else script
    return out


@F.pandas_udf(ArrayType(StringType()))
def tokens_unicode(text: pd.Series) -> pd.Series:
    return text.map(lambda t: tokenize(t or ""))


@F.pandas_udf(ArrayType(StringType()))
def scripts(text: pd.Series) -> pd.Series:
    return text.map(lambda t: scripts_in(t or ""))


def unsupported_scripts(text: Column) -> Column:
    return F.array_except(scripts(text), F.array(*[F.lit(s) for s in sorted(SUPPORTED)]))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def tokens_latin(text: Column) -> Column:
    """The Unicode tokenizer for Latin text: runs of letters, numbers and marks, with ß folded."""
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit(r"[\p{L}\p{N}\p{M}]+"), F.lit(0))


_BEYOND = "[\\u0080-\\u00bf\\u0130-\\u0140\\u0149\\u017f-\\u2012\\u2020-\\u2025\\u2027-\\x{10ffff}]"
"""All but ASCII, Latin letters that NFKC leaves alone and whose case folding is their lower case (but for ß), dashes, quotes and the ellipsis."""


def _latin(text: Column) -> tuple[Column, Column]:
    """Whether the JVM can't tell a text's tokens, and what they are where it can."""
    wide = F.octet_length(text) != F.char_length(text)
    beyond = F.coalesce(wide & text.rlike(_BEYOND), F.lit(False))
    latin = F.regexp_extract_all(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("[a-z0-9\\u00e0-\\u00f6\\u00f8-\\u017e]+"), F.lit(0))
    return beyond, F.when(wide, latin).otherwise(tokens(text))


def tokens_any(text: Column) -> Column:
    """The Unicode tokenizer. Other texts than plainly Latin ones go through Arrow; of the rest it is handed nulls. Texts of ASCII alone have a pattern of their own."""
    beyond, plain = _latin(text)
    return F.when(beyond, tokens_unicode(F.when(beyond, text))).otherwise(plain)


def tokens_or_text(text: Column) -> tuple[Column, Column]:
    """(tokens, rest), for a step that is in Python anyway: the tokens where the JVM can tell them, else the text for ``tokenize``; the other one is null."""
    beyond, plain = _latin(text)
    return F.when(~beyond, plain), F.when(beyond, text)


def words(items: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in sorted(items)])


def content(toks: Column) -> Column:
    """The distinct tokens that aren't stop words."""
    return F.array_except(F.array_distinct(toks), words(T.STOPWORDS))


def fold_plural(token: Column) -> Column:
    """Drops a final s of tokens of four letters and more, unless s, i or u stands before it."""
    plural = (F.length(token) >= 4) & token.endswith("s") & ~F.substring(token, -2, 1).isin("s", "i", "u")
    return F.when(plural, F.left(token, F.length(token) - 1)).otherwise(token)


def normal_number(raw: Column) -> Column:
    """Without separators, and without zeros at the end of a fraction."""
    plain = F.replace(raw, F.lit(","), F.lit(""))
    cut = F.when(plain.contains("."), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")).otherwise(plain)
    return F.when(cut == "", "0").otherwise(cut)


def slug(name: Column) -> Column:
    out = F.btrim(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "-"), F.lit("-"))
    return F.when(out == "", "page").otherwise(out)


def summary(text: Column, most: int = 240) -> Column:
    """The first characters of a text, ended by a full stop where it is cut."""
    t = F.trim(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(most - 1))), F.lit(".")))


def first_sentence(text: Column) -> Column:
    return F.regexp_extract(text, "^[^.!?]+", 0)


_SPACES = frozenset(" \t\n\r\f\v\u00a0\u3000")
_LONGEST = max(map(len, T.ABBREVIATIONS))


def _word_before(text: str, begin: int, end: int) -> str:
    """The word that ends there, in lower case; of one longer than any abbreviation only its end."""
    at = end
    while at > begin and end - at <= _LONGEST and text[at - 1] not in _SPACES:
        at -= 1
    return text[at:end].lower()


def split_claims(text: str) -> list[str]:
    """Sentences, split at runs of terminators and at line ends.

    No split between two digits, behind an abbreviation or a single letter, or
    at a Latin mark that no white space follows.
    """
    claims, begin, i, n = [], 0, 0, len(text)
    while i < n:
        ch = text[i]
        end = ch == "\n"
        if ch in T.TERMINATORS:
            run = i
            while i + 1 < n and text[i + 1] in T.TERMINATORS:
                i += 1
            after = text[i + 1] if i + 1 < n else ""
            before = text[i - 1] if i else ""
            last = _word_before(text, begin, run)
            decimal = before in set("0123456789") and after in set("0123456789")
            short = last in T.ABBREVIATIONS or len(last) == 1 and last.isalpha()
            glued = after != "" and after not in _SPACES and ch in ".!?"
            end = not (decimal or short or glued)
        i += 1
        if end:
            if claim := text[begin:i].strip():
                claims.append(claim)
            begin = i
    if claim := text[begin:].strip():
        claims.append(claim)
    return claims


@F.pandas_udf(ArrayType(StringType()))
def claims(text: pd.Series) -> pd.Series:
    return text.map(lambda t: split_claims(t or ""))


_BREAKS = [re.compile(r"\n[ \t]*\n+"), re.compile(r"\n+"), re.compile(r"(?<=[.!?])\s+")]


def chunk(text: str, most: int = 450, overlap: int = 60) -> list[str]:
    """Pieces of a text of about ``most`` words: split at paragraphs, else lines, sentences, words; packed greedily, the tail repeated within ``overlap`` words."""
    if most < 1:
        raise ValueError("a chunk holds a word at least")
    text = text.strip()
    if not text:
        return []
    if len(text.split()) <= most:
        return [text]
    overlap = max(0, min(overlap, most - 1))
    parts: list[str] = []
    stack = [text]
    while stack:
        t = stack.pop()
        if len(t.split()) <= most:
            parts.append(t)
            continue
        pieces = next((p for b in _BREAKS if len(p := [x.strip() for x in b.split(t) if x.strip()]) > 1), t.split())
        stack += reversed(pieces)
    out: list[str] = []
    held: list[tuple[str, int]] = []
    for p in parts:
        n = len(p.split())
        if held and sum(k for _, k in held) + n > most:
            out.append("\n".join(x for x, _ in held))
            tail: list[tuple[str, int]] = []
            while held and sum(k for _, k in tail) + held[-1][1] <= overlap:
                tail.insert(0, held.pop())
            held = tail
        held.append((p, n))
    return [*out, "\n".join(x for x, _ in held)] if held else out


def chunks(most: int = 450, overlap: int = 60):
    @F.pandas_udf(ArrayType(StringType()))
    def f(text: pd.Series) -> pd.Series:
        return text.map(lambda t: chunk(t or "", most, overlap))

    return f
