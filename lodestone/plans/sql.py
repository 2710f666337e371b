"""Pieces of the SQL that queries are held against."""

from __future__ import annotations

from lodestone.functions import tables as T


def listed(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"


STOP = listed(T.STOPWORDS)


def ascii_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(replace(lower({x}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}\\p{{M}}]+')"


def content(toks: str) -> str:
    return f"list_filter(list_distinct({toks}), lambda w: w NOT IN {STOP})"


def strings(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"


def fold(w: str) -> str:
    return f"CASE WHEN length({w}) >= 4 AND right({w}, 1) = 's' AND substring({w}, length({w}) - 1, 1) NOT IN ('s', 'i', 'u') THEN left({w}, length({w}) - 1) ELSE {w} END"


def meaning(toks: str) -> str:
    """The folded content tokens that contradictions are judged by."""
    kept = f"list_filter({content(toks)}, lambda w: w NOT IN {listed(T.NEGATIONS)} AND NOT regexp_full_match(w, '[0-9]+[a-z]*') AND NOT (regexp_matches(w, '[0-9]') AND regexp_matches(w, '[^a-z0-9]')))"
    return f"list_distinct(list_transform({kept}, lambda w: {fold('w')}))"


def numbers(x: str) -> str:
    raw = f"list_transform(regexp_extract_all(lower({x}), '(?:^|[^\\p{{L}}_0-9.,])([0-9][0-9,]*(?:\\.[0-9]+)?)', 1), lambda w: replace(w, ',', ''))"
    cut = "CASE WHEN contains(w, '.') THEN rtrim(rtrim(w, '0'), '.') ELSE w END"
    return f"list_sort(list_distinct(list_transform({raw}, lambda w: CASE WHEN {cut} = '' THEN '0' ELSE {cut} END)))"


FIRST = "regexp_extract(text, '^[^.!?]+')"
LAST = "coalesce(list_filter(regexp_extract_all(text, '[^.!?]+'), lambda s: trim(s) <> '')[-1], '')"


def questions(how: str = FIRST) -> str:
    return f"(SELECT item_id AS question_id, {how} AS question FROM benchmark)"


def bm25(q: str, k: int) -> str:
    return f"""(
WITH toks AS (SELECT doc_id, {tokens("text")} AS t FROM documents),
stats AS (SELECT count(*) AS n, avg(len(t)) AS a FROM toks),
terms AS (SELECT DISTINCT question_id, unnest({tokens("question")}) AS term FROM {q}),
postings AS (SELECT doc_id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM toks) GROUP BY doc_id, term),
freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
scored AS (SELECT question_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a)))), 6) AS score
  FROM terms JOIN freq USING (term) JOIN postings USING (term), stats GROUP BY question_id, doc_id)
SELECT question_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {k})"""


def fused(k: int) -> str:
    return f"""(
WITH lists AS (SELECT 0 AS list, * FROM {bm25(questions(), k)} UNION ALL SELECT 1, * FROM {bm25(questions(LAST), k)}),
f AS (SELECT question_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, first(list ORDER BY score DESC, list) AS best_list FROM lists GROUP BY question_id, doc_id)
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM f)"""
