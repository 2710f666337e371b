"""Navigation pages: one a document group, with summary, keywords and references."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.retrieval import top

KEYWORDS, SUMMARY = 12, 240


def pages(units: DataFrame) -> DataFrame:
    """(page_id, title, summary, keywords, n_units) from rows (page_id, unit, text).

    A summary has 240 characters at most, and each text adds one at least, so
    the first 240 texts by unit, cut to that length, are enough for it.
    """
    some = units.filter(F.trim("text") != "").select("page_id", "unit", F.left("text", F.lit(SUMMARY + 1)).alias("x"))
    early = some.withColumn("r", F.row_number().over(Window.partitionBy("page_id").orderBy("unit"))).filter(F.col("r") <= SUMMARY)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "x"))), lambda s: s["x"]), " ")
    summary = early.groupBy("page_id").agg(X.summary(joined, SUMMARY).alias("summary"))
    tf = units.select("page_id", F.explode(X.tokens(F.col("text"))).alias("term")).filter(~F.col("term").isin(*sorted(X.T.STOPWORDS))).groupBy("page_id", "term").agg(F.count("*").alias("score"))
    words = top(tf, KEYWORDS, "page_id", "term").groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("keywords"))
    n = units.groupBy("page_id").agg(F.count("*").alias("n_units"))
    return n.join(summary, "page_id", "left").join(words, "page_id", "left").select("page_id", F.col("page_id").alias("title"), "summary", "keywords", "n_units")


def retrieve(questions: DataFrame, page: DataFrame, links: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """Candidates by hits on keywords, title and summary of their page, or half the hits of a page that links to it."""
    q = questions.select("question_id", F.explode(X.content(X.tokens(F.col("question")))).alias("term"))
    terms = F.array_distinct(F.concat(F.coalesce("keywords", F.array().cast("array<string>")), X.tokens(F.col("title")), X.tokens(F.coalesce("summary", F.lit("")))))
    hits = page.select("page_id", F.explode(terms).alias("term")).join(q, "term").groupBy("question_id", "page_id").agg(F.count("*").cast("double").alias("score"))
    linked = hits.join(links, "page_id").select("question_id", F.col("target").alias("page_id"), (F.col("score") / 2).alias("score"))
    best = hits.unionByName(linked).groupBy("question_id", "page_id").agg(F.max("score").alias("score"))
    # of a page only its first k units can be among the k best
    first = units.withColumn("r", F.row_number().over(Window.partitionBy("page_id").orderBy("unit"))).filter(F.col("r") <= k).select("page_id", F.col("unit").alias("doc_id"))
    return top(best.join(first, "page_id").groupBy("question_id", "doc_id").agg(F.max("score").alias("score")), k)


def lint(page: DataFrame, links: DataFrame, refs: DataFrame, units: DataFrame) -> DataFrame:
    """(issue, page_id, ref): links without a target, pages that nothing links to, references to units that don't exist."""
    known = page.select("page_id")
    dangling = links.join(known.withColumnRenamed("page_id", "target"), "target", "left_anti").select(F.lit("dangling_link").alias("issue"), "page_id", F.col("target").alias("ref"))
    orphan = known.join(links.select(F.col("target").alias("page_id")), "page_id", "left_anti").select(F.lit("orphan_page").alias("issue"), "page_id", F.lit(None).cast("string").alias("ref"))
    missing = refs.join(units.select(F.col("unit").alias("ref")), "ref", "left_anti").select(F.lit("missing_unit").alias("issue"), "page_id", F.col("ref").cast("string").alias("ref"))
    return dangling.unionByName(orphan).unionByName(missing)


def light(page: DataFrame, links: DataFrame) -> DataFrame:
    """(page_id, title, summary, keywords, links): what a search reads of all pages; references stay with the pages."""
    out = links.groupBy("page_id").agg(F.array_sort(F.collect_set("target")).alias("links"))
    return page.select("page_id", "title", "summary", "keywords").join(out, "page_id", "left").withColumn("links", F.coalesce("links", F.array().cast("array<string>")))


def upsert(page: DataFrame, new: DataFrame) -> DataFrame:
    """Pages, new ones in the place of those of the same id."""
    return page.join(new.select("page_id"), "page_id", "left_anti").unionByName(new)


def integrate(page: DataFrame, units: DataFrame) -> DataFrame:
    """Pages with those of the given units' groups made anew; other pages aren't read. ``units``: (page_id, unit, text), all of each group."""
    return upsert(page, pages(units))


def remove(page: DataFrame, gone: DataFrame) -> DataFrame:
    """Pages without those of (page_id); one that isn't there changes nothing."""
    return page.join(gone.select("page_id"), "page_id", "left_anti")


def sane(page: DataFrame, units: DataFrame) -> DataFrame:
    """A model's pages (page_id, title, summary, keywords, links, refs) as they may be kept: those with an id and a title, links without brackets, references to units that exist only."""
    some = page.filter((F.trim(F.coalesce("page_id", F.lit(""))) != "") & (F.trim(F.coalesce("title", F.lit(""))) != ""))
    some = some.select(F.trim("page_id").alias("page_id"), F.trim("title").alias("title"), F.trim(F.coalesce("summary", F.lit(""))).alias("summary"), "keywords", F.transform("links", lambda x: F.btrim(x, F.lit("[]"))).alias("links"), "refs")
    held = some.select("page_id", F.explode("refs").alias("unit")).join(units.select(F.col("unit").cast("string")), "unit", "left_semi").groupBy("page_id").agg(F.array_sort(F.collect_set("unit")).alias("refs"))
    return some.drop("refs").join(held, "page_id", "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<string>")))


CORPUS_CHARS, UNIT_CHARS = 24_000, 500
"""What one model call gets to see, and of each unit: the call's limit, not the table's; pages beyond it are made without a model."""


def distil(units: DataFrame, model: Callable[[str], list[dict]] | None) -> DataFrame:
    """Pages by a model, one call a page over as much as it can be shown; a page whose call fails, or has no model, is made without one. ``units``: (page_id, unit, text)."""
    plain = pages(units)
    if model is None:
        return plain
    shown = units.withColumn("r", F.row_number().over(Window.partitionBy("page_id").orderBy("unit"))).filter(F.col("r") <= CORPUS_CHARS // UNIT_CHARS)
    prompt = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(": ", F.col("unit").cast("string"), F.left("text", F.lit(UNIT_CHARS))).alias("t")))), lambda s: s["t"]), "\n")

    def f(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for page_id, text in b[["page_id", "prompt"]].itertuples(index=False):
                try:
                    rows += [(page_id, p.get("title"), p.get("summary"), p.get("keywords") or []) for p in model(text) if p.get("title")]
                except Exception:  # the page without a model stands in
                    continue
            yield pd.DataFrame(rows, columns=["page_id", "title", "summary", "keywords"])

    told = shown.groupBy("page_id").agg(prompt.alias("prompt")).mapInPandas(f, "page_id string, title string, summary string, keywords array<string>")
    told = told.dropDuplicates(["page_id"]).join(plain.select("page_id", "n_units"), "page_id")
    return upsert(plain, told.select(plain.columns))
