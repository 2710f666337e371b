"""Claims against passages: coverage, the ordered gate, and the report on citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import gate as G
from lodestone.functions import text as X
from lodestone.sources.shared import cut


def coverage_pairs(claims: DataFrame, docs: DataFrame, least: float = 1.0) -> DataFrame:
    """(claim_id, doc_id, coverage) of all pairs in which the text holds at least ``least`` of the claim's content tokens.

    Exact, without comparing all pairs: a text that covers the share must hold
    one of the claim's few rarest tokens, so only texts with one of these are
    held against the claim. Texts are read once: what they hold of the claims'
    tokens is cut. A claim without content tokens is covered by nothing.
    """
    if not 0 < least <= 1:
        raise ValueError("the least coverage lies above 0 and is 1 at most")
    c = claims.select("claim_id", X.content(X.tokens_any(F.col("claim"))).alias("c")).filter(F.size("c") > 0)
    terms = c.select("claim_id", F.size("c").alias("n"), F.explode("c").alias("term"))
    d = docs.select("doc_id", F.explode(F.array_distinct(X.tokens_any(F.col("text")))).alias("term"))
    found = cut(d.join(terms.select("term").distinct(), "term", "left_semi").distinct())
    freq = found.groupBy("term").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("claim_id").orderBy(F.coalesce("df", F.lit(0)), "term")
    keys = F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)) + 1
    rare = terms.join(freq, "term", "left").withColumn("r", F.row_number().over(rarest)).filter(F.col("r") <= keys).select("claim_id", "term")
    candidates = rare.join(found, "term").select("claim_id", "doc_id").distinct()
    shared = candidates.join(terms, "claim_id").join(found, ["doc_id", "term"]).groupBy("claim_id", "doc_id").agg((F.count("*") / F.first("n")).alias("share"))
    pairs = shared.select("claim_id", "doc_id", F.round("share", 6).alias("coverage"))
    return pairs.filter(F.col("coverage") >= F.round(F.lit(least), 6))


def claim_rows(items: DataFrame) -> DataFrame:
    """(item_id, position, claim) of each text."""
    return items.select("item_id", F.posexplode(X.claims(F.col("text"))).alias("position", "claim"))


def gated(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """(claim_id, doc_id) of the claims that a text supports in order; tokens must be contained for that, so coverage goes first."""
    pairs = coverage_pairs(claims, docs).join(claims.select("claim_id", "claim"), "claim_id").join(docs.select("doc_id", "text"), "doc_id")
    return pairs.filter(G.supported_udf("claim", "text")).select("claim_id", "doc_id")


def verify(claims: DataFrame, cited: DataFrame) -> DataFrame:
    """(claim_id, doc_id, supported, n_missing): for each claim the first citation that contains it, else the one that lacks the fewest tokens.

    ``cited``: (claim_id, doc_id, text, rank).
    """
    c = claims.select("claim_id", X.content(X.tokens_any(F.col("claim"))).alias("c"))
    lacking = F.size(F.array_except("c", X.tokens_any(F.col("text"))))
    each = cited.join(c, "claim_id").select("claim_id", "doc_id", "rank", lacking.cast("bigint").alias("n_missing"), ((lacking == 0) & (F.size("c") > 0)).alias("supported"))
    best = F.min_by(F.struct("doc_id", "supported", "n_missing"), F.struct(~F.col("supported"), "n_missing", "rank"))
    return each.groupBy("claim_id").agg(best.alias("b")).select("claim_id", "b.*")
