"""Sharding by proportional stratified interleaving.

Rows of a source, in a seeded random order, get the fractional rank
(rank - 1/2) / rows of the source. In the order of that rank every stretch of
the corpus holds the sources in the proportions of the whole; the order is cut
in shards of equal numbers of rows.

Both ranks are running counts by ranges of the order (see ``common.ranged``):
no task holds a source or the corpus. Rows that are equal in id and source are
told apart by a number of their own, so many of them are spread as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, ranged, running
from lodestone.llm.mixing import shuffle_key

SEED = "shard-1"
SHARDS = 64


def shards(docs: DataFrame, n: int = SHARDS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, fraction, position, shard) of all rows; positions from 0, shards from 0 to n - 1, their sizes differ by one at most.

    A null source is a stratum of its own; null, empty or long texts play no
    part; repeated rows count each. Ties in the fractional rank go by source,
    shuffle key and doc_id. With fewer rows than shards some shards are empty,
    and with none all. Other columns are not read, so their names can't clash.
    """
    if n < 1:
        raise ValueError("there must be a shard")
    df = cut(docs.select("doc_id", "source", F.lit(1).cast("bigint").alias("_one"), shuffle_key(seed, "doc_id").alias("_key"), F.monotonically_increasing_id().alias("_row")))
    within = [F.col("_key"), F.col("doc_id"), F.col("_row")]
    df = running(ranged(df, [F.col("source"), *within]), "_one", within, F.col("_piece"), ["source"], "_rank")
    counts = docs.groupBy(F.col("source").alias("_of")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"))
    df = df.join(counts, F.col("source").eqNullSafe(F.col("_of"))).crossJoin(F.broadcast(total))  # one row
    df = cut(df.withColumn("fraction", (F.col("_rank").cast("double") - 0.5) / F.col("_n").cast("double")))
    order = [F.col("fraction"), F.col("source"), *within]
    df = running(ranged(df, order), "_one", order, F.col("_piece"), out="_position")
    position = F.col("_position") - 1
    return df.select("doc_id", "source", "fraction", position.alias("position"), F.expr(f"cast((_position - 1) * {n} div _total as int)").alias("shard"))


def oracle(documents: str = "documents", n: int = SHARDS, seed: str = SEED) -> str:
    return f"""
WITH keyed AS (SELECT doc_id, source, md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM {documents}),
ranked AS (SELECT *, (CAST(row_number() OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST) AS DOUBLE) - 0.5) / CAST(count(*) OVER (PARTITION BY source) AS DOUBLE) AS fraction FROM keyed),
placed AS (SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, k, doc_id NULLS FIRST) - 1 AS position FROM ranked)
SELECT doc_id, source, fraction, position, CAST(position * {n} // (SELECT count(*) FROM {documents}) AS INTEGER) AS shard FROM placed"""
