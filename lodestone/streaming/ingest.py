"""Documents as a stream into the unit table; the manifest is written last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import state, units
from lodestone.sources.store import ObjectStore

SNAPSHOT = 32
"""Batches after which the manifest is written whole, so that a batch reads a snapshot and few parts, not all of history."""


def manifest_before(spark: SparkSession, folder: str, batch: int | None = None) -> DataFrame:
    """(doc_id, checksum, batch): the latest of each document, as of before a batch."""
    files = ObjectStore(spark, folder)
    last = {k: {int(x.split("part=")[1].split("/")[0]) for x in files.list(k) if "part=" in x} for k in ("snapshot", "manifest")}
    some = {k: sorted(n for n in v if batch is None or n < batch) for k, v in last.items()}
    base = some["snapshot"][-1:]
    paths = [f"{folder}/snapshot/part={n}" for n in base] + [f"{folder}/manifest/part={n}" for n in some["manifest"] if not base or n > base[0]]
    if not paths:
        return spark.createDataFrame([], "doc_id bigint, checksum string, batch bigint")
    rows = spark.read.schema("doc_id bigint, checksum string, batch bigint").parquet(*paths)
    return rows.groupBy("doc_id").agg(F.max_by("checksum", "batch").alias("checksum"), F.max("batch").alias("batch"))


def current_units(spark: SparkSession, folder: str) -> DataFrame:
    """Units of each document's latest version."""
    now = manifest_before(spark, folder).select(F.col("doc_id").cast("string").alias("document_id"), "batch")
    return spark.read.parquet(f"{folder}/units").drop("part").join(now, ["document_id", "batch"], "left_semi")


def take(batch: DataFrame, n: int, folder: str) -> None:
    """One batch: its changed documents' units, then their manifest rows. A batch that is run again overwrites its own files, so a replay changes nothing.

    Of several rows of a document the one with the greatest ``seq`` counts, or
    without such a column the last as they arrived.
    """
    spark = batch.sparkSession
    rows = batch.filter("doc_id IS NOT NULL").withColumn("checksum", state.checksum(F.coalesce("text", F.lit(""))))
    seq = F.col("seq") if "seq" in batch.columns else F.monotonically_increasing_id()
    newest = rows.withColumn("_seq", seq).groupBy("doc_id").agg(F.max_by(F.struct("text", "checksum"), F.struct("_seq", "checksum")).alias("r")).select("doc_id", "r.*")
    known = manifest_before(spark, folder, n)
    fresh = state.changed(newest, known)
    blocks = fresh.select(F.col("doc_id").cast("string").alias("document_id"), F.lit(0).alias("block"), "text")
    units.chunked(blocks.filter("text IS NOT NULL")).withColumn("batch", F.lit(n).cast("bigint")).write.mode("overwrite").parquet(f"{folder}/units/part={n}")
    fresh.select("doc_id", "checksum", F.lit(n).cast("bigint").alias("batch")).write.mode("overwrite").parquet(f"{folder}/manifest/part={n}")
    if n % SNAPSHOT == SNAPSHOT - 1:
        manifest_before(spark, folder, n + 1).write.mode("overwrite").parquet(f"{folder}/snapshot/part={n}")


def start(documents: DataFrame, folder: str) -> StreamingQuery:
    return documents.writeStream.foreachBatch(lambda df, n: take(df, n, folder)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
