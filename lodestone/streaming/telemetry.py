"""Cost and quality of an event log as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import telemetry
from lodestone.sources.shared import shared_folder


def windows(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Cost by stage and window of event time; rows later than the watermark are dropped."""
    log = telemetry.from_log(events).withWatermark("ts", late)
    return log.groupBy(F.window("ts", width).alias("w"), "stage").agg(F.sum(telemetry.cost()).alias("cost"), F.count("*").alias("n")).select("w.start", "w.end", "stage", "cost", "n")


def cost_by_stage(spark: SparkSession, path: str) -> DataFrame:
    """What a stream over the log at ``path`` comes to once all of it is read.

    The totals are written whole at each trigger, under the trigger's number: one that is run again writes the same place.
    """
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("recursiveFileLookup", "true").parquet(path[:-1] + "[" + path[-1] + "]")
    totals = telemetry.from_log(source).groupBy("stage").agg(F.round(F.sum(telemetry.cost()), 4).alias("cost"), F.count("*").alias("n"))
    last = {"at": None}

    def save(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/{n}")
        last["at"] = f"{folder}/{n}"

    totals.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    if last["at"] is None:
        return telemetry.rollup(telemetry.from_log(spark.read.parquet(path)), "stage")
    return spark.read.parquet(last["at"])
