"""Cost and quality over an event log of (stage, document, partition, tokens, cost, outcome)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATES = {"click": 0.02, "purchase": 0.5, "signup": 0.0}
"""Price of 1,000 tokens by stage; a stage without a rate keeps the cost that its events carry."""


def from_log(events: DataFrame) -> DataFrame:
    """The driver's events as stage events."""
    return events.select(
        F.col("event_type").alias("stage"),
        F.get_json_object("props", "$.k").alias("document"),
        F.col("user_id").alias("partition"),
        F.col("value").alias("tokens"),
        (F.col("value") * 0.0001).alias("cost"),
        F.when(F.col("event_type") == "error", "verify_failed").when(F.col("event_type") == "signup", "refused").otherwise("ok").alias("outcome"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def cost(rates: Mapping[str, float] = RATES) -> Column:
    c = F.coalesce("cost", F.lit(0.0))
    for stage, rate in rates.items():
        c = F.when(F.col("stage") == stage, F.col("tokens") / 1000 * rate).otherwise(c)
    return c


def rollup(events: DataFrame, *keys: str, rates: Mapping[str, float] = RATES) -> DataFrame:
    """Cost summed by the keys; rows with a null key are skipped."""
    for k in keys:
        events = events.filter(F.col(k).isNotNull())
    return events.groupBy(*keys).agg(F.round(F.sum(cost(rates)), 4).alias("cost"), F.count("*").alias("n"))


def quality(events: DataFrame) -> DataFrame:
    """One row: refusals, failed verifications, events that verify, the share of these that passed (1 if there are none)."""
    verify = F.col("stage").isin("error", "purchase")
    ok = F.count_if(verify & (F.col("outcome") == "ok"))
    return events.agg(
        F.count_if(F.col("outcome") == "refused").alias("refusals"),
        F.count_if(F.col("outcome") == "verify_failed").alias("verify_failures"),
        F.count_if(verify).alias("claims"),
        F.round(F.coalesce(ok / F.nullif(F.count_if(verify), F.lit(0)), F.lit(1.0)), 6).alias("groundedness"),
    )
