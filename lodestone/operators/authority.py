"""Standing of sources: order and floor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("strict", "normal", "exploratory")


def ranked(candidates: DataFrame, tiers: DataFrame) -> DataFrame:
    """Adds ``tier_rank``, -1 for documents of unknown standing; ``tiers``: (doc_id, tier_rank)."""
    return candidates.join(tiers, "doc_id", "left").withColumn("tier_rank", F.coalesce("tier_rank", F.lit(-1)))


def select(candidates: DataFrame, tiers: DataFrame, mode: str = "normal", floor: int | None = None) -> DataFrame:
    """Adds ``place``: in exploratory mode the order as it is, else by standing and then as it is; in strict mode those below the floor go."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    rows = ranked(candidates, tiers)
    if mode == "strict" and floor is not None:
        rows = rows.filter(F.col("tier_rank") >= floor)
    by = [F.col("rank")] if mode == "exploratory" else [F.desc("tier_rank"), F.col("rank")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(*by)).cast("bigint"))


def encode(**fields: Column) -> Column:
    """Metadata as JSON with its keys in order; nulls are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def decode(meta: Column) -> Column:
    """A map of texts; empty for what is null, blank or no JSON object."""
    return F.coalesce(F.from_json(meta, "map<string,string>"), F.create_map().cast("map<string,string>"))


def tier_of(meta: Column, key: str, order: Sequence[str]) -> Column:
    """(name, rank): the tier that the metadata names under ``key``, its rank the place in ``order``; a tier that isn't in it, or none, ranks -1."""
    name = F.coalesce(F.get(F.array(*[F.lit(k) for k in order]), F.array_position(F.array(*[F.lit(k) for k in order]), decode(meta)[key]).cast("int") - 1), F.lit("unranked"))
    rank = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in order]), decode(meta)[key]), F.lit(0)).cast("int") - 1
    return F.struct(name.alias("name"), rank.alias("rank"))


def floor_rank(floor: str, order: Sequence[str]) -> int:
    """The rank of a floor by name; an unknown name is an error, for it would hold back nothing."""
    if floor not in order:
        raise ValueError(f"unknown floor {floor}")
    return order.index(floor)


def weakest(cited: DataFrame) -> DataFrame:
    """(question_id, tier): the lowest tier among (question_id, doc_id, tier_rank) that a question's answer rests on."""
    return cited.groupBy("question_id").agg(F.min("tier_rank").alias("tier"))
