"""The queries of this subpackage, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import importance, language, mixing, packing, repetition, sharding, simhash, tokencount, vectors, warc
from lodestone.sources.shared import spread

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def _on(name: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(table(spark, sf_dir, name))


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": _on("documents", lambda docs: mixing.mixture(docs, mixing.TARGET, others=mixing.OTHERS)),
        "op2_sharding": _on("documents", sharding.shards),
        "op3_packing": _on("documents", packing.packed),
        "op4_language_id": _on("documents", language.identify),
        "op5_quality_rules": _on("documents", repetition.rules),
        "op6_embedding_near_dedup": _on("embeddings", vectors.groups),
        "op7_warc": _on("pages", warc.frames),
        "op8_simhash_near_dedup": _on("documents", simhash.duplicates),
        "op9_token_counts": _on("documents", tokencount.counts),
        "op10_quality_classifier": lambda spark, sf_dir: importance.sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.oracle(),
        "op2_sharding": sharding.oracle(),
        "op3_packing": packing.oracle(),
        "op6_embedding_near_dedup": vectors.oracle(),
    }
