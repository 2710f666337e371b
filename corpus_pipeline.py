"""A training corpus from the documents: five stages, each an operator of ``lodestone.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows as Parquet in the folder that all executors share and reads
them again as the next one's documents. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import importance, language, mixing, packing, simhash
from lodestone.llm.common import checkpoint_dir, remove
from lodestone.sources.shared import spread


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language that the network tells. Null and empty texts go; see ``language.identify`` for ties and long texts. An empty table stays empty; other columns pass as they are."""
    return language.accepted(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that importance resampling towards the labelled good ones draws. Without a good label all stay; repeated rows and ties with the last one drawn are drawn together; see ``importance.sample`` for nulls and long texts. An empty table stays empty."""
    return importance.resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one of the least doc_id, of repeated rows one; null texts count as empty ones and are copies of each other. See ``simhash.one_of_each``. An empty table stays empty."""
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps half of the tokens, in the order of the mixture, by the weights ``mixing.TARGET`` and, for sources that these don't name, a null one among them, ``mixing.OTHERS``. Null and empty texts are free; repeated rows count each; see ``mixing.mixture`` for ties. An empty table stays empty."""
    return mixing.mixed(docs, mixing.TARGET, others=mixing.OTHERS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, by length; texts without a word have none. See ``packing.pieces``."""
    return packing.packed(docs)


STAGES = [("language_id", language_id), ("quality_classifier", quality), ("simhash_near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]

ORACLE_SQL = None
"""SQL can express neither the network nor the fingerprints; ``tests/llm/test_pipeline.py`` holds each stage's rows against a plain version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's folder is removed once the next one's is written; the last one's stays, as the rows are read from it."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    before = None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before is not None:
            remove(spark, before)
        before = out
    return docs
