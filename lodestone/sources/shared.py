"""The folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW = 200_000
"""Rows of keys and scores that are sent to every task, at most."""


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local session without one gets a temporary folder."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        given = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, given, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(given)
    return given


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint: what follows neither works them out again nor depends on one executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame) -> DataFrame:
    """The rows, cut; where there are no more than ``FEW`` a join sends them to the tasks, so that the other side, a table with its texts, stays where it lies."""
    held = cut(df)
    return F.broadcast(held) if held.count() <= FEW else held


def spread(df: DataFrame) -> DataFrame:
    """The rows over as many tasks as there are cores, where their files make fewer: a few small ones. Inputs with more are left as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
