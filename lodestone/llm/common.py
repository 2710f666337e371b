"""What several operators share: lineage cuts, distributed ranks, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS = "[^ \t\n\r\f]+"
"""A whitespace word, in a form that Java and RE2 read alike."""


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a temporary folder; a cluster must name one.
    """
    conf = spark.sparkContext.getConf()
    given = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        given = tempfile.mkdtemp(prefix="checkpoint-")
        atexit.register(shutil.rmtree, given, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(given)
    return given


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that we wrote, wherever Spark's file systems reach it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint, so that what follows neither recomputes them nor depends on one executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def batches(f: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` out of one for a batch; empty batches are skipped."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows and (out := f(b)) is not None:
                yield out

    return run


def pack(df: DataFrame, **more: Column) -> DataFrame:
    """The row as one struct ``_row`` beside columns of our own, so that no name of theirs can clash; ``unpack`` undoes it."""
    return df.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]).alias("_row"), *[c.alias(k) for k, c in more.items()])


def unpack(df: DataFrame) -> DataFrame:
    return df.select("_row.*")


def ranged(df: DataFrame, order: Sequence[Column], out: str = "_piece") -> DataFrame:
    """Adds the number of the range of ``order`` that a row lies in: ranges hold about equal numbers of rows, rows with equal keys share one. Cut by a checkpoint, so the numbers stay."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, *order).withColumn(out, F.spark_partition_id()))


def running(
    df: DataFrame,
    amount: str,
    order: Sequence[Column],
    bucket: Column,
    group: Sequence[str] = (),
    out: str = "_cum",
) -> DataFrame:
    """Adds the running total of ``amount`` in ``order`` within ``group``, without one task that holds a group.

    ``bucket`` is a number or text that rises with ``order`` and parts the group
    into pieces. Sums by piece give each piece its offset; a window then runs
    within one piece only. Only the piece sums pass through an unparted window.
    """
    keys = [*group, "_piece"]
    df = df.withColumn("_piece", bucket)
    sums = df.groupBy(*keys).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.withColumn("_in", F.sum(amount).over(within))
    on = [joined[k].eqNullSafe(offsets[k]) for k in keys]
    return joined.join(offsets, on, "inner").select(joined["*"], (F.col("_in") + F.col("_offset")).alias(out)).drop("_piece", "_in")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, root), root the least node of its component.

    Alternates the large-star and small-star steps until no edge changes, which
    takes a number of rounds that grows with the logarithm of the longest path.
    Every round is a shuffle of the edges, cut by a checkpoint.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least(F.col("u"), F.min("v").over(Window.partitionBy("u")))
        large = both.select("u", "v", least.alias("m")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = F.min("v").over(Window.partitionBy("u"))
        small = large.select("u", "v", low.alias("m"))
        small = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = cut(small.distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
