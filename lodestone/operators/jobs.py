"""Durable work: a job's state folded from its transitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.shared import cut

MOST = 3


def backoff(attempt: Column, base: float, factor: float = 2.0, most: float | None = None) -> Column:
    d = F.lit(base) * F.pow(F.lit(factor), attempt - 1)
    return d if most is None else F.least(d, F.lit(most))


KINDS = ("lease", "done", "fail", "redrive")
_FINAL = {"queued": 0, "running": 1, "failed": 2, "done": 3}


def _states(most: int) -> list[tuple[str, int]]:
    return [(s, n) for n in range(most) for s in _FINAL] + [("dead", most)]


def _after(state: tuple[str, int], kind: str, most: int) -> tuple[str, int]:
    status, tries = state
    if kind == "lease" and status in ("queued", "failed"):
        return "running", tries
    if kind == "done" and status == "running":
        return "done", tries
    if kind == "fail" and status == "running":
        return ("dead", most) if tries + 1 >= most else ("failed", tries + 1)
    if kind == "redrive" and status == "dead":
        return "queued", 0
    return state


def fold(transitions: DataFrame, most: int = MOST) -> DataFrame:
    """(job, status, attempts) from rows (job, at, kind): kinds ``enqueue``, ``lease``, ``done``, ``fail``, ``redrive``.

    A job is queued when it is first seen; a lease makes a queued or failed job
    run; a failure counts an attempt and, at the last one, kills it; done and
    dead are final but for a redrive of the dead, which starts anew.

    A transition is a function on the few states; such functions compose. Ranges
    of the order are composed first, each of bounded size, then a job's ranges,
    so a job of any length is spread over tasks.
    """
    states = _states(most)
    table = [F.lit(k) if j == 0 else F.array(*[F.lit(states.index(_after(s, k, most))) for s in states]) for k in KINDS for j in range(2)]
    steps = F.create_map(*table)
    identity = F.array(*[F.lit(i) for i in range(len(states))])
    parts = int(transitions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = transitions.filter(F.col("kind").isin(*KINDS)).repartitionByRange(parts, "job", "at").withColumn("_range", F.spark_partition_id())
    own = F.aggregate(F.array_sort(F.collect_list(F.struct("at", "kind"))), identity, lambda m, e: F.transform(m, lambda s: F.get(steps[e["kind"]], s)))
    ranges = cut(ranged).groupBy("job", "_range").agg(own.alias("m"))
    whole = F.aggregate(F.array_sort(F.collect_list(F.struct("_range", "m"))), F.lit(0), lambda s, r: F.get(r["m"], s))
    seen = transitions.select("job").distinct()
    names, tries = (F.array(*[F.lit(s[i]) for s in states]) for i in range(2))
    last = seen.join(ranges.groupBy("job").agg(whole.alias("_s")), "job", "left").withColumn("_s", F.coalesce("_s", F.lit(0)))
    return last.select("job", F.get(names, F.col("_s")).alias("status"), F.get(tries, F.col("_s")).cast("bigint").alias("attempts"))


def lease(jobs: DataFrame, n: int = 1) -> DataFrame:
    """The n queued jobs that came first, now running. ``jobs``: (job, seq, status, attempts)."""
    return jobs.filter("status = 'queued'").orderBy("seq").limit(n).withColumn("status", F.lit("running"))


def by_status(jobs: DataFrame, status: str) -> DataFrame:
    """Jobs of a status, first come first."""
    return jobs.filter(F.col("status") == status).orderBy("seq")


def resume(jobs: DataFrame) -> DataFrame:
    """All jobs after a restart: those that were running or had failed are queued again, with their attempts."""
    return jobs.withColumn("status", F.when(F.col("status").isin("running", "failed"), "queued").otherwise(F.col("status")))


def redrive(jobs: DataFrame) -> DataFrame:
    """All jobs, the dead ones queued anew without attempts."""
    dead = F.col("status") == "dead"
    return jobs.withColumns({"status": F.when(dead, "queued").otherwise(F.col("status")), "attempts": F.when(dead, F.lit(0).cast("bigint")).otherwise(F.col("attempts"))})


class Transient(Exception):
    """A failure that may pass: the job is tried again."""


def run(jobs: DataFrame, work: Callable[[str], object], most: int = MOST) -> DataFrame:
    """(job, status, attempts, reason): each queued job's work, on the executors. A transient failure is tried again up to ``most`` times; any other, and the last, kills the job and no other."""

    def one(job: str) -> tuple[str, int, str | None]:
        for n in range(1, most + 1):
            try:
                work(job)
                return "done", n - 1, None
            except Transient as e:
                why = str(e)
            except Exception as e:  # the job's own fault: it must not stop the others
                return "dead", n, str(e)
        return "dead", most, why

    def f(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            yield pd.DataFrame([(j, *one(j)) for j in b["job"]], columns=["job", "status", "attempts", "reason"])

    kind = jobs.schema["job"].dataType.simpleString()
    return jobs.filter("status = 'queued'").select("job").mapInPandas(f, f"job {kind}, status string, attempts bigint, reason string")


def enqueue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Jobs with the new ones that aren't known yet."""
    return jobs.unionByName(new.dropDuplicates(["job"]).join(jobs.select("job"), "job", "left_anti"))
