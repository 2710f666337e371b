"""What the index holds against what it should hold: manifests, merges, revocation, rebuilds, scopes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAYERS = {
    "extract": ("ocr", "vision"),
    "ocr": ("eu_chunk",),
    "vision": ("eu_chunk",),
    "eu_chunk": ("embedding", "structure", "graph"),
    "graph": ("community_summary",),
    "embedding": (),
    "structure": (),
    "community_summary": (),
}


def checksum(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def changed(incoming: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of (doc_id, checksum, ...) that are new or differ from the manifest."""
    return incoming.join(manifest.select("doc_id", "checksum"), ["doc_id", "checksum"], "left_anti")


def owners(manifest: DataFrame) -> DataFrame:
    """(checksum, n_docs, first_doc)."""
    return manifest.groupBy("checksum").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def purgeable(retired: DataFrame, live: DataFrame) -> DataFrame:
    """Retired checksums that no document has any more."""
    return retired.select("checksum").distinct().join(live.select("checksum"), "checksum", "left_anti")


def upsert(target: DataFrame, source: DataFrame, key: str = "eu_id") -> DataFrame:
    """Rows of the source replace those of equal key and are added else."""
    return target.join(source.select(key), key, "left_anti").unionByName(source)


def revoke(manifest: DataFrame, gone: DataFrame) -> DataFrame:
    """(layer, n): what a revocation of documents removes, and blobs that stay for other owners."""
    mine = manifest.join(gone, "doc_id", "left_semi")
    rest = manifest.join(gone, "doc_id", "left_anti")
    blobs = mine.select("checksum").distinct()
    kept = blobs.join(rest, "checksum", "left_semi")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("layer"), "n")
    return count(mine, "units").unionByName(count(blobs.join(kept, "checksum", "left_anti"), "blobs")).unionByName(count(kept, "shared_blobs"))


def reconcile(index: DataFrame, declared: DataFrame) -> DataFrame:
    """(doc_id, status): ``orphan``, ``missing``, ``superseded_version`` or ``content_mismatch``; documents in order are left out.

    ``index``: (doc_id, checksum). ``declared``: (doc_id, checksum, current), one current version at most.
    """
    now = declared.groupBy("doc_id").agg(F.max(F.when(F.col("current"), F.col("checksum"))).alias("want"), F.collect_set("checksum").alias("versions"))
    both = index.join(now, "doc_id", "full_outer")
    status = (
        F.when(F.col("versions").isNull(), "orphan")
        .when(F.col("checksum").isNull() & F.col("want").isNotNull(), "missing")
        .when(F.col("checksum").isNull() | F.col("checksum").eqNullSafe(F.col("want")), None)
        .when(F.array_contains("versions", F.col("checksum")), "superseded_version")
        .otherwise("content_mismatch")
    )
    return both.select("doc_id", status.alias("status")).filter("status IS NOT NULL")


def in_scope(rows: DataFrame, allowed: DataFrame, levels: list[str]) -> DataFrame:
    """Rows whose partition path has an allowed path as a prefix: (level columns) of ``allowed``, null where a path ends. Nothing allowed gives nothing."""
    on = [a for k in levels for a in [F.col(f"a.{k}").isNull() | (F.col(f"a.{k}") == F.col(f"r.{k}"))]]
    cond = on[0]
    for c in on[1:]:
        cond &= c
    return rows.alias("r").join(allowed.alias("a"), cond, "left_semi")


def closure(spark: SparkSession) -> DataFrame:
    """(seed, layer): every layer that must be built again when one changes. The layers are a closed list."""
    rows = []
    for seed in LAYERS:
        reached, todo = set(), [seed]
        while todo:
            at = todo.pop()
            if at not in reached:
                reached.add(at)
                todo += LAYERS[at]
        rows += [(seed, x) for x in sorted(reached)]
    return spark.createDataFrame(rows, "seed string, layer string")


STAGES = {"extractor": "extract", "ocr": "ocr", "vision": "vision", "chunker": "eu_chunk", "embedding": "embedding", "structure": "structure", "graph": "graph", "summary": "community_summary"}
"""The layer that each stage of a stamp makes."""


def changed_stages(current: dict[str, str], stamps: DataFrame) -> DataFrame:
    """(document_id, layer): layers whose stage has another version in the document's stamp, or none, than now. ``stamps``: (document_id, stage, version)."""
    spark = stamps.sparkSession
    now = spark.createDataFrame([(k, v, STAGES[k]) for k, v in current.items()], "stage string, now string, layer string")
    every = stamps.select("document_id").distinct().crossJoin(F.broadcast(now))  # a closed list of stages
    both = every.join(stamps.select("document_id", "stage", "version"), ["document_id", "stage"], "left")
    return both.filter(~F.col("version").eqNullSafe(F.col("now"))).select("document_id", "layer")


def rebuild_layers(current: dict[str, str], stamps: DataFrame) -> DataFrame:
    """(document_id, layer): all that must be built again for each document."""
    seeds = changed_stages(current, stamps).withColumnRenamed("layer", "seed")
    return seeds.join(F.broadcast(closure(stamps.sparkSession)), "seed").select("document_id", "layer").distinct()


def rebuild_plan(current: dict[str, str], stamps: DataFrame) -> DataFrame:
    """(layer): what must be built again for any of the documents."""
    return rebuild_layers(current, stamps).select("layer").distinct()


TOKENIZER = 2
"""The version of the tokenizer that indexes are made with."""


def history(versions: DataFrame) -> DataFrame:
    """(doc_id, checksum, retired): the latest checksum of each document and, in order, the others that it ever had.

    ``versions``: (doc_id, seq, checksum). A checksum that comes back is no longer retired.
    """
    each = versions.groupBy("doc_id").agg(F.max_by("checksum", "seq").alias("checksum"), F.collect_set("checksum").alias("_all"))
    return each.select("doc_id", "checksum", F.array_sort(F.array_except("_all", F.array("checksum"))).alias("retired"))


def forget(manifest: DataFrame, gone: DataFrame) -> DataFrame:
    """The manifest without the documents, their history included; one that it doesn't have changes nothing."""
    return manifest.join(gone.select("doc_id"), "doc_id", "left_anti")


def stale(partitions: DataFrame, version: int = TOKENIZER) -> DataFrame:
    """Partitions whose index was made by another tokenizer; one without a version was made by the first."""
    return partitions.filter(F.coalesce("version", F.lit(1)) != version)


def indexed(manifest: DataFrame, units: DataFrame) -> DataFrame:
    """(doc_id, checksum) of all that the index holds: what the manifest says, and documents of which only units are there."""
    loose = units.join(manifest.select("doc_id"), "doc_id", "left_anti").groupBy("doc_id").agg(F.min("checksum").alias("checksum"))
    return manifest.select("doc_id", "checksum").unionByName(loose)


def cascade(layers: dict[str, DataFrame], manifest: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """What is left of each layer once documents are revoked.

    ``layers`` keyed by doc_id lose their rows; ``blobs`` (checksum) lose those
    that the documents had, now or ever, and that no other document has now.
    ``manifest``: (doc_id, checksum, retired), which is left last: while a
    document is in it, it is there.
    """
    gone = gone.select("doc_id").distinct()
    mine = manifest.join(gone, "doc_id", "left_semi")
    left = forget(manifest, gone)
    owned = mine.select(F.explode(F.array_union(F.array("checksum"), "retired")).alias("checksum")).distinct()
    dead = owned.join(left.select("checksum"), "checksum", "left_anti")
    out = {k: df.join(dead, "checksum", "left_anti") if k == "blobs" else df.join(gone, "doc_id", "left_anti") for k, df in layers.items()}
    return out | {"manifest": left}


def orphans(report: DataFrame) -> DataFrame:
    """(doc_id): what remediation of a report revokes: its orphans and nothing else."""
    return report.filter("status = 'orphan'").select("doc_id")


def path_of(levels: list[str]) -> Column:
    """A partition's path: ``level=value`` segments."""
    return F.concat_ws("/", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in levels])


def layer_prefix(layer: str, levels: list[str]) -> Column:
    return F.concat(F.lit(f"{layer}/"), path_of(levels))


def is_prefix(path: Column, of: Column) -> Column:
    """Whether an array of segments begins another."""
    return F.slice(of, 1, F.size(path)) == path


def resolve_scope(scope: dict[str, str], hierarchy: list[str]) -> list[tuple[str, str]]:
    """The scope's levels in order; they must be the hierarchy's first ones, without a gap or a level that it doesn't have."""
    if unknown := set(scope) - set(hierarchy):
        raise ValueError(f"unknown levels {sorted(unknown)}")
    path = [(k, scope[k]) for k in hierarchy if k in scope]
    if [k for k, _ in path] != hierarchy[: len(path)]:
        raise ValueError("a scope has no gap")
    return path


def acl(rows: DataFrame, column: str, allowed: Callable[[object], bool] | None = None) -> DataFrame:
    """Rows whose ``column`` the predicate allows; all without one."""
    if allowed is None:
        return rows
    test = F.pandas_udf(lambda s: s.map(lambda v: bool(allowed(v))), "boolean")
    return rows.filter(test(F.col(column)))
