"""Objects by key, and tables in buckets of documents with one commit record.

``ObjectStore`` goes through Spark's own file systems, so a local folder and an
object store differ in their root and options only. ``Store`` keeps each table
in buckets by a hash of the document; a change writes the buckets that it
touches anew and then the record that names all buckets' versions. Whatever is
written before the record isn't seen without it, so a change that is cut short
has not happened, and can be made again.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


def s3_options(endpoint: str | None = None, key_env: str | None = None, secret_env: str | None = None, path_style: bool = True) -> dict[str, str]:
    """Options for a root ``s3a://bucket/prefix``; credentials are given by the names of environment variables."""
    out = {"fs.s3a.path.style.access": str(path_style).lower()}
    if endpoint:
        out["fs.s3a.endpoint"] = endpoint
    for option, name in (("fs.s3a.access.key", key_env), ("fs.s3a.secret.key", secret_env)):
        if name:
            out[option] = os.environ[name]
    return out


class ObjectStore:
    def __init__(self, spark: SparkSession, root: str, options: Mapping[str, str] | None = None):
        self.root = root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._utils = spark._jvm.org.apache.commons.io.IOUtils
        conf = spark._jvm.org.apache.hadoop.conf.Configuration(spark._jsc.hadoopConfiguration())
        for k, v in (options or {}).items():
            conf.set(k, v)
        self._fs = self._at("").getFileSystem(conf)

    def _at(self, key: str):
        return self._path(f"{self.root}/{key}" if key else self.root)

    def put(self, key: str, data: bytes) -> None:
        """Written beside and renamed, so nobody reads half of it."""
        draft = self._at(f"{key}.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(data)
        out.close()
        at = self._at(key)
        if self._fs.exists(at):
            self._fs.delete(at, False)
        self._fs.rename(draft, at)

    def get(self, key: str) -> bytes:
        stream = self._fs.open(self._at(key))
        try:
            return bytes(self._utils.toByteArray(stream))
        finally:
            stream.close()

    def exists(self, key: str) -> bool:
        return self._fs.exists(self._at(key))

    def list(self, prefix: str = "") -> list[str]:
        """Keys of all objects below a prefix, in order."""
        if not self.exists(prefix):
            return []
        found, files = [], self._fs.listFiles(self._at(prefix), True)
        base = self._fs.makeQualified(self._at("")).toString()
        while files.hasNext():
            name = files.next().getPath().toString()
            found.append(name[len(base) :].lstrip("/"))
        return sorted(k for k in found if not k.rsplit("/", 1)[-1].startswith((".", "_")))

    def delete(self, prefix: str) -> None:
        """An object, or all below a prefix; what isn't there is no error."""
        self._fs.delete(self._at(prefix), True)

    def put_json(self, key: str, value: object) -> None:
        self.put(key, json.dumps(value, sort_keys=True).encode())

    def get_json(self, key: str) -> object:
        return json.loads(self.get(key))

    def put_blob(self, prefix: str, data: bytes) -> str:
        """The key, by the content's SHA-256; a blob that is there isn't written again."""
        key = f"{prefix}/{hashlib.sha256(data).hexdigest()}"
        if not self.exists(key):
            self.put(key, data)
        return key


class Store:
    """Tables of rows with a ``document_id``."""

    def __init__(self, spark: SparkSession, root: str, schemas: Mapping[str, str], options: Mapping[str, str] | None = None, buckets: int = BUCKETS):
        self.spark, self.root, self.schemas, self.buckets = spark, root.rstrip("/"), dict(schemas), buckets
        self.objects = ObjectStore(spark, root, options)

    def _record(self) -> tuple[int, dict]:
        names = self.objects.list("commits")
        if not names:
            return 0, {"tables": {}, "notes": {}}
        return int(names[-1].rsplit("/", 1)[1].removesuffix(".json")), self.objects.get_json(names[-1])

    def version(self) -> int:
        return self._record()[0]

    def note(self, name: str) -> object:
        """A value that the last commit carries."""
        return self._record()[1]["notes"].get(name)

    def bucket(self):
        return F.pmod(F.xxhash64(F.col("document_id")), F.lit(self.buckets)).cast("int")

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets, which are then all that is read."""
        schema = T._parse_datatype_string(self.schemas[name])
        held = self._record()[1]["tables"].get(name, {})
        paths = [f"{self.root}/{name}/v{v}/_bucket={b}" for b, v in held.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, new: Mapping[str, DataFrame], gone: DataFrame | None = None, notes: Mapping[str, object] | None = None, whole: tuple[str, ...] = ()) -> int:
        """Rows of ``new`` take the place of all that their documents had in that table; documents of ``gone`` (document_id) lose theirs in every table but those of ``whole``, which are replaced outright."""
        before, record = self._record()
        version = before + 1
        tables = {k: dict(v) for k, v in record["tables"].items()}
        for name in {*new, *(self.schemas if gone is not None else ())}:
            fields = T._parse_datatype_string(self.schemas[name]).fieldNames()
            rows = new.get(name)
            rows = rows.select(*fields) if rows is not None else self.spark.createDataFrame([], self.schemas[name])
            if name in whole:
                if name not in new:
                    continue
                tables[name] = {}
                kept = rows
            else:
                out = rows.select("document_id")
                if gone is not None:
                    out = out.unionByName(gone.select("document_id"))
                out = out.distinct()
                touched = [r[0] for r in out.select(self.bucket()).distinct().collect()]  # BUCKETS numbers at most
                kept = self.read(name, touched).join(out, "document_id", "left_anti").unionByName(rows)
                for b in touched:
                    tables.setdefault(name, {}).pop(str(b), None)
            target = f"{self.root}/{name}/v{version}"
            kept.withColumn("_bucket", self.bucket()).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(target)
            made = {k.split("_bucket=")[1].split("/")[0] for k in self.objects.list(f"{name}/v{version}") if "_bucket=" in k}
            tables.setdefault(name, {}).update(dict.fromkeys(made, version))
        self.objects.put_json(f"commits/{version:012d}.json", {"tables": tables, "notes": {**record["notes"], **(notes or {})}})
        for name, held in record["tables"].items():  # what no commit names any more; its bytes are gone for good
            for b, v in held.items():
                if tables.get(name, {}).get(b) != v:
                    self.objects.delete(f"{name}/v{v}/_bucket={b}")
        for old in self.objects.list("commits")[:-2]:
            self.objects.delete(old)
        return version


    def drop(self, name: str) -> None:
        """The table without a row."""
        self.commit({name: self.spark.createDataFrame([], self.schemas[name])}, whole=(name,))


def append_audit(rows: DataFrame, root: str) -> None:
    """Rows added to a log of JSON lines; what is in it is never read or written again."""
    rows.withColumn("at", F.current_timestamp()).write.mode("append").json(f"{root.rstrip('/')}/audit")


def append_events(rows: DataFrame, root: str) -> None:
    """Stage events added to the table that costs and quality are worked out from, and that may be read as a stream."""
    rows.write.mode("append").parquet(f"{root.rstrip('/')}/stage_events")
