"""WARC files compressed record by record with a Zstandard dictionary of their own.

A file begins with a skippable frame (magic 0x184D2A5D) that holds its
dictionary; every record follows as a frame of its own, so a reader that has
the dictionary and an offset reads one record alone. The dictionary is built
from the records that the file holds, all of them.

Pages are assigned to files by a hash of url, page_id and html, so a file's
content doesn't depend on how the input is laid out, a task that is run again
gives the same bytes, and pages that share a url (or have none) are spread.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import cut

MAGIC = 0x184D2A5D
FILE_BYTES = 16 << 20
"""Uncompressed payload that a file holds, about; all of it is in a task's memory."""
COPIES, BROADCAST = 1000, 1_000_000
FILES = 64
"""That a task makes in turn, at most; each task has as many as the others, but for one."""
DICTIONARY_BYTES = 110 << 10
LEVEL = 3
DATE = "2020-01-01T00:00:00Z"
"""The tables don't say when a page was fetched."""

SCHEMA = T.StructType(
    [
        T.StructField("file", T.IntegerType()),
        T.StructField("record", T.IntegerType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("frame", T.BinaryType()),
    ]
)


def record(page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> bytes:
    """A WARC/1.1 resource record. A null url leaves the target out, line ends in one stand as %0D and %0A and are read back so, a null html is marked as such and has an empty block."""
    body = (html or "").encode()
    digest = hashlib.sha1(body).hexdigest()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}\0{url}\0{digest}")
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if html is None:
        head.append("X-Payload: null")
    head += [f"WARC-Block-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """page_id, url, html and the headers of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    if "sha1:" + hashlib.sha1(body).hexdigest() != fields["WARC-Block-Digest"]:
        raise ValueError("the block doesn't match its digest")
    page = fields.get("X-Page-ID")
    return {"page_id": None if page is None else int(page), "url": fields.get("WARC-Target-URI"), "html": None if fields.get("X-Payload") == "null" else body.decode(), "headers": fields}


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Built from all the records; where they are too few or too small for training, the records themselves, cut to the size, serve as a raw dictionary."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, records, k=512, d=8, f=20, accel=1, steps=1, split_point=1.0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-size:]


def encode(records: list[bytes], level: int = LEVEL) -> list[bytes]:
    """The frames of a file: the skippable one with the dictionary, then one a record."""
    import zstandard

    d = dictionary(records)
    data = zstandard.ZstdCompressionDict(d)
    if data.dict_id():
        data.precompute_compress(level=level)
    c = zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=True, write_checksum=True)
    return [struct.pack("<II", MAGIC, len(d)) + d, *map(c.compress, records)]


def read(content: bytes) -> Iterator[dict]:
    """All records of a file, in its order."""
    import zstandard

    magic, n = struct.unpack_from("<II", content)
    if magic != MAGIC:
        raise ValueError("the file doesn't begin with a dictionary frame")
    dctx = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + n]))
    rest = content[8 + n :]
    while rest:
        d = dctx.decompressobj()
        raw = d.decompress(rest)
        rest = d.unused_data
        yield parse(raw)


def read_at(content: bytes, offset: int, length: int) -> dict:
    """One record alone."""
    import zstandard

    n = struct.unpack_from("<II", content)[1]
    dctx = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + n]))
    return parse(dctx.decompress(content[offset : offset + length]))


def frames(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(file, record, page_id, offset, length, frame): all frames of all files, record 0 being a file's dictionary.

    Concatenated in the order of ``record`` a file's frames are the file. Pages
    stand in the order of url, page_id and html. Null urls and payloads as for
    ``record``; empty, long and repeated ones are records like others; an empty
    table gives no file. Columns other than page_id, url and html are not
    archived, so their names can't clash.
    """
    total = pages.agg(F.coalesce(F.sum(F.octet_length("html") + F.lit(400)), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // file_bytes))
    rows = _spread(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")).select(F.pmod("_h", F.lit(n)).cast("int").alias("file"), "page_id", "url", "html")

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, ids, raw = None, [], []
        for b in it:
            for no, page_id, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if no != file and raw:
                    yield _file(file, ids, raw)
                    ids, raw = [], []
                file = no
                ids.append(page_id)
                raw.append(record(page_id, url, html))
        if raw:
            yield _file(file, ids, raw)

    parts = max(min(n, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-n // FILES))
    return rows.repartitionById(parts, F.col("file") % parts).sortWithinPartitions("file", "url", "page_id", "html").mapInArrow(f, SCHEMA)


def _spread(pages: DataFrame) -> DataFrame:
    """Adds ``_h``, a hash of the page; more than ``COPIES`` equal pages are parted by their place in the input, which of them goes where being all the same."""
    h = F.xxhash64("url", "page_id", "html")
    many = cut(pages.groupBy(h.alias("_of")).agg(F.count("*").alias("_n")).filter(F.col("_n") > COPIES))
    n = many.count()
    rows = pages.withColumn("_h", h)
    if not n:
        return rows
    rows = rows.withColumn("_at", F.monotonically_increasing_id()).join(F.broadcast(many) if n <= BROADCAST else many, F.col("_h") == F.col("_of"), "left")
    salt = F.pmod("_at", F.ceil(F.col("_n") / COPIES))
    return rows.withColumn("_h", F.when(F.col("_n").isNull(), F.col("_h")).otherwise(F.xxhash64("_h", salt)))


def _file(no: int, ids: list[int | None], raw: list[bytes]) -> pa.RecordBatch:
    made = encode(raw)
    size = np.array([len(x) for x in made])
    columns = [pa.array(np.full(len(made), no, np.int32)), pa.array(np.arange(len(made), dtype=np.int32)), pa.array([None, *ids], pa.int64()), pa.array(np.r_[0, np.cumsum(size)[:-1]]), pa.array(size), pa.array(made, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, SCHEMA.names)


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes ``part-NNNNN.warc.zst`` into a folder that all executors reach (a path or URI of a file system that Arrow knows); gives (file, path, records, bytes).

    A file is written under a name of its task's attempt and renamed, so attempts that are lost or run twice leave whole files only.
    """
    made = frames(pages, file_bytes)
    cols = ["file", "record", "frame"]

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        where.create_dir(base, recursive=True)
        rows: dict[int, list[tuple[int, bytes]]] = {}
        for b in it:
            for no, rec, frame in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows.setdefault(no, []).append((rec, frame))
                if len(rows) > 1:  # rows are sorted by file: the one before is whole
                    yield save(where, base, *next((k, rows.pop(k)) for k in list(rows) if k != no))
        for no in list(rows):
            yield save(where, base, no, rows.pop(no))

    def save(where, base: str, no: int, own: list[tuple[int, bytes]]) -> pa.RecordBatch:
        name = f"{base}/part-{no:05d}.warc.zst"
        draft = f"{name}.{uuid.uuid4().hex}"
        body = b"".join(x for _, x in sorted(own, key=lambda x: x[0]))
        with where.open_output_stream(draft) as out:
            out.write(body)
        where.move(draft, name)
        return pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([name]), pa.array([len(own) - 1], pa.int64()), pa.array([len(body)], pa.int64())], ["file", "path", "records", "bytes"])

    return made.select(*cols).mapInArrow(f, "file int, path string, records bigint, bytes bigint")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, html) of all records in a folder's files."""

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for content in b.column(0).to_pylist():
                rows = list(read(content))
                yield pa.RecordBatch.from_arrays([pa.array([r["page_id"] for r in rows], pa.int64()), pa.array([r["url"] for r in rows], pa.string()), pa.array([r["html"] for r in rows], pa.string())], ["page_id", "url", "html"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content").mapInArrow(f, "page_id bigint, url string, html string")
