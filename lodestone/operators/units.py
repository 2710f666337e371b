"""Evidence units out of documents and blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.state import checksum

MOST, OVERLAP = 450, 60


def from_blocks(blocks: DataFrame) -> DataFrame:
    """A unit for each block of (document_id, block, text) that isn't blank."""
    some = blocks.filter(F.btrim("text", F.lit(" \t\r\n\f\v")) != "")
    return some.select(F.concat_ws("::", "document_id", F.col("block").cast("string")).alias("eu_id"), "document_id", "block", F.col("text").alias("passage"), checksum(F.col("text")).alias("checksum"))


def chunked(blocks: DataFrame, most: int = MOST, overlap: int = OVERLAP, chunk: Callable[[str], list[str]] | None = None) -> DataFrame:
    """Units of at most about ``most`` words; only longer blocks are handed to Python, to ``chunk`` if it is given."""
    trimmed = F.btrim("text", F.lit(" \t\r\n\f\v"))
    n = F.size(F.split(trimmed, r"\s+"))
    own = X.chunks(most, overlap) if chunk is None else F.udf(lambda t: chunk(t) if t is not None else [], "array<string>")
    cut = own(F.when(n > most, F.col("text")))
    pieces = F.when(trimmed == "", F.array().cast("array<string>")).when(n <= most, F.array(trimmed)).otherwise(cut)
    rows = blocks.select("document_id", "block", F.posexplode(pieces).alias("chunk", "passage"))
    return rows.select(F.concat_ws("::", "document_id", F.col("block").cast("string"), F.col("chunk").cast("string")).alias("eu_id"), "document_id", "block", "chunk", "passage")


def rendered(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(document_id, text): a table's rows as ``column: value`` lists; nulls are left out."""
    parts = [F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in columns]
    return rows.select(F.col(key).alias("document_id"), F.concat_ws(", ", *parts).alias("text"))
