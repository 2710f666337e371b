"""Packing by power-of-two decomposition.

A document of n tokens is split into pieces whose lengths are the powers of two
that make up n, longest first, none longer than the context; so 2 * context + 5
tokens give two pieces of the context's length, one of 4 and one of 1. Pieces of
equal length form a bucket, and batches are drawn from one bucket: sequences
need no padding and none crosses documents.

A token is a whitespace word with the white space after it (the first takes
what stands before it as well), so that a document's pieces joined give its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 2048
SALTS = 32
"""Salts of the longest pieces, for each partition."""
BLANKS = " \t\n\r\f"
TOKEN = "[ \t\n\r\f]*[^ \t\n\r\f]+[ \t\n\r\f]*"


def _lengths(n: Column, context: int) -> Column:
    powers = [1 << b for b in reversed(range(context.bit_length() - 1))]
    rest = F.filter(F.array(*[F.lit(p) for p in powers]), lambda p: n.bitwiseAND(p) > 0)
    return F.concat(F.array_repeat(F.lit(context), F.floor(n / context).cast("int")), rest)


def pieces(docs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(doc_id, piece, start, length, text): ``piece`` counts from 0, ``start`` in tokens from 0, ``length`` is the bucket.

    A null, empty or blank text has no tokens and no pieces. Repeated rows are
    split each. A text of any length is split whole; its pieces are slices, so
    the work is in proportion to its length. An empty table gives no piece.
    Other columns are not read, so their names can't clash.
    """
    if context < 1 or context & (context - 1):
        raise ValueError("the context must be a power of two")
    # a blank text is left out before the search, which would go over its white space again from each place
    some = docs.select("doc_id", "text").filter(F.length(F.btrim("text", F.lit(BLANKS))) > 0)
    words = some.select("doc_id", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("w"))
    split = words.select("doc_id", "w", _lengths(F.size("w"), context).alias("l"))
    # the pieces before the remainder all have the context's length, the others come from high to low bits
    whole = F.floor(F.size("w") / context).cast("int")
    power = lambda i: F.col("l")[i]
    start = lambda i: F.when(i < whole, i * context).otherwise(
        whole * context + (F.size("w") % context) - (F.size("w") % context) % (power(i) * 2)
    )
    at = F.transform(F.sequence(F.lit(0), F.size("l") - 1), lambda i: F.struct(i.alias("piece"), start(i).alias("start"), power(i).alias("length"), F.array_join(F.slice("w", start(i) + 1, power(i)), "").alias("text")))
    return split.select("doc_id", F.explode(at).alias("p")).select("doc_id", "p.*")


def packed(docs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """The pieces with those of equal length together. Cases as for ``pieces``.

    A length is spread over salts in proportion to it, as the bytes of its
    pieces are, by a hash of the piece; each partition is sorted by length.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = F.ceil(F.col("length") * SALTS * parts / context)
    salt = F.pmod(F.xxhash64("doc_id", "start", "text"), salts)
    return pieces(docs, context).withColumn("_salt", salt).repartition(parts, "length", "_salt").drop("_salt").sortWithinPartitions("length")


def oracle(documents: str = "documents", context: int = CONTEXT) -> str:
    bits = context.bit_length() - 1
    return f"""
WITH words AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN.encode("unicode_escape").decode()}') AS w FROM {documents}) WHERE len(w) > 0),
cuts AS (
  SELECT doc_id, w, n, CAST(i AS BIGINT) * {context} AS start, {context} AS length FROM words, LATERAL (SELECT unnest(range(n // {context})) AS i)
  UNION ALL
  SELECT doc_id, w, n, n - n % (1 << (b + 1)) AS start, 1 << b AS length FROM words, LATERAL (SELECT unnest(range({bits})) AS b) WHERE (n >> b) & 1 = 1)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id, md5(array_to_string(w, '')) ORDER BY start) - 1 AS INTEGER) AS piece, CAST(start AS INTEGER) AS start, CAST(length AS INTEGER) AS length,
  array_to_string(w[start + 1 : start + length], '') AS text FROM cuts"""
