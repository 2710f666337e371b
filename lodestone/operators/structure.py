"""Heading structure of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as X
from lodestone.operators.retrieval import top


def parents(headings: DataFrame) -> DataFrame:
    """(document_id, position, level, label, parent, ancestors): ``parent`` is the position of the nearest earlier heading of a lower level, ``ancestors`` are all above it, the lowest first.

    From rows (document_id, position, level, label). A document's headings pass
    in order by a stack of those still open, so the work is linear in them and
    levels may be any numbers. A null level counts as 1; blank headings are left out.
    """
    h = headings.filter(F.trim("label") != "").select("document_id", F.col("position").cast("bigint"), F.coalesce("level", F.lit(1)).cast("int").alias("level"), "label")

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document: object = None
        open_: list[tuple[int, int]] = []
        for b in it:
            parent: list[int | None] = []
            above: list[list[int]] = []
            for doc, at, level in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if doc != document:
                    document, open_ = doc, []
                while open_ and open_[-1][0] >= level:
                    open_.pop()
                parent.append(open_[-1][1] if open_ else None)
                above.append([p for _, p in reversed(open_)])
                open_.append((level, at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parent, pa.int64()), pa.array(above, pa.list_(pa.int64()))], [*b.schema.names, "parent", "ancestors"])

    schema = T.StructType([*h.schema.fields, T.StructField("parent", T.LongType()), T.StructField("ancestors", T.ArrayType(T.LongType()))])
    return h.repartition("document_id").sortWithinPartitions("document_id", "position").mapInArrow(f, schema)


def ancestry(tree: DataFrame) -> DataFrame:
    """(document_id, position, ancestor), a heading being its own ancestor."""
    return tree.select("document_id", "position", F.explode(F.concat(F.array("position"), "ancestors")).alias("ancestor"))


def slides(blocks: DataFrame) -> DataFrame:
    """(document_id, position, level, label, parent): the flat list of a deck's slides, in the place of a tree; a blank slide is left out. ``blocks``: (document_id, block, kind, text)."""
    some = blocks.filter((F.col("kind") == "slide") & (F.trim("text") != ""))
    return some.select("document_id", F.col("block").cast("bigint").alias("position"), F.lit(1).alias("level"), F.trim("text").alias("label"), F.lit(None).cast("bigint").alias("parent"))


def index(blocks: DataFrame) -> DataFrame:
    """(document_id, position, level, label, parent) of blocks: headings as a tree, slides as a list; blocks of other kinds have no node."""
    heads = blocks.filter("kind = 'heading'").select("document_id", F.col("block").alias("position"), "level", F.trim("text").alias("label"))
    return parents(heads).drop("ancestors").unionByName(slides(blocks))


def resolve(refs: DataFrame, units: DataFrame) -> DataFrame:
    """(ref, eu_id): the unit of that very id, else all units of that block. ``units``: (eu_id, block_ref), the block's id, equal to eu_id where the block wasn't cut."""
    known = units.select("eu_id", "block_ref")
    itself = refs.join(known.select(F.col("eu_id").alias("ref"), "eu_id"), "ref")
    below = refs.join(itself.select("ref"), "ref", "left_anti").join(known.withColumnRenamed("block_ref", "ref"), "ref")
    return itself.select("ref", "eu_id").unionByName(below.select("ref", "eu_id"))


def retrieve(questions: DataFrame, tree: DataFrame, k: int) -> DataFrame:
    """(question_id, node, score, rank): headings by question terms in their label or, at its best, in that of a heading above."""
    q = questions.select("question_id", F.explode(F.array_distinct(X.tokens_any(F.col("question")))).alias("term"))
    labels = tree.select("document_id", F.col("position").alias("ancestor"), F.explode(F.array_distinct(X.tokens_any(F.col("label")))).alias("term"))
    hits = labels.join(q, "term").groupBy("question_id", "document_id", "ancestor").agg(F.count("*").alias("hits"))
    below = hits.join(ancestry(tree), ["document_id", "ancestor"]).groupBy("question_id", "document_id", "position").agg(F.max("hits").cast("double").alias("score"))
    named = below.select("question_id", F.concat_ws("::", F.col("document_id").cast("string"), F.col("position").cast("string")).alias("node"), "score")
    return top(named, k, item="node")
