"""Co-mention graph: terms as nodes, terms of one unit as edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.retrieval import top
from lodestone.sources.shared import cut

LETTERS = 4


def unit_terms(units: DataFrame) -> DataFrame:
    """(unit, term): the distinct content tokens of at least ``LETTERS`` letters."""
    return units.select("unit", F.explode(X.content(X.tokens(F.col("text")))).alias("term")).filter(F.length("term") >= LETTERS)


def nodes(units: DataFrame) -> DataFrame:
    """(label, n_units, first_unit)."""
    return unit_terms(units).groupBy(F.col("term").alias("label")).agg(F.count("*").alias("n_units"), F.min("unit").alias("first_unit"))


def terms_of(units: DataFrame) -> DataFrame:
    """(w): the terms of ``unit_terms`` of each unit, in order."""
    return units.select(F.array_sort(F.filter(X.content(X.tokens(F.col("text"))), lambda w: F.length(w) >= LETTERS)).alias("w"))


def edges(units: DataFrame) -> DataFrame:
    """(source, target, weight): pairs of terms by the units that hold both. Pairs are made within a unit's row, so only their counts are shuffled; units are chunks, which bounds a row's pairs."""
    first = terms_of(units).select("w", F.posexplode("w").alias("i", "source"))
    pairs = first.select("source", F.explode(F.slice("w", F.col("i") + 2, F.size("w"))).alias("target"))
    return pairs.groupBy("source", "target").agg(F.count("*").alias("weight"))


def strength(edge: DataFrame) -> DataFrame:
    """(label, n_neighbors, weight) of each node that has an edge; of units without the edges: ``comention.strength``."""
    ends = edge.select(F.col("source").alias("label"), "weight").unionByName(edge.select(F.col("target").alias("label"), "weight"))
    return ends.groupBy("label").agg(F.count("*").alias("n_neighbors"), F.sum("weight").alias("weight"))


def retrieve(questions: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Candidates by the number of the question's content tokens that are nodes of the unit."""
    q = questions.select("question_id", F.explode(X.content(X.tokens(F.col("question")))).alias("term"))
    hits = unit_terms(docs.select(F.col("doc_id").alias("unit"), "text")).join(q, "term").groupBy("question_id", F.col("unit").alias("doc_id")).agg(F.count("*").cast("double").alias("score"))
    return top(hits, k)


def neighbors(needles: DataFrame, edge: DataFrame) -> DataFrame:
    """(needle, label, neighbor, weight): for each needle the first label that contains it, with its edges. Needles are few, labels are scanned once."""
    labels = edge.select(F.col("source").alias("label")).union(edge.select("target")).distinct()
    chosen = labels.join(needles, F.col("label").contains(F.col("needle"))).groupBy("needle").agg(F.min("label").alias("label"))
    both = edge.select(F.col("source").alias("label"), F.col("target").alias("neighbor"), "weight").union(edge.select("target", "source", "weight"))
    return chosen.join(both, "label").select("needle", "label", "neighbor", "weight")


def neighbors_of(needles: DataFrame, units: DataFrame) -> DataFrame:
    """``neighbors`` of the edges of units, without making them all: only the chosen labels' pairs are counted. The units' terms, read twice, are cut, so texts are cut in chunks once."""
    held = cut(terms_of(units).filter(F.size("w") > 1))
    labels = held.select(F.explode("w").alias("label")).distinct()
    chosen = labels.join(needles, F.col("label").contains(F.col("needle"))).groupBy("needle").agg(F.min("label").alias("label"))
    own = held.select("w", F.explode("w").alias("label")).join(F.broadcast(chosen.select("label").distinct()), "label")  # a label a needle at most
    counted = own.select("label", F.explode("w").alias("neighbor")).filter("label <> neighbor").groupBy("label", "neighbor").agg(F.count("*").alias("weight"))
    return chosen.join(counted, "label").select("needle", "label", "neighbor", "weight")


def node_id(label: Column) -> Column:
    return F.concat(F.lit("node:"), F.lower(F.trim(label)))


def sane(entities: DataFrame, relations: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A model's graph as it may be kept: (node_id, label, refs), (source, target, weight, relation).

    Entities (label, refs) keep references to units that exist and go without
    any; relations (source, target, weight, relation) keep to entities that are
    left, with a weight of 1 at least.
    """
    named = entities.select(F.trim("label").alias("label"), F.explode("refs").alias("unit")).filter("label <> ''")
    held = named.join(units.select(F.col("unit").cast("string")), "unit", "left_semi").groupBy("label").agg(F.array_sort(F.collect_set("unit")).alias("refs"))
    kept = held.select("label")
    r = relations.select(F.trim("source").alias("source"), F.trim("target").alias("target"), "weight", "relation")
    r = r.join(kept.withColumnRenamed("label", "source"), "source", "left_semi").join(kept.withColumnRenamed("label", "target"), "target", "left_semi")
    weight = F.greatest(F.coalesce(F.col("weight").cast("bigint"), F.lit(1).cast("bigint")), F.lit(1).cast("bigint"))
    edge = r.select(node_id(F.col("source")).alias("source"), node_id(F.col("target")).alias("target"), weight.alias("weight"), F.nullif(F.trim("relation"), F.lit("")).alias("relation"))
    return held.select(node_id(F.col("label")).alias("node_id"), "label", "refs"), edge


def distil(units: DataFrame, model: Callable[[str], dict] | None) -> tuple[DataFrame, DataFrame]:
    """(label, refs), (source, target, weight, relation): by a model, a call a unit, made sane; without one the co-mention graph. A unit whose call fails gives nothing. ``units``: (unit, text)."""
    if model is None:
        n = unit_terms(units).groupBy(F.col("term").alias("label")).agg(F.array_sort(F.collect_set(F.col("unit").cast("string"))).alias("refs"))
        return n.select(node_id(F.col("label")).alias("node_id"), "label", "refs"), edges(units).withColumn("relation", F.lit(None).cast("string"))

    def f(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for unit, text in b[["unit", "text"]].itertuples(index=False):
                try:
                    said = model(text or "")
                except Exception:
                    continue
                rows += [("entity", x.get("label"), None, 1, None, [str(r) for r in x.get("eu_refs", [unit])]) for x in said.get("entities", [])]
                rows += [("relation", x.get("source"), x.get("target"), x.get("weight", 1), x.get("relation"), []) for x in said.get("relations", [])]
            yield pd.DataFrame(rows, columns=["kind", "a", "b", "weight", "relation", "refs"])

    said = cut(units.select(F.col("unit").cast("string"), "text").mapInPandas(f, "kind string, a string, b string, weight bigint, relation string, refs array<string>"))
    entities = said.filter("kind = 'entity'").select(F.col("a").alias("label"), "refs")
    relations = said.filter("kind = 'relation'").select(F.col("a").alias("source"), F.col("b").alias("target"), "weight", "relation")
    return sane(entities, relations, units)


def key_edges(sources: DataFrame) -> DataFrame:
    """(document_id, source, target, relation): references between the tables of DDL texts and between the parts of OpenAPI ones. ``sources``: (document_id, content, source_type)."""
    from lodestone.sources import extract

    def f(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for doc, content, kind in b.itertuples(index=False):
                text = bytes(content or b"").decode(errors="replace")
                if kind == "ddl":
                    rows += [(doc, a, c, "foreign key") for a, c in extract.foreign_keys(text)]
                elif kind == "openapi":
                    rows += [(doc, a, c, "reference") for a, c in extract.references(text)]
            yield pd.DataFrame(rows, columns=["document_id", "source", "target", "relation"])

    return sources.select("document_id", "content", "source_type").mapInPandas(f, "document_id string, source string, target string, relation string").distinct()


def structural(symbols: DataFrame, calls: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label, path, refs), (source, target, relation, confidence): an exported graph of code symbols, grounded in units that hold their lines.

    ``symbols``: (label, path, line), ``calls``: (source, target, relation,
    confidence), ``units``: (eu_id, path, first, last). A symbol outside all
    units goes, and so do the edges that touch it.
    """
    within = (F.col("s.path") == F.col("u.path")) & F.col("s.line").between(F.col("u.first"), F.col("u.last"))
    held = symbols.alias("s").join(units.alias("u"), within).groupBy("s.label", "s.path").agg(F.array_sort(F.collect_set("u.eu_id")).alias("refs"))
    kept = held.select("label").distinct()
    edge = calls.join(kept.withColumnRenamed("label", "source"), "source", "left_semi").join(kept.withColumnRenamed("label", "target"), "target", "left_semi")
    return held, edge.select("source", "target", "relation", "confidence")
