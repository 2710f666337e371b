"""Mixing of sources to target weights, by weighted fair queueing.

Each source's documents are put in a seeded random order; a document's virtual
finish time is the tokens of its source up to and with it, divided by the
source's weight. All documents in the order of that time form the mixture: at
any point each source that isn't used up has spent tokens in proportion to its
weight. A source that runs out isn't repeated: the rest of the budget goes to
the others by their weights, so the mixture then falls short of that source's
share. The mixture ends where its running total of tokens would pass the budget.

Tokens are whitespace words; a text in a script without spaces counts as few of
them, so such a source should be given its weight in the same measure.

The running totals are taken by ranges of the order (see ``common.ranged``),
which hold equal numbers of rows whatever the weights, so a source or a time
span of any size is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORDS, cut, pack, ranged, running

SEED = "mix-1"
SHARE = 0.5
"""Of all tokens, the part that is the default budget."""
TARGET, OTHERS = {"src0": 1.0, "src1": 4.0, "src2": 2.0, "src3": 0.5}, 1.0
"""Weights of the registered query and of the pipeline: by source, and of all sources that aren't named."""


def tokens(text: str = "text") -> Column:
    """Whitespace words of a text; a null text has none."""
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(WORDS), F.lit(0))).cast("bigint"), F.lit(0))


def shuffle_key(seed: str, doc_id: str) -> Column:
    """A random order that is the same everywhere: the MD5 of seed and id, as hexadecimal digits."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))


def _weight(source: Column, weights: Mapping[str, float] | None, others: float) -> Column:
    if not weights:
        return F.lit(1.0)
    pairs = [x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.create_map(*pairs)[source], F.lit(float(others)))


def _tie(text: str = "text") -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def finish_times(docs: DataFrame, weights: Mapping[str, float] | None, others: float, seed: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, tokens, _tie, _key, _weight, _cum, _vft) of the documents whose source has a weight, and the budget's base: one row with the tokens of all."""
    light = docs.select("doc_id", "source", tokens().alias("tokens"), _tie().alias("_tie"), shuffle_key(seed, "doc_id").alias("_key"), F.monotonically_increasing_id().alias("_no"))
    df = cut(light.withColumn("_weight", _weight(F.col("source"), weights, others)).filter("_weight > 0"))
    total = df.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("_total"))
    within = [F.col("_key"), F.col("doc_id"), F.col("_tie"), F.col("_no")]  # the last tells equal rows apart
    df = running(ranged(df, [F.col("source"), *within]), "tokens", within, F.col("_piece"), ["source"], "_cum")
    return cut(df.withColumn("_vft", F.col("_cum").cast("double") / F.col("_weight"))), total


def _within_budget(df: DataFrame, total: DataFrame, budget: int | None, share: float) -> DataFrame:
    order = [F.col("_vft"), F.col("source"), F.col("_key"), F.col("doc_id"), F.col("_tie"), F.col("_no")]
    df = running(ranged(df, order), "tokens", order, F.col("_piece"), out="mixture_tokens")
    if budget is not None:
        return df.filter(F.col("mixture_tokens") <= budget)
    most = F.floor(F.col("_total") * F.lit(share))
    return df.crossJoin(F.broadcast(total)).filter(F.col("mixture_tokens") <= most)  # one row


def mixture(docs: DataFrame, weights: Mapping[str, float] | None = None, budget: int | None = None, share: float = SHARE, seed: str = SEED, others: float = 0.0) -> DataFrame:
    """(doc_id, source, tokens, virtual_finish, mixture_tokens) of the chosen documents, in the order of the mixture.

    ``weights``: by source; without them all sources weigh the same, with them a
    source that isn't named, a null one among them, weighs ``others``; a source
    of weight 0 gives nothing. ``budget``: tokens; by default ``share`` of those
    of all sources that have a weight. A null source is a source of its own; a
    null or empty text has no tokens and is free; a text of any length is one
    document. Repeated rows count each. Ties go by source, key, doc_id and the
    text's MD5. An empty table gives no rows. Other columns are not read, so
    their names can't clash.
    """
    light, total = finish_times(docs, weights, others, seed)
    chosen = _within_budget(light, total, budget, share)
    placed = chosen.orderBy("_vft", "source", "_key", "doc_id", "_tie")
    return placed.select("doc_id", "source", "tokens", F.col("_vft").alias("virtual_finish"), "mixture_tokens")


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, budget: int | None = None, share: float = SHARE, seed: str = SEED, others: float = 0.0) -> DataFrame:
    """The chosen documents themselves, all columns as they are, range-sorted in the order of the mixture; as many rows of each as ``mixture`` has. Cases as for it.

    Rows are found again by source, doc_id and the text's MD5. Within a source
    the mixture is a prefix of the shuffled order, so one bound a source tells
    what is in it: only chosen texts are shuffled. Equal rows are collapsed to
    one with their number and written out again, so many of them are one row on
    their way.
    """
    light, total = finish_times(docs, weights, others, seed)
    chosen = cut(_within_budget(light, total, budget, share).select("source", "doc_id", "_key", "_tie", "tokens", "_cum", "_weight"))
    at = F.struct("_key", "doc_id", "_tie")
    bounds = chosen.groupBy(F.col("source").alias("_of")).agg(F.max(at).alias("_bound"))
    keys = ["source", "doc_id", "_tie"]
    places = chosen.groupBy(*keys).agg(F.min("_cum").alias("_first"), F.first("tokens").alias("_tokens"), F.first("_weight").alias("_weight"), F.count("*").alias("_some"))
    copies = light.groupBy(*[F.col(c).alias(f"_{c}2") for c in keys]).agg(F.count("*").alias("_all"))
    places = places.join(copies, [F.col(c).eqNullSafe(F.col(f"_{c}2")) for c in keys]).select(*[F.col(c).alias(f"_{c}2") for c in keys], "_first", "_tokens", "_weight", "_some", "_all")
    rows = pack(docs).withColumns({"source": F.col("_row.source"), "doc_id": F.col("_row.doc_id"), "_tie": _tie("_row.text")}).withColumn("_key", shuffle_key(seed, "doc_id"))
    rows = rows.join(bounds, F.col("source").eqNullSafe(F.col("_of"))).filter(at <= F.col("_bound"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}2")) for c in keys]
    placed = rows.join(places.filter("_all = 1"), same).select("_row", "source", "_key", "doc_id", "_tie", (F.col("_first").cast("double") / F.col("_weight")).alias("_vft"))
    again = cut(places.filter("_all > 1"))
    if not again.isEmpty():
        ours = ["_row", "source", "_key", "doc_id", "_tie", "_first", "_tokens", "_weight", "_some"]
        kinds = rows.join(again, same).groupBy(*ours).agg(F.count("*").alias("_n"))
        before = F.sum("_n").over(Window.partitionBy("source", "doc_id", "_tie").orderBy(F.xxhash64("_row")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
        kinds = kinds.withColumn("_before", before).withColumn("_take", F.least(F.col("_n"), F.col("_some") - F.col("_before"))).filter("_take > 0")
        each = kinds.withColumn("_i", F.explode(F.sequence(F.col("_before"), F.col("_before") + F.col("_take") - 1)))
        vft = (F.col("_first") + F.col("_i") * F.col("_tokens")).cast("double") / F.col("_weight")
        placed = placed.unionByName(each.select("_row", "source", "_key", "doc_id", "_tie", vft.alias("_vft")))
    return placed.orderBy("_vft", "source", "_key", "doc_id", "_tie").select("_row.*")


def oracle(documents: str = "documents", weights: Mapping[str, float] = TARGET, others: float = OTHERS, share: float = SHARE, seed: str = SEED) -> str:
    """DuckDB SQL for ``mixture`` with the default budget."""
    weight = "CASE source " + " ".join(f"WHEN '{k}' THEN {float(v)}::DOUBLE" for k, v in sorted(weights.items())) + f" ELSE {float(others)}::DOUBLE END"
    return f"""
WITH light AS (SELECT * FROM (SELECT doc_id, source, {weight} AS weight, CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0) AS BIGINT) AS tokens,
    md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k, md5(coalesce(text, '')) AS tie FROM {documents}) WHERE weight > 0),
timed AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, tie ROWS UNBOUNDED PRECEDING) AS DOUBLE) / weight AS vft FROM light),
mixed AS (SELECT *, CAST(sum(tokens) OVER (ORDER BY vft, source NULLS FIRST, k, doc_id NULLS FIRST, tie ROWS UNBOUNDED PRECEDING) AS BIGINT) AS mixture_tokens FROM timed)
SELECT doc_id, source, tokens, vft AS virtual_finish, mixture_tokens FROM mixed
WHERE mixture_tokens <= floor((SELECT coalesce(sum(tokens), 0) FROM light) * {share})"""
