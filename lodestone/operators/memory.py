"""Conversation memory: pairs of a user's turn and the answer to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X

RING, RECALL = 20, 3


def exchanges(conversations: DataFrame) -> DataFrame:
    """(conv_id, idx, question, answer) of each user's turn that an assistant's follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.withColumns({"_next": F.lead("role").over(w), "_answer": F.lead("text").over(w)})
    return rows.filter("role = 'user' AND _next = 'assistant'").select("conv_id", F.col("turn").alias("idx"), F.col("text").alias("question"), F.col("_answer").alias("answer"))


def ring(turns: DataFrame, most: int = RING) -> DataFrame:
    newest = Window.partitionBy("conv_id").orderBy(F.desc("idx"))
    return turns.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= most).drop("_n")


def recall(queries: DataFrame, turns: DataFrame, limit: int = RECALL) -> DataFrame:
    """(conv_id, idx, hits, rank): turns of the conversation by shared content tokens, later ones first among equals; the newest turns if nothing is shared."""
    t = turns.select("conv_id", "idx", X.tokens(F.concat_ws(" ", "question", "answer")).alias("t"))
    q = queries.select("conv_id", X.content(X.tokens(F.col("query"))).alias("q"))
    hits = t.join(q, "conv_id").select("conv_id", "idx", F.size(F.array_intersect("q", "t")).cast("bigint").alias("hits"))
    most = F.max("hits").over(Window.partitionBy("conv_id"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("hits"), F.desc("idx"))
    kept = hits.withColumn("_most", most).filter("hits > 0 OR _most = 0")
    return kept.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= limit).select("conv_id", "idx", "hits", "rank")


def expanded(queries: DataFrame, turns: DataFrame, limit: int = RECALL) -> DataFrame:
    """(conv_id, query): what is searched for, the recalled turns' texts in their rank before the query; a conversation without any gives the query itself."""
    held = recall(queries, turns, limit).join(turns, ["conv_id", "idx"])
    said = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" ", "question", "answer").alias("t")))), lambda s: s["t"])
    context = held.groupBy("conv_id").agg(F.array_join(said, " ").alias("_c"))
    return queries.join(context, "conv_id", "left").select("conv_id", F.concat_ws(" ", "_c", "query").alias("query"))
