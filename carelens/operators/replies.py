"""Choosing a historical reply and building grounded prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.functions import lexicon as lx
from carelens.functions import policy, prompts
from carelens.functions import text as tx


def with_replies(rows: DataFrame) -> DataFrame:
    """``rows`` with ``reply`` (the cleaned ``brand_text``) and whether it is ``useful``.

    Both depend on the historical row alone: adding them to the history before the search cleans
    a reply once and not for every query that finds it. Rows that have them stay as they are.
    """
    if "reply" in rows.columns:
        return rows
    cleaned = rows.withColumn("reply", tx.clean_reply(F.col("brand_text")))
    return cleaned.withColumn("useful", policy.is_useful_reply(F.col("reply")))


def best_reply(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Per query: among its retrieved rows with a non-empty cleaned reply,
    prefer useful replies, then higher similarity, then earlier rank;
    queries without any candidate get the fixed fallback reply.

    ``max_by(reply, struct(useful, similarity, -rank))`` is a plain
    aggregate over at most k rows per query.
    """
    cand = with_replies(results).select("qid", "rank", "similarity", "reply", "useful").filter(F.length("reply") > 0)
    best = cand.groupBy("qid").agg(
        F.max_by(F.struct("reply", "useful", "similarity", "rank"),
                 F.struct("useful", "similarity", (-F.col("rank")).alias("neg_rank"))).alias("b"))
    return (queries.select("qid").join(best, "qid", "left")
            .select("qid",
                    F.coalesce(F.col("b.reply"), F.lit(lx.FALLBACK_REPLY)).alias("best_reply"),
                    F.col("b.useful").alias("useful"),
                    F.col("b.similarity").alias("similarity"),
                    F.col("b.rank").alias("source_rank"),
                    F.col("b").isNull().alias("used_fallback")))


def grounded_prompts(queries: DataFrame, results: DataFrame) -> DataFrame:
    """One prompt per query: its examples in rank order, joined by a
    newline, inside the grounded template."""
    ex = with_replies(results).select("qid", "rank", prompts.example_block(
        F.col("rank"), F.col("text"), F.col("reply"), F.col("similarity")).alias("example"))
    joined = ex.groupBy("qid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "example"))),
                                 lambda s: s["example"]), "\n").alias("examples"))
    return (queries.select("qid", "text", "intent").join(joined, "qid", "left")
            .select("qid", "intent",
                    prompts.grounded_prompt(F.col("text"), F.col("intent"),
                                            F.coalesce("examples", F.lit(""))).alias("prompt")))
