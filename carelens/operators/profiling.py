"""Profiling aggregates over the message log and the pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carelens.operators import pairing
from carelens.session import materialize


DIGIT = 16  # bits of a value's low part


def upper_medians(counts: DataFrame, group: str, value: str, n: str) -> DataFrame:
    """``group, median``: ``sorted(x)[len(x) // 2]`` of each group, NULLs ignored.

    ``counts`` holds how often (``n``) a group has a value (an integer); it may
    have several rows for one value. The value is found by its digits: a
    histogram of the high parts, at most 2^16 rows a group, names the part
    that holds the middle, and only the values of that part, again at most
    2^16 a group, are put in order. No buffer holds a group's values.
    """
    known = (counts.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("x"))
             .agg(F.sum(n).alias("n")).withColumn("high", F.shiftright("x", DIGIT)))
    rising = Window.partitionBy(group).orderBy("high").rowsBetween(Window.unboundedPreceding, 0)
    parts = (known.groupBy(group, "high").agg(F.sum("n").alias("size"))
             .withColumn("before", F.sum("size").over(rising) - F.col("size"))
             .withColumn("half", F.expr(f"sum(size) OVER (PARTITION BY {group}) DIV 2")))
    middle = (parts.where("before <= half AND half < before + size")
              .select(group, "high", (F.col("half") - F.col("before")).alias("rest")))
    upto = F.sum("n").over(Window.partitionBy(group).orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    middle = middle.withColumnsRenamed({group: "g", "high": "h"})  # a NULL group is one of its own
    return (known.join(middle, F.col(group).eqNullSafe(F.col("g")) & (F.col("high") == F.col("h")))
            .withColumn("upto", upto).where("upto > rest").groupBy(group).agg(F.min("x").cast("bigint").alias("median")))


def mean_of(value: str, n: str) -> Column:
    """Mean of ``value`` over rows that stand for ``n`` rows each, NULLs ignored."""
    return F.sum(F.col(value) * F.col(n)) / F.sum(F.when(F.col(value).isNotNull(), F.col(n)))


def direction_counts(messages: DataFrame) -> DataFrame:
    return messages.agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.count_if(F.col("inbound")).cast("bigint").alias("inbound_messages"),
        F.count_if(~F.col("inbound")).cast("bigint").alias("outbound_messages"),
    )


def top_authors(messages: DataFrame, outbound_k: int = 30, inbound_k: int = 20) -> DataFrame:
    """Most active brand and customer authors, NULL authors dropped.

    One partial+final count per (direction, author); the per-direction
    top-k then runs as a window whose ``rank <= k`` filter Spark turns
    into a partial WindowGroupLimit before the shuffle, so each map task
    ships at most k rows per direction.
    """
    counts = (messages.filter(F.col("inbound").isNotNull() & F.col("author_id").isNotNull())
              .groupBy("inbound", "author_id").agg(F.count(F.lit(1)).alias("n_messages")))
    w = Window.partitionBy("inbound").orderBy(F.desc("n_messages"), F.asc("author_id"))
    ranked = counts.withColumn("rank", F.row_number().over(w))
    # A plain `rank <= k` conjunct is what lets Spark insert the partial
    # limit; the per-direction cut follows.
    return (ranked.filter(F.col("rank") <= max(inbound_k, outbound_k))
            .filter((F.col("inbound") & (F.col("rank") <= inbound_k))
                    | (~F.col("inbound") & (F.col("rank") <= outbound_k)))
            .select(F.when(F.col("inbound"), "inbound").otherwise("outbound").alias("direction"),
                    "author_id", "n_messages", F.col("rank").cast("bigint").alias("rank")))


def link_counts(messages: DataFrame) -> DataFrame:
    return messages.agg(
        F.count("response_tweet_id").alias("with_response_tweet_id"),
        F.count("in_response_to_tweet_id").alias("with_in_response_to_tweet_id"),
    )


def brand_stats(spark: SparkSession, messages: DataFrame, brands: Sequence[str]) -> DataFrame:
    """Per candidate brand: tweets, linked replies, distinct customers,
    mean and upper-median length of linked replies (orphans included).
    Brands without rows are listed with zeros."""
    out = pairing.brand_messages(messages, brands)
    linked_len = F.when(F.col("in_response_to_tweet_id").isNotNull(), F.length("text"))
    # One scan: counts by length, from which both the totals and the median come.
    lengths = materialize(out.groupBy(F.col("author_id").alias("brand"), linked_len.alias("linked_len"))
                          .agg(F.count(F.lit(1)).alias("n"), F.count("in_response_to_tweet_id").alias("linked")))
    per_brand = (lengths.groupBy("brand")
                 .agg(F.sum("n").alias("brand_tweets"), F.sum("linked").alias("linked_replies"),
                      mean_of("linked_len", "n").alias("avg_len"))
                 .join(upper_medians(lengths, "brand", "linked_len", "n"), "brand", "left"))
    # Customer fan-out: a parent answered by several brands counts for each.
    replies = pairing.brand_replies(messages, brands).select("brand", "parent_tweet_id").distinct()
    customers = pairing.customer_messages(messages).select(
        F.col("tweet_id").alias("parent_tweet_id"), F.col("author_id").alias("customer_id"))
    uniq = (replies.join(customers, "parent_tweet_id")
            .groupBy("brand").agg(F.countDistinct("customer_id").alias("unique_customers")))
    # The brand list is a fixed handful of names: broadcasting it is bounded.
    brand_list = F.broadcast(spark.createDataFrame([(b,) for b in brands], "brand string"))
    return (brand_list.join(per_brand, "brand", "left").join(uniq, "brand", "left")
            .select("brand",
                    F.coalesce("brand_tweets", F.lit(0)).cast("bigint").alias("brand_tweets"),
                    F.coalesce("linked_replies", F.lit(0)).cast("bigint").alias("linked_replies"),
                    F.coalesce("unique_customers", F.lit(0)).cast("bigint").alias("unique_customers"),
                    F.round(F.coalesce("avg_len", F.lit(0.0)), 6).alias("avg_reply_length"),
                    F.coalesce("median", F.lit(0)).cast("bigint").alias("median_reply_length")))


def pairing_coverage(messages: DataFrame, brands: Sequence[str]) -> DataFrame:
    """Distinct parent ids referenced by brand replies; customer rows and
    distinct customer ids found for them."""
    parents = pairing.brand_replies(messages, brands).select("parent_tweet_id")
    referenced = parents.agg(F.countDistinct("parent_tweet_id")).scalar()
    return (pairing.answered_customer_messages(messages, brands)
            .agg(F.count(F.lit(1)).alias("matched_customer_rows"),
                 F.countDistinct("tweet_id").alias("matched_customer_ids"))
            .select(referenced.alias("referenced_customer_ids"), "*"))


def response_diversity(pairs: DataFrame) -> DataFrame:
    """Per brand over pairs: count, mean / upper-median length of non-empty
    replies, replies mentioning "dm" (substring of the lowered text) and
    replies containing "?". Brands without pairs do not appear."""
    nonempty_len = F.when(F.length("brand_text") > 0, F.length("brand_text"))
    lengths = materialize(pairs.groupBy("brand", nonempty_len.alias("reply_len")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.lower("brand_text").contains("dm")).alias("dm"),
        F.count_if(F.col("brand_text").contains("?")).alias("question")))
    totals = lengths.groupBy("brand").agg(
        F.sum("n").alias("paired_conversations"),
        F.round(mean_of("reply_len", "n"), 6).alias("avg_reply_length"),
        F.sum("dm").alias("dm_replies"), F.sum("question").alias("question_replies"))
    medians = upper_medians(lengths, "brand", "reply_len", "n")
    return (totals.join(medians.withColumnRenamed("brand", "b"), F.col("brand").eqNullSafe(F.col("b")), "left")
            .select("brand", "paired_conversations", "avg_reply_length",
                    F.col("median").alias("median_reply_length"), "dm_replies", "question_replies"))


def examples_per_brand(pairs: DataFrame, k: int = 10) -> DataFrame:
    """First k pairs per brand in reply-id order (WindowGroupLimit top-k)."""
    w = Window.partitionBy("brand").orderBy("brand_tweet_id")
    return (pairs.withColumn("example_rank", F.row_number().over(w))
            .filter(F.col("example_rank") <= k)
            .select("brand", F.col("example_rank").cast("bigint").alias("example_rank"),
                    "customer_tweet_id", "customer_id", "customer_text",
                    "customer_created_at", "brand_tweet_id", "brand_text"))


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """"First n" made explicit: an order key instead of file order."""
    return df.orderBy(*order).limit(n)
