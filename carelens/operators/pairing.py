"""Reply-to-customer pairing over a message log (joins J1, J2, J9; W9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.session import materialize

MESSAGE_COLS = ["tweet_id", "author_id", "inbound", "created_at", "text",
                "response_tweet_id", "in_response_to_tweet_id"]


def customer_messages(messages: DataFrame) -> DataFrame:
    """Inbound rows; NULL ``inbound`` is on neither side (three-valued)."""
    return messages.filter(F.col("inbound"))


def brand_messages(messages: DataFrame, brands: Sequence[str]) -> DataFrame:
    return messages.filter(~F.col("inbound") & F.col("author_id").isin(list(brands)))


def brand_replies(messages: DataFrame, brands: Sequence[str]) -> DataFrame:
    """Outbound brand rows that answer a parent message, as reply records."""
    return (brand_messages(messages, brands)
            .filter(F.col("in_response_to_tweet_id").isNotNull())
            .select(F.col("author_id").alias("brand"),
                    F.col("tweet_id").alias("brand_tweet_id"),
                    F.col("in_response_to_tweet_id").alias("parent_tweet_id"),
                    F.col("text").alias("brand_text"),
                    F.col("created_at").alias("brand_created_at")))


def keep_last(messages: DataFrame, key: str = "tweet_id", order: str = "seq") -> DataFrame:
    """Keep the last-ingested row per id; ``order`` is unique within an id.

    Late materialisation: only ``key`` and ``order`` are aggregated (two numbers,
    collapsed for a hot id inside every map task), and the join on both fetches the
    rest. Copies of a hot id differ in ``order``, so the join's exchange spreads
    them, and no text is held in an aggregate's buffer.
    """
    last = messages.groupBy(key).agg(F.max(order).alias(order))
    return messages.join(last, [key, order]).select(key, *[c for c in messages.columns if c not in (key, order)], order)


def answered_customer_messages(messages: DataFrame, brands: Sequence[str]) -> DataFrame:
    """Customer rows whose id is the parent of some brand reply (semi join)."""
    # Distinct collapses a hot parent in every map task; a semi join cannot split it.
    parents = brand_replies(messages, brands).select(F.col("parent_tweet_id").alias("tweet_id")).distinct()
    return customer_messages(messages).join(parents, "tweet_id", "left_semi")


def pair_conversations(messages: DataFrame, brands: Sequence[str]) -> DataFrame:
    """One row per brand reply joined to the (deduped) customer message.

    Inner equi join: unmatched replies drop out, a customer message
    answered twice yields two rows. The customer side is unique per id
    after ``keep_last`` and written once: both sides of the join are then
    plain shuffles, which is what lets AQE split a hot parent on the reply
    side (it does not split a join whose other side is an aggregate over
    its own shuffle).
    """
    replies = brand_replies(messages, brands)
    customers = materialize(keep_last(
        customer_messages(messages)
        .join(replies.select(F.col("parent_tweet_id").alias("tweet_id")).distinct(),
              "tweet_id", "left_semi")
        .select("tweet_id", "author_id", "text", "created_at", "seq")))
    return (replies.join(customers, replies.parent_tweet_id == customers.tweet_id, "inner")
            .select("brand",
                    F.col("tweet_id").alias("customer_tweet_id"),
                    F.col("author_id").alias("customer_id"),
                    F.col("text").alias("customer_text"),
                    F.col("created_at").alias("customer_created_at"),
                    "brand_tweet_id", "parent_tweet_id", "brand_text",
                    "brand_created_at"))


def pairs_as_strings(pairs: DataFrame) -> DataFrame:
    """Edge form of the pairs table: ids as canonical decimal strings."""
    return pairs.select(
        *[F.col(c).cast("string").alias(c) if c.endswith("_id") else F.col(c)
          for c in pairs.columns])


def orphan_replies(messages: DataFrame, brands: Sequence[str]) -> DataFrame:
    """Brand replies whose parent is not a customer message (anti join)."""
    replies = brand_replies(messages, brands)
    customers = customer_messages(messages).select(F.col("tweet_id").alias("parent_tweet_id"))
    return replies.join(customers, "parent_tweet_id", "left_anti")
