"""The query catalog: one ``(spark, sf_dir) -> DataFrame`` per operator.

Each query reads the driver's parquet tables (or what Spark derives from
them) so its work grows with the data. Names match the DuckDB twins in
``carelens.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from carelens.operators import pairing, profiling
from carelens.sources.adapter import BRAND, BRANDS, messages_from_conversations
from carelens.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str | None = None):
    def deco(fn: Query) -> Query:
        REGISTRY[name or fn.__name__] = fn
        return fn
    return deco


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_from_conversations(table(spark, sf_dir, "conversations"))


def pairs(spark: SparkSession, sf_dir: str, brands=BRANDS) -> DataFrame:
    return pairing.pair_conversations(messages(spark, sf_dir), brands)


@register()
def scan_messages(spark, sf_dir):
    return messages(spark, sf_dir)


@register()
def preview_messages(spark, sf_dir):
    return profiling.first_rows(messages(spark, sf_dir), ["tweet_id", "seq"], 10)


@register()
def direction_counts(spark, sf_dir):
    return profiling.direction_counts(messages(spark, sf_dir))


@register()
def top_authors(spark, sf_dir):
    return profiling.top_authors(messages(spark, sf_dir))


@register()
def link_counts(spark, sf_dir):
    return profiling.link_counts(messages(spark, sf_dir))


@register()
def brand_replies(spark, sf_dir):
    return pairing.brand_replies(messages(spark, sf_dir), BRANDS)


@register()
def dedupe_messages(spark, sf_dir):
    return pairing.keep_last(messages(spark, sf_dir))


@register()
def answered_customer_messages(spark, sf_dir):
    return pairing.answered_customer_messages(messages(spark, sf_dir), BRANDS)


@register()
def pair_conversations(spark, sf_dir):
    return pairing.pairs_as_strings(pairs(spark, sf_dir))


@register()
def orphan_replies(spark, sf_dir):
    return pairing.orphan_replies(messages(spark, sf_dir), BRANDS)


@register()
def brand_stats(spark, sf_dir):
    return profiling.brand_stats(spark, messages(spark, sf_dir), BRANDS)


@register()
def pairing_coverage(spark, sf_dir):
    return profiling.pairing_coverage(messages(spark, sf_dir), BRANDS)


@register()
def response_diversity(spark, sf_dir):
    return profiling.response_diversity(pairs(spark, sf_dir))


@register()
def examples_per_brand(spark, sf_dir):
    return profiling.examples_per_brand(pairs(spark, sf_dir))


@register()
def first_pairs(spark, sf_dir):
    p = pairs(spark, sf_dir, [BRAND]).drop("brand")
    return pairing.pairs_as_strings(profiling.first_rows(p, ["brand_tweet_id"], 1000))


def queries() -> dict[str, Query]:
    from carelens.plans import catalog_more, catalog_text  # noqa: F401  (register more)
    return dict(REGISTRY)
