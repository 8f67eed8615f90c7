"""The training-data pipeline: five stages, each over all that the last one kept.

``STAGES`` lists (name, function); a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame that is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``docs``, whatever
further columns there are and whatever their names.

NULL and empty texts are not toxic, in no component and not contaminated; the mix
takes a text without words no times, so they end there. Repeated rows and equal
texts are near copies: one row of them stays, of the least id (a NULL id comes first), then of the
least text hash. An empty table goes through all stages and ends in no shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carelens.llm import decontaminate as fm
from carelens.llm import mixing, ngram_join, registry, token_shards, toxicity
from carelens.llm.common import discard, documents, free_name, table, written

#: No SQL states the fitted stages; tests/llm holds run() against its stages done by brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half, as they were."""
    model = registry.toxicity_model(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "score")
    scored = toxicity.score(docs, model, keep=docs.columns, out_col=name)
    return scored.where(F.col(name) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: its least id, of equal ids the least text hash, one row of it.

    Documents without words are in no component and all stay.
    """
    found = ngram_join.join(docs).where("representative").select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k__"), F.col("tkey").alias("t__"),
        (F.col("n_shingles") == 0).alias("empty__")).distinct()
    keyed = docs.select(F.struct("*").alias("row__"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k__"),
                        F.xxhash64(F.coalesce("text", F.lit(""))).alias("t__"))
    kept = keyed.join(found, ["k__", "t__"])
    nth = F.row_number().over(Window.partitionBy("k__", "t__").orderBy("k__"))
    return kept.withColumn("nth__", nth).where("nth__ = 1 or empty__").select("row__.*")


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of benchmark items; columns of any name pass through."""
    names = tuple(free_name(docs, c) for c in fm.NAMES)
    cut = fm.find_contamination(docs, table(spark, sf_dir, "benchmark"), names=names, remove=True)
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.size(names[1]) == 0, F.col("n_chars")).otherwise(length))
    return cut.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.apply_mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order."""
    return token_shards.shards(docs, registry.RANKS)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", cut_benchmarks),
    ("mixing", mix_sources),
    ("token_shards", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the token shards."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
