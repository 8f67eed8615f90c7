"""Registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.llm import (
    cotrain, decontaminate, fingerprint, hard_negatives, langid, license_scan, mixing, ngram_join, resample,
    secret_scan, sql, suffix_dedup, token_shards, toxicity)
from carelens.llm.common import crc_mod, documents, table, written

TOKENIZERS = "/opt/tokenizers"
RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Fitted on the labels outside the held-out fold."""
    return toxicity.train(docs, labels.where(crc_mod("doc_id", 5) != 0))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a fifth of the ids is held out of training."""
    docs = documents(spark, sf_dir)
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    held = docs.withColumn("held_out", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)))
    scored = toxicity.score(held, model, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return ngram_join.join(documents(spark, sf_dir)).drop("tkey")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages found in every document."""
    found = decontaminate.find_contamination(
        documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many copies of every document the mix takes."""
    return mixing.mix(documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    return license_scan.scan(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; a fifth of the ids is held out of training."""
    table_x = written(cotrain.features(documents(spark, sf_dir), "doc_id", "text", ["source", "lang"], "n_chars"),
                      "quality-features")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    model = cotrain.train(table_x, labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y")))
    scored = model.score(table_x, ["id"])
    return scored.select(
        F.col("id").alias("doc_id"), F.coalesce(crc_mod("id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a quarter of the ids is held out of training."""
    docs = documents(spark, sf_dir)
    fold = crc_mod("doc_id", 4)
    langs, model = langid.train(docs, fold != 2, PIECES)
    held = docs.withColumn("held_out", F.coalesce(fold == 2, F.lit(False)))
    return langid.predict(held, langs, model, PIECES, keep=["doc_id", "held_out"])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents left when repeated 400-byte strings are removed."""
    return suffix_dedup.dedup(documents(spark, sf_dir))


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token shards in training order, payloads included."""
    return token_shards.shards(documents(spark, sf_dir), RANKS)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint.compare_with_edits(documents(spark, sf_dir))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, with the ownership of their values."""
    return secret_scan.scan(documents(spark, sf_dir))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark's n-grams."""
    drawn = resample.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return drawn.drop("n_words")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; labels of every seventh are moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(vectors, F.col("id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fns = [op1_toxicity, op2_ngram_join, op3_decontaminate, op4_mix_sources, op5_license_scan, op6_quality,
           op7_language_id, op8_suffix_dedup, op9_token_shards, op10_fingerprints, op11_secret_scan, op12_resample,
           op13_hard_negatives]
    return {f.__name__: f for f in fns}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontaminate": sql.DECONTAMINATE,
        "op4_mix_sources": sql.MIXING,
        "op11_secret_scan": sql.SECRETS,
        "op12_resample": sql.RESAMPLE,
        "op13_hard_negatives": sql.HARD_NEGATIVES,
    }
