"""Readers for the message log, labelled sets and judge calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.functions.text import py_strip
from carelens.sources import schemas

# FIXED VALUES (must equal the reference): candidate column names, in
# the order they are tried.
TEXT_CANDIDATES = ["customer_text", "customer", "text", "tweet", "message"]
LABEL_CANDIDATES = ["intent", "label", "actual_intent", "gold_intent"]


def resolve_column(df: DataFrame, candidates: Sequence[str]) -> str:
    """First candidate present in the schema (schema-only, no job)."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {list(candidates)} in columns {df.columns}")


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def read_messages_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw message log CSV (quoted, multi-line text). A multi-line CSV is
    not splittable, so land it once as Parquet (``write_parquet``) and
    scan that."""
    return (spark.read.schema(schemas.MESSAGES).option("header", True)
            .option("multiLine", True).option("escape", '"').csv(path))


def load_history(pairs: DataFrame, strip: bool = False) -> DataFrame:
    """Historical pairs for retrieval: both texts present, cast to string,
    optionally stripped of surrounding Unicode whitespace."""
    require_columns(pairs, ["customer_text", "brand_text"])
    out = pairs.dropna(subset=["customer_text", "brand_text"])
    ct = F.col("customer_text").cast("string")
    bt = F.col("brand_text").cast("string")
    if strip:
        ct, bt = py_strip(ct), py_strip(bt)
    return out.withColumns({"customer_text": ct, "brand_text": bt})


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(schemas.GOLDEN).option("header", True)
            .option("multiLine", True).option("escape", '"').csv(path))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(schemas.PREDICTIONS).option("header", True)
            .option("multiLine", True).option("escape", '"').csv(path))


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Judge calibration rows. The file is ragged: extra unquoted commas
    push the human score to field 6 and spill the notes over fields 7-9,
    so it is read positionally and the notes re-joined with ','."""
    raw = (spark.read.schema(schemas.CALIBRATION_RAW).option("header", True)
           .option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE")
           .csv(path))
    return raw.select(
        "customer_text", "generated_reply",
        F.expr("try_cast(llm_judge_score AS INT)").alias("llm_judge_score"),
        "llm_judge_reason",
        F.expr("try_cast(human_score AS INT)").alias("human_score"),
        F.concat_ws(",", "note1", "note2", "note3").alias("human_notes"),
    )
