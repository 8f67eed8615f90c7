"""Judge calibration: response tables, agreement, resume and merge
(T10/T11 inputs, A19, A20, J7, U2).

The language-model calls and the human scoring are outside the engine;
the tables of their responses come in, are parsed, joined and compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.functions import responses
from carelens.functions import text as tx


def calibration_table(pairs: DataFrame, judged: DataFrame, human: DataFrame) -> DataFrame:
    """Calibration rows: message, reply, parsed judge score and reason, and
    the human score (NULL where it is not a number).

    ``judged`` holds ``request_id, response``, ``human`` holds ``request_id,
    human_score`` as text; both are joined to the pairs by request id.
    """
    parsed = responses.parse_judge_responses(judged).select("request_id", "score", "reason")
    scores = human.select("request_id", F.col("human_score").try_cast("int").alias("human_score"))
    return (pairs.select(F.col("brand_tweet_id").alias("request_id"), "customer_text",
                         tx.clean_reply(F.col("brand_text")).alias("generated_reply"))
            .join(parsed, "request_id").join(scores, "request_id", "left")
            .select("request_id", "customer_text", "generated_reply",
                    F.col("score").alias("llm_judge_score"), F.col("reason").alias("llm_judge_reason"),
                    "human_score"))


def agreement(cal: DataFrame) -> DataFrame:
    """Judge vs human on rows where both scores are numeric.

    Validity is a condition inside each aggregate rather than a filter:
    a filter on the parsed score would be pushed down through the parse
    steps and re-inline them into the predicate.
    """
    valid = F.col("human_score").isNotNull() & F.col("llm_judge_score").isNotNull()
    h = F.when(valid, F.col("human_score").cast("double"))
    j = F.when(valid, F.col("llm_judge_score").cast("double"))
    return cal.select(h.alias("h"), j.alias("j")).agg(
        F.count("h").alias("n"),
        F.round(F.avg(F.when(F.col("h").isNotNull(), (F.col("h") == F.col("j")).cast("double"))) * 100.0, 6)
        .alias("exact_agreement_pct"),
        F.round(F.avg(F.when(F.col("h").isNotNull(),
                             (F.abs(F.col("h") - F.col("j")) <= 1).cast("double"))) * 100.0, 6)
        .alias("within_one_pct"),
        F.round(F.avg(F.abs(F.col("h") - F.col("j"))), 6).alias("mean_abs_diff"),
        F.round(F.avg("h"), 6).alias("human_mean"),
        F.round(F.avg("j"), 6).alias("judge_mean"),
        F.min("h").cast("int").alias("human_min"), F.max("h").cast("int").alias("human_max"),
        F.min("j").cast("int").alias("judge_min"), F.max("j").cast("int").alias("judge_max"),
        F.round(F.avg(F.col("j") - F.col("h")), 6).alias("mean_judge_minus_human"),
    )


def pending(sample: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Sample rows not yet judged (keyed, not positional)."""
    return sample.join(done.select(F.col("request_id").alias(key)), key, "left_anti")


def merge(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new, allowMissingColumns=True)
