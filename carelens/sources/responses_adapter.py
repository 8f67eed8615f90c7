"""Response and human-score tables derived from the pairs table.

The driver tables hold no language-model output. Like the message adapter,
these functions shape one from the rows that are there, with a fixed spread
of shapes (clean JSON, fenced, prose around, missing field, bad decision or
score, no JSON), so the parsers run over a table that grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelens.functions import text as tx
from carelens.sources.adapter import TURNS


def _pick(index: Column, values: list[Column]) -> Column:
    expr = None
    for i, v in enumerate(values):
        expr = F.when(index == i, v) if expr is None else expr.when(index == i, v)
    return expr


def agent_responses(pairs: DataFrame) -> DataFrame:
    """(request_id, response) with six response shapes."""
    b = F.col("brand_tweet_id")
    reply = tx.clean_reply(F.col("brand_text"))
    reason = F.concat(F.lit("Reply "), b.cast("string"))
    full = lambda d: F.to_json(F.struct(reply.alias("reply"), F.lit(d).alias("decision"),
                                        reason.alias("reason")))
    shapes = [
        full("AUTO-HANDLE"),
        F.concat(F.lit("```json\n"), full("ESCALATE"), F.lit("\n```")),
        F.to_json(F.struct(reply.alias("reply"), F.lit("ESCALATE").alias("decision"))),
        full("MAYBE"),
        full(" escalate "),
        reply,
    ]
    return pairs.select(b.alias("request_id"), _pick(b % 6, shapes).alias("response"))


def judge_responses(pairs: DataFrame) -> DataFrame:
    """(request_id, response) with seven judge-output shapes."""
    b = F.col("brand_tweet_id")
    return pairs.select(b.alias("request_id"), _judge_shape(b).alias("response"))


def _judge_shape(b: Column) -> Column:
    s = ((b % 5) + 1).cast("string")
    shapes = [
        F.concat(F.lit('{"score": '), s, F.lit(', "reason": "plain"}')),
        F.concat(F.lit('```json\n{"score": '), s, F.lit(', "reason": "fenced"}\n```')),
        F.concat(F.lit('Here is my review: {"score": '), s, F.lit(', "reason": "prose"} Thanks.')),
        F.lit('{"score": 0, "reason": "too low"}'),
        F.lit('{"score": 4.7, "reason": "decimal"}'),
        F.lit('{"score": "4", "reason": "text"}'),
        F.lit("I cannot score this reply."),
    ]
    return _pick(b % 7, shapes)


def human_scores(pairs: DataFrame) -> DataFrame:
    """(request_id, human_score) as text that may not be a number."""
    conv = F.shiftright(F.col("customer_tweet_id"), TURNS.bit_length() - 1)
    text = F.when(conv % 9 == 0, F.lit("n/a")).otherwise(((conv % 5) + 1).cast("string"))
    return pairs.select(F.col("brand_tweet_id").alias("request_id"), text.alias("human_score"))
