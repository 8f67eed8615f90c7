"""Handling policy and reply-usefulness Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carelens.functions import lexicon as lx


def handling(intent: Column, text: Column) -> Column:
    """``struct(decision, reason, basis)``: escalation intents first, then
    sensitive substrings of the lowered text, else auto-handle."""
    lowered = F.lower(text)
    by_intent = intent.isin(lx.ESCALATION_INTENTS)
    by_pattern = lx.contains_any(lowered, lx.SENSITIVE_PATTERNS)
    return (F.when(by_intent, F.struct(F.lit(lx.ESCALATE).alias("decision"),
                                       F.lit(lx.REASON_INTENT).alias("reason"),
                                       F.lit("intent").alias("basis")))
            .when(by_pattern, F.struct(F.lit(lx.ESCALATE).alias("decision"),
                                       F.lit(lx.REASON_PATTERN).alias("reason"),
                                       F.lit("pattern").alias("basis")))
            .otherwise(F.struct(F.lit(lx.AUTO_HANDLE).alias("decision"),
                                F.lit(lx.REASON_DEFAULT).alias("reason"),
                                F.lit("default").alias("basis"))))


def is_useful_reply(reply: Column) -> Column:
    """No vague phrase and at least one useful phrase (lowered substring).
    NULL reply -> false."""
    lowered = F.lower(reply)
    vague = lx.contains_any(lowered, lx.VAGUE_REPLY_PATTERNS)
    useful = lx.contains_any(lowered, lx.USEFUL_REPLY_PATTERNS)
    return F.coalesce(~vague & useful, F.lit(False))
