"""Reproducible samples by hash order.

``sample(n, random_state=42)`` becomes: order rows by
``md5('<seed>:' || key)`` then key, keep the first ``n`` (fewer rows ->
all of them). md5 is byte-identical across engines, so the sample is
oracle-checkable, and it does not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_key(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def hash_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """The ``n`` rows with the smallest hash (ties by key).

    TakeOrderedAndProject: each task keeps its own top n, one task merges
    them.
    """
    x = df.withColumn("_sample_hash", hash_key(key, seed))
    return x.orderBy("_sample_hash", key).limit(n).drop("_sample_hash")
