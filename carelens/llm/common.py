"""Shared helpers of the corpus operators.

Row-wise operators run as ``mapInArrow``: Spark cuts the input into
batches bounded in rows and bytes, and a batch is all a task holds.
Intermediate tables are written to the shared folder named by
``spark.checkpoint.dir`` (:func:`written`), so a lost executor costs the
tasks it ran, not the chain before them.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.session import delete_path, importable, write_once
from carelens.sources.tables import table

__all__ = ["crc_mod", "discard", "documents", "free_name", "importable", "lean", "table", "written"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return table(spark, sf_dir, "documents")


def crc_mod(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id's decimal text modulo ``mod``; NULL for a NULL id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(c.cast("string").cast("binary")) % mod).cast("int")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back."""
    importable(df.sparkSession)
    out, path = write_once(df, name, compression="zstd")
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` returned, when all that is read from them is written."""
    for t in tables:
        delete_path(t.sparkSession, t.scratch_path)


def lean(run: Callable) -> Callable:
    """A task function whose worker gives its memory back when the task ends.

    Workers live on between tasks and stages; what one has freed otherwise stays with
    it while the next stage's JVM needs the room.
    """
    def task(batches):
        yield from run(batches)
        give_back()
    return task


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet (case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name
