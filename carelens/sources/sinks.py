"""Sinks: pair samples, labelling templates, training sets, judge rows,
fitted models. Parquet by default; CSV with a header where a person
edits the file (labelling templates)."""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


# Batches appended to a table that readers may be reading. A batch is written to a folder of
# its own attempt first; one small manifest file, created exclusively, then commits it. A failed
# or repeated attempt leaves a folder that no manifest names, which readers pass over.

_BATCH = "batch=%s/attempt=%s"
_MANIFEST = "_manifest"


def _fs(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as its object."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def append_batch(df: DataFrame, path: str, batch_id: str) -> bool:
    """Append ``df`` once under ``batch_id``; False if that batch is committed already.

    Safe to repeat after any failure, and by several writers at a time: the first
    manifest wins, and the folder of a loser is deleted.
    """
    if not re.fullmatch(r"[A-Za-z0-9_-]+", batch_id):
        raise ValueError(f"batch id {batch_id!r}: letters, digits, _ and - only")
    spark = df.sparkSession
    fs, manifest = _fs(spark, f"{path}/{_MANIFEST}/{batch_id}")
    if fs.exists(manifest):
        return False
    attempt = uuid.uuid4().hex
    folder = f"{path}/{_BATCH % (batch_id, attempt)}"
    df.write.mode("errorifexists").parquet(folder)
    try:
        out = fs.create(manifest, False)
    except Py4JJavaError:
        if not fs.exists(manifest):
            raise
        fs.delete(_fs(spark, folder)[1], True)
        return False
    out.write(bytearray(f"{batch_id},{attempt}\n".encode()))
    out.close()
    return True


def read_batches(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows of all committed batches, with their ``batch``.

    The manifest is joined to the batch and attempt folders, which are partition
    columns, so Spark prunes the folders of attempts that were not committed.
    """
    rows = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    fs, manifest = _fs(spark, f"{path}/{_MANIFEST}")
    whole = StructType([*rows.fields, StructField("batch", StringType()), StructField("attempt", StringType())])
    if not fs.exists(manifest):
        return spark.createDataFrame([], whole).drop("attempt")
    committed = spark.read.schema("batch string, attempt string").csv(f"{path}/{_MANIFEST}")
    return spark.read.schema(whole).parquet(path).join(committed, ["batch", "attempt"], "left_semi").select(
        *rows.names, "batch")
