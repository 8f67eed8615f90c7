"""SparkSession construction and shared-folder helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Session settings that matter at scale: AQE re-plans joins from real
# shuffle sizes (broadcast only when the measured side is small), splits
# skewed join partitions and coalesces tiny ones; the UI stays off.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.sources.bucketing.enabled": "true",
    # Text work is heavy for its bytes: small files are cut to splits of one megabyte at least, not four.
    "spark.sql.files.openCostInBytes": "1m",
}


def get_spark(
    app: str = "carelens",
    cores: int | str | None = None,
    shuffle_partitions: int | None = None,
    driver_memory: str = "16g",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Local session for tests and the bench; clusters pass their own conf."""
    cores = cores or os.environ.get("BENCH_CPUS") or "*"
    builder = SparkSession.builder.appName(app).config(
        "spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    if "PYSPARK_GATEWAY_PORT" not in os.environ:  # not started by spark-submit
        builder = (builder.master(f"local[{cores}]").config("spark.driver.memory", driver_memory)
                   .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="carelens-")))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_ROOT = Path(__file__).resolve().parents[1]
_sent: set[str] = set()


def importable(spark: SparkSession) -> None:
    """Send this package to the Python workers if nothing shows that they find it themselves."""
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app not in _sent and str(_ROOT) not in {os.path.realpath(p) for p in known if p}:
        to = tempfile.mkdtemp(prefix="carelens-package-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{to}/carelens", "zip", _ROOT, "carelens"))
    _sent.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a folder in the session's warehouse, which every
    executor reaches too.
    """
    own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/carelens-scratch"
    return (spark.conf.get("spark.checkpoint.dir", None) or own).rstrip("/")


CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_once(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder as Parquet and read back, and its path.

    What was shuffled for the write is not needed again: Spark removes it at the end.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.mode("errorifexists").options(**options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder, as Parquet, and read it back.

    Used where one derived input feeds several branches of a plan: the
    branches then scan the written files (with column pruning and
    statistics) instead of re-deriving it, and the lineage is cut, so
    losing an executor later does not replay the whole chain.
    """
    return write_once(df, "table")[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under this application's part of the shared folder."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/carelens-{spark.sparkContext.applicationId}"


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application has written for itself; its results must be stored by now."""
    delete_path(spark, _own(spark))
