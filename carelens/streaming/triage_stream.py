"""Per-message triage on a stream of incoming messages.

The rule labeller, the handling policy and reply cleaning are stateless
Column functions, so the same expressions run on a streaming DataFrame
unchanged: no state store, no watermark. ``start`` wires a parquet
folder source to any sink with ``availableNow`` (process what is there,
then stop) or a processing-time trigger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from carelens.functions import lexicon as lx
from carelens.functions import policy
from carelens.sources import schemas


def decide(messages: DataFrame) -> DataFrame:
    """Batch or streaming: inbound messages -> intent and decision."""
    d = policy.handling(F.col("intent"), F.col("text"))
    return (messages.filter(F.col("inbound"))
            .withColumn("intent", lx.label_column(F.col("text")))
            .select("tweet_id", "author_id", "intent",
                    d.decision.alias("decision"), d.reason.alias("reason")))


def read_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.MESSAGES)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(folder)


def start(spark: SparkSession, source: str, sink: str, checkpoint: str,
          available_now: bool = True, fmt: str = "parquet") -> StreamingQuery:
    """Start the triage stream; the checkpoint folder keeps progress so a
    restarted query resumes without reprocessing files."""
    w = (decide(read_stream(spark, source)).writeStream.format(fmt)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start(sink)
