"""Readers and sinks: raw message CSV round trip, templates, appends."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from carelens.operators import judging
from carelens.plans import catalog, catalog_more
from carelens.sources import readers, responses_adapter, sinks
from conftest import SF_SMALL


def test_message_csv_round_trip(spark):
    m = catalog.messages(spark, SF_SMALL).drop("seq")
    path = os.path.join(tempfile.mkdtemp(prefix="carelens-csv-"), "messages")
    sinks.write_csv(m, path)
    back = readers.read_messages_csv(spark, path)
    assert back.schema.names == m.schema.names
    # Multi-line quoted texts survive the round trip.
    assert back.filter(F.col("text").contains("\n")).count() > 0
    diff = m.exceptAll(back).count() + back.exceptAll(m).count()
    assert diff == 0


def test_golden_template_csv(spark):
    g = catalog_more.golden_template(spark, SF_SMALL)
    path = os.path.join(tempfile.mkdtemp(prefix="carelens-gold-"), "golden")
    sinks.write_csv(g, path)
    back = readers.read_golden(spark, path)
    assert back.count() == g.count()
    assert back.filter(F.col("intent").isNotNull() & (F.col("intent") != "")).count() == 0


def calibration(spark):
    pairs = catalog.pairs(spark, SF_SMALL)
    cal = judging.calibration_table(pairs, responses_adapter.judge_responses(pairs), responses_adapter.human_scores(pairs))
    return cal.filter(F.col("llm_judge_score").isNotNull())


def test_append_and_resume(spark):
    rows = calibration(spark)
    path = os.path.join(tempfile.mkdtemp(prefix="carelens-cal-"), "calibration")
    assert sinks.read_batches(spark, path, rows.schema).count() == 0
    first = rows.filter(F.col("request_id") % 2 == 0)
    assert sinks.append_batch(first, path, "b-1")
    done = sinks.read_batches(spark, path, rows.schema)
    todo = judging.pending(rows.withColumnRenamed("request_id", "brand_tweet_id"), done, "brand_tweet_id")
    assert todo.count() == rows.count() - first.count()
    assert sinks.append_batch(todo.withColumnRenamed("brand_tweet_id", "request_id"), path, "b-2")
    merged = sinks.read_batches(spark, path, rows.schema)
    assert merged.count() == rows.count()
    assert {r.batch for r in merged.select("batch").distinct().collect()} == {"b-1", "b-2"}
    assert merged.drop("batch").exceptAll(rows).count() == 0


def test_failed_and_repeated_appends_leave_no_double_rows(spark):
    rows = calibration(spark)
    n = rows.count()
    path = os.path.join(tempfile.mkdtemp(prefix="carelens-cal-"), "calibration")
    broken = rows.withColumn("llm_judge_score", F.when(
        F.col("request_id") == rows.agg(F.max("request_id")).first()[0], F.raise_error(F.lit("lost")).cast("int"))
        .otherwise(F.col("llm_judge_score")))
    with pytest.raises(Exception, match="lost"):
        sinks.append_batch(broken, path, "b-1")
    # A writer that died after its rows and before its manifest: the rows are there, but not committed.
    rows.write.parquet(f"{path}/batch=b-1/attempt=dead")
    assert sinks.read_batches(spark, path, rows.schema).count() == 0
    assert sinks.append_batch(rows, path, "b-1")
    assert not sinks.append_batch(rows, path, "b-1")  # a retry of what had succeeded
    assert sinks.read_batches(spark, path, rows.schema).count() == n
    with pytest.raises(ValueError):
        sinks.append_batch(rows, path, "../b")
