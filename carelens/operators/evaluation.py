"""Classification evaluation over ``(actual, predicted)`` columns.

All metrics come from one count per ``(actual, predicted)`` cell: each
cell contributes to the support of its actual label, the predicted count of
its predicted label and, on the diagonal, the true positives, so one scan
and one small second aggregate give the per-label marginals. Macro F1 averages over labels seen in
either column; F1 is 0 where its denominator is 0 (``zero_division=0``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _hit(actual: str, predicted: str):
    return F.col(actual).eqNullSafe(F.col(predicted))


def accuracy(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """total, correct, accuracy (0 when there are no rows)."""
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.count_if(_hit(actual, predicted)).cast("bigint").alias("correct")) \
        .select("total", "correct",
                F.round(F.coalesce(F.try_divide(F.col("correct"), F.col("total")),
                                   F.lit(0.0)), 6).alias("accuracy"))


def cell_counts(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(actual, predicted, n) for the cells that occur."""
    return (df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))
            .agg(F.count(F.lit(1)).alias("n")))


def label_marginals(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """label, support, predicted_count, tp, precision, recall, f1."""
    cells = cell_counts(df, actual, predicted)
    n, none = F.col("n"), F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("actual").alias("label"), n.alias("support"), none.alias("predicted_count"),
                 F.when(F.col("actual").eqNullSafe(F.col("predicted")), n).otherwise(none).alias("tp")),
        F.struct(F.col("predicted").alias("label"), none.alias("support"), n.alias("predicted_count"),
                 none.alias("tp")))
    m = (cells.select(F.inline(sides)).groupBy("label")
         .agg(F.sum("support").alias("support"), F.sum("predicted_count").alias("predicted_count"),
              F.sum("tp").alias("tp")))
    zero = F.lit(0.0)
    return m.select(
        "label", "support", "predicted_count", "tp",
        F.coalesce(F.try_divide(F.col("tp"), F.col("predicted_count")), zero).alias("precision"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("support")), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("tp"), F.col("predicted_count") + F.col("support")),
                   zero).alias("f1"))


def f1_summary(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """accuracy, macro_f1, weighted_f1 in one row."""
    m = label_marginals(df, actual, predicted)
    # Every row has exactly one actual label, so the marginals carry the
    # totals too: one aggregate over the (small) per-label table.
    s = m.agg(F.sum("support").alias("total"), F.sum("tp").alias("correct"),
              F.avg("f1").alias("macro_f1"),
              F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))
    zero = F.lit(0.0)
    return s.select(
        F.coalesce("total", F.lit(0)).cast("bigint").alias("total"),
        F.coalesce("correct", F.lit(0)).cast("bigint").alias("correct"),
        F.round(F.coalesce(F.try_divide(F.col("correct"), F.col("total")), zero), 6).alias("accuracy"),
        F.round(F.coalesce("macro_f1", zero), 6).alias("macro_f1"),
        F.round(F.coalesce("weighted_f1", zero), 6).alias("weighted_f1"))


def classification_report(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Per-label precision/recall/f1/support, then accuracy, macro avg and
    weighted avg rows (labels from both columns, sorted)."""
    m = label_marginals(df, actual, predicted)
    per = m.select(F.col("label").alias("row_label"), "precision", "recall", "f1", "support",
                   F.lit(0).alias("section"))
    tot = m.agg(F.sum("support").alias("n"),
                F.sum("tp").alias("tp"),
                F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                F.try_divide(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("wp"),
                F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("wr"),
                F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("wf"))
    def row(label, p, r, f, sec):
        return F.struct(F.lit(label).alias("row_label"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1"),
                        F.col("n").alias("support"), F.lit(sec).alias("section"))
    acc = F.coalesce(F.try_divide(F.col("tp"), F.col("n")), F.lit(0.0))
    summary = tot.select(F.inline(F.array(
        row("accuracy", F.lit(None), F.lit(None), acc, 1),
        row("macro avg", F.col("mp"), F.col("mr"), F.col("mf"), 2),
        row("weighted avg", F.col("wp"), F.col("wr"), F.col("wf"), 3))))
    return per.unionByName(summary).select(
        "row_label",
        F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"),
        F.round("f1", 6).alias("f1_score"), F.col("support").cast("bigint").alias("support"),
        F.col("section").cast("int").alias("section"))


def confusion_matrix_long(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """``(actual, predicted, n)`` over the actual labels on both axes, zero
    cells included; predictions outside these labels are not counted.

    Each actual label is expanded over the array of all of them (a scalar
    subquery) and takes its count by a left join: no pivot list, nothing
    pulled to the driver, any label text.
    """
    cells = cell_counts(df, actual, predicted)
    labels = cells.select("actual").where(F.col("actual").isNotNull()).distinct()
    axis = labels.agg(F.array_sort(F.collect_set("actual"))).scalar()
    grid = labels.select("actual", F.explode(axis).alias("predicted"))
    return (grid.join(cells, ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def confusion_matrix_wide(df: DataFrame, labels: list[str], actual: str = "actual",
                          predicted: str = "predicted") -> DataFrame:
    """Rows = actual label, one count column per label of the given list."""
    return (df.filter(F.col(actual).isin(labels))
            .groupBy(F.col(actual).alias("actual"))
            .pivot(predicted, labels).count().na.fill(0))


def confusion_pairs(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                    k: int = 10) -> DataFrame:
    """Most frequent (actual -> predicted) errors, top k."""
    errs = cell_counts(df.filter(~_hit(actual, predicted)), actual, predicted)
    return errs.orderBy(F.desc("n"), "actual", "predicted").limit(k)


def align(golden: DataFrame, predictions: DataFrame, key: str, order: str) -> DataFrame:
    """Golden labels and predictions joined on ``key``: key, actual, predicted, status.

    ``golden`` holds ``key, actual`` (one row a key), ``predictions`` ``key,
    predicted`` and ``order``: of several predictions for a key the last in
    that order counts (then the largest). A key on one side only stays, as
    ``missing_prediction`` or ``extra_prediction``; NULL keys match nothing.
    """
    last = (predictions.groupBy(key)
            .agg(F.max(F.struct(F.col(order), F.col("predicted"))).alias("_last"))
            .select(key, F.col("_last.predicted").alias("predicted"), F.lit(True).alias("_p")))
    both = golden.select(key, "actual", F.lit(True).alias("_g")).join(last, key, "full_outer")
    status = (F.when(F.col("_p").isNull(), "missing_prediction")
              .when(F.col("_g").isNull(), "extra_prediction").otherwise("matched"))
    return both.select(key, "actual", "predicted", status.alias("status"))


def misclassified(df: DataFrame, key: str, actual: str = "actual",
                  predicted: str = "predicted") -> DataFrame:
    """All rows whose prediction differs (null-safe)."""
    return df.filter(~F.col(actual).eqNullSafe(F.col(predicted)))


def majority_label(df: DataFrame, actual: str = "actual") -> DataFrame:
    """One row: the most frequent actual label (ties -> smallest label)."""
    return (df.groupBy(F.col(actual).alias("majority_label")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "majority_label").limit(1).select("majority_label"))


def majority_baseline(df: DataFrame, actual: str = "actual") -> DataFrame:
    """Evaluate the constant majority-class prediction.

    One count per label is enough: the majority label's true positives are
    its support, and it is predicted for every row.
    """
    counts = (df.groupBy(F.col(actual).alias("label")).agg(F.count(F.lit(1)).alias("support")))
    # The winner is the largest (count, then smallest label) of one small table.
    s = counts.agg(F.sum("support").alias("total"), F.count(F.lit(1)).alias("k"),
                   F.min(F.struct((-F.col("support")).alias("neg"), F.col("label").alias("label"))).alias("top"))
    total, hit = F.col("total"), -F.col("top.neg")
    f1 = F.coalesce(F.try_divide(2 * hit, total + hit), F.lit(0.0))
    zero = F.lit(0.0)
    return s.select(
        F.col("top.label").alias("majority_label"),
        F.coalesce(total, F.lit(0)).cast("bigint").alias("total"),
        F.coalesce(hit, F.lit(0)).cast("bigint").alias("correct"),
        F.round(F.coalesce(F.try_divide(hit, total), zero), 6).alias("accuracy"),
        F.round(F.coalesce(F.try_divide(f1, F.col("k")), zero), 6).alias("macro_f1"),
        F.round(F.coalesce(F.try_divide(f1 * hit, total), zero), 6).alias("weighted_f1"))
