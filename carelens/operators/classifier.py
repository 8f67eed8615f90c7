"""Intent classifier: TF-IDF features + multinomial logistic regression
(M5, M6, M7, F11), trained and scored with MLlib.

Objective: ``sum_i w_i * logloss_i / n + ||W||^2 / (2 n)`` with balanced class
weights ``w_i = n / (k * n_c)``, which is the reference's objective divided by
``n``; features are not scaled and the intercept is not penalised.

The default fit is deterministic and made of joins and sums: ``STEPS`` accelerated
gradient steps of a fixed length. A step joins the document terms with the
coefficients, sums per document and class, takes the softmax, joins the errors
back and sums per term. The class weights sum to ``n`` and rows have unit length
(and the intercept one more), so the step length 1 is below the inverse curvature
and the loss cannot rise. The same steps are plain SQL, which the registered
queries' twins run. ``solver="mllib"`` fits to MLlib's convergence instead.

Features are the exact TF-IDF rows of ``carelens.operators.vectors``. The
fit uses at most ``max_train_rows`` labelled rows (``MAX_TRAIN_ROWS``, the
rows of the lowest id hash), so the vocabulary, and with it the coefficient
matrix of classes x vocabulary that MLlib keeps on the driver, are bounded
by that parameter. ``None`` fits on every row: the steps keep their coefficients
in tables, nothing of that size is held by one process. Sparse vectors for MLlib's fit are built without Python: its vector type is stored as ``struct<type, size, indices, values>``, so
each document's sorted (index, weight) arrays are written in that layout to
the shared folder and read back with a vector schema.

Scoring covers any number of rows and needs no vectors: the coefficients
are a table ``(term, coefs)``; a document's term weights are joined to it and
summed per class. The plan is lazy, nothing is written by a scoring call.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StringIndexer
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelens.operators import vectors
from carelens.operators.sampling import hash_sample
from carelens.session import delete_path, materialize, scratch_path, write_once


MAX_TRAIN_ROWS = 5000
STEPS = 12
RATE = 1.0
INTERCEPT = 0  # the pseudo-term of the intercept: a term's hash is 0 with a chance of 2**-64


def momentum(step: int) -> float:
    """How far a step looks ahead (Nesterov's sequence)."""
    return step / (step + 3.0)


@dataclass
class IntentModel:
    vocab: DataFrame               # term, df, idf, coefs
    bias: list[float]
    labels: list[str]              # class index -> label
    lr: LogisticRegressionModel | None = None


def features(docs: DataFrame, id_col: str, text_col: str, vocab: DataFrame, size: int) -> DataFrame:
    """(id, features) for every document (empty vector when no known term)."""
    w = vectors.transform(docs, id_col, text_col, vocab.select("term", "idf"))
    w = w.join(vocab.select("term", "term_index"), "term")
    per_doc = (w.groupBy("id")
               .agg(F.array_sort(F.collect_list(F.struct(F.col("term_index").cast("int").alias("i"),
                                                         F.col("weight").alias("v")))).alias("e")))
    ids = docs.select(F.col(id_col).alias("id"))
    empty_i, empty_v = F.array().cast("array<int>"), F.array().cast("array<double>")
    layout = (ids.join(per_doc, "id", "left")
              .select("id", F.struct(
                  F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"),
                  F.coalesce(F.transform("e", lambda s: s["i"]), empty_i).alias("indices"),
                  F.coalesce(F.transform("e", lambda s: s["v"]), empty_v).alias("values"))
                  .alias("features")))
    spark = docs.sparkSession
    path = scratch_path(spark, "features")
    layout.write.parquet(path)
    schema = T.StructType([T.StructField("id", layout.schema["id"].dataType),
                           T.StructField("features", VectorUDT())])
    return spark.read.schema(schema).parquet(path)


def train(training: DataFrame, id_col: str, text_col: str, label_col: str, solver: str = "steps",
          steps: int = STEPS, max_iter: int = 1000, tol: float = 1e-6, min_df: int = 2, max_df: float = 0.95,
          max_train_rows: int | None = MAX_TRAIN_ROWS) -> IntentModel:
    """Fit on at most ``max_train_rows`` rows, those of the lowest id hash; on all with ``None``."""
    training = training.select(id_col, text_col, label_col)
    training = materialize(training if max_train_rows is None else hash_sample(training, max_train_rows, id_col))
    idx = vectors.fit_tfidf(training, id_col, text_col, min_df, max_df)
    # One row per class: bounded by the label set.
    counts = {r[0]: r[1] for r in training.where(F.col(label_col).isNotNull()).groupBy(label_col).count().collect()}
    labels = sorted(counts)
    n = sum(counts.values())
    weight = F.create_map(*[F.lit(x) for c in labels for x in (c, n / (len(labels) * counts[c]))])
    index = F.create_map(*[F.lit(x) for k, c in enumerate(labels) for x in (c, k)])
    examples = training.where(F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("id"), index[F.col(label_col)].alias("label"), weight[F.col(label_col)].alias("weight"))
    if solver == "mllib":
        return _train_mllib(training, id_col, text_col, idx, examples, labels, n, max_iter, tol)
    vocab = materialize(idx.vocab)
    rows = vectors.weigh(idx.counts, vocab).select("id", "term", F.col("weight").alias("x"))
    rows = materialize(rows.join(examples.select("id"), "id", "left_semi")
                       .unionByName(examples.select("id", F.lit(INTERCEPT).cast("long").alias("term"), F.lit(1.0).alias("x"))))
    state = fit_steps(rows, materialize(examples), len(labels), n, steps)
    coefs = state.select("term", F.array(*[F.col(f"w{c}") for c in range(len(labels))]).alias("coefs"))
    bias = coefs.where(F.col("term") == INTERCEPT).first()["coefs"] if n else []
    return IntentModel(vocab=materialize(vocab.join(coefs, "term")), bias=list(bias), labels=labels)


def fit_steps(rows: DataFrame, examples: DataFrame, k: int, n: int, steps: int = STEPS, rate: float = RATE) -> DataFrame:
    """``term, w0.., v0..``: coefficients after ``steps`` steps from zero, and their look-ahead.

    ``rows``: id, term, x (with the pseudo-term); ``examples``: id, label (class index), weight.
    """
    classes = range(k)
    zero = F.lit(0.0)
    state, path = write_once(rows.select("term").distinct().select(
        "term", *[zero.alias(f"w{c}") for c in classes], *[zero.alias(f"v{c}") for c in classes]), "table")
    ridge = F.when(F.col("term") == INTERCEPT, 0.0).otherwise(1.0 / max(n, 1))
    for step in range(steps if n else 0):
        z = (rows.join(state, "term").groupBy("id")
             .agg(*[F.sum(F.col("x") * F.col(f"v{c}")).alias(f"z{c}") for c in classes]))
        top = F.greatest(*[F.col(f"z{c}") for c in classes]) if k > 1 else F.col("z0")
        grown = z.select("id", *[F.exp(F.col(f"z{c}") - top).alias(f"e{c}") for c in classes])
        total = sum((F.col(f"e{c}") for c in classes), F.lit(0.0))
        error = grown.join(examples, "id").select(
            "id", *[(F.col("weight") * (F.col(f"e{c}") / total - (F.col("label") == c).cast("double")) / n).alias(f"g{c}")
                    for c in classes])
        slope = (rows.join(error, "id").groupBy("term")
                 .agg(*[F.sum(F.col("x") * F.col(f"g{c}")).alias(f"d{c}") for c in classes]))
        moved = state.join(slope, "term").select(
            "term", *[F.col(f"w{c}").alias(f"old{c}") for c in classes],
            *[(F.col(f"v{c}") - rate * (F.col(f"d{c}") + ridge * F.col(f"v{c}"))).alias(f"w{c}") for c in classes])
        ahead, done = momentum(step), path
        state, path = write_once(moved.select(
            "term", *[f"w{c}" for c in classes],
            *[(F.col(f"w{c}") + ahead * (F.col(f"w{c}") - F.col(f"old{c}"))).alias(f"v{c}") for c in classes]), "table")
        delete_path(rows.sparkSession, done)
    return state


def _train_mllib(training, id_col, text_col, idx, examples, labels, n, max_iter, tol) -> IntentModel:
    term_indexer = StringIndexer(inputCol="term", outputCol="term_index",
                                 stringOrderType="alphabetAsc").fit(idx.vocab)
    vocab = materialize(term_indexer.transform(idx.vocab))
    size = len(term_indexer.labels)
    data = features(training, id_col, text_col, vocab, size).join(
        examples.withColumn("label", F.col("label").cast("double")), "id")
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                            family="multinomial", maxIter=max_iter, tol=tol,
                            regParam=1.0 / n, elasticNetParam=0.0, standardization=False,
                            fitIntercept=True)
    fitted = lr.fit(data)
    # Each term's coefficient per class, bounded like the matrix itself.
    rows = [(float(i), c) for i, c in enumerate(fitted.coefficientMatrix.toArray().T.tolist())]
    coefs = training.sparkSession.createDataFrame(rows, "term_index double, coefs array<double>")
    return IntentModel(vocab=materialize(vocab.join(coefs, "term_index")),
                       bias=fitted.interceptVector.toArray().tolist(), labels=labels, lr=fitted)


def predict(model: IntentModel, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, predicted_intent) for every document, by coefficient join.

    A document without a known term gets the class of the largest
    intercept. Sums are compared after rounding to nine places; ties go to the
    label that sorts first.
    """
    w = vectors.transform(docs, id_col, text_col, model.vocab.select("term", "idf"))
    classes = range(len(model.labels))
    sums = (w.join(model.vocab.select("term", "coefs"), "term").groupBy("id")
            .agg(*[F.sum(F.col("weight") * F.get("coefs", F.lit(c))).alias(f"z{c}") for c in classes]))
    scored = docs.select(F.col(id_col).alias("id")).join(sums, "id", "left")
    logits = F.array(*[F.round(F.coalesce(F.col(f"z{c}"), F.lit(0.0)) + F.lit(model.bias[c]), 9) for c in classes])
    labels = F.array(*[F.lit(x) for x in model.labels])
    return scored.withColumn("z", logits).select(
        F.col("id").alias(id_col),
        F.element_at(labels, F.array_position("z", F.array_max("z")).cast("int")).alias("predicted_intent"))


def save(model: IntentModel, path: str) -> None:
    model.vocab.write.mode("overwrite").parquet(os.path.join(path, "vocab"))
    spark = model.vocab.sparkSession
    spark.createDataFrame([(json.dumps({"labels": model.labels, "bias": model.bias}),)], "classes string") \
        .write.mode("overwrite").json(os.path.join(path, "classes"))
    if model.lr is not None:
        model.lr.write().overwrite().save(os.path.join(path, "lr"))


def load(spark: SparkSession, path: str) -> IntentModel:
    """The saved model; MLlib's own object is not needed for scoring and is left where it lies."""
    classes = json.loads(spark.read.json(os.path.join(path, "classes")).first()["classes"])
    return IntentModel(vocab=spark.read.parquet(os.path.join(path, "vocab")), bias=classes["bias"], labels=classes["labels"])


__all__ = ["IntentModel", "train", "fit_steps", "predict", "save", "load", "features"]
