"""Quality by co-training two views of a page.

* The **text view** sees statistics of the content alone (letter, digit,
  upper-case and symbol shares, word and line shapes, repetition).
* The **metadata view** sees what is recorded about the page alone (source,
  language, recorded length), hashed to a fixed number of columns.

Both start from the labelled rows. In each round, every view scores all
unlabelled rows and hands those it is surest of, on either side, to the
other view as pseudo-labelled rows, then both are fitted again. At the end
each view's logit is calibrated, and the two combined, by a logistic
regression on labelled rows that neither view was fitted on; that score is
given to every document.

Views are MLlib logistic regressions over all rows of the feature table,
which is written once; only coefficients and class counts reach the driver.

Edge cases: NULL and empty texts have zero statistics; NULL metadata is a
value of its own; ids without a label are unlabelled, an id labelled twice
takes the lower label; without labels of both classes the score is the
share of the label seen (0.5 if none); repeated rows score alike.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelens.llm.common import lean, written

ROUNDS = 3
SURE = 0.05  # share of the unlabelled rows that a view hands over, split by its class shares
PSEUDO_WEIGHT = 0.3
META_BUCKETS = 48
ITERATIONS = 25

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_STOPS = b".,;:?'\"()-"
_SYMBOLS = b"#$%&*|!@^~+=<>{}[]\\/_`"
N_TEXT = 16


def text_features(text: str | None) -> list[float]:
    """Statistics of a whole text, each of a scale near one."""
    if not text:
        return [0.0] * N_TEXT
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    words, lines = text.split(), [x for x in text.split("\n") if x]
    w = max(1, len(words))

    def share(chars: bytes) -> float:
        return (n - len(raw.translate(None, chars))) / n

    counts = Counter(words)
    top = max(counts.values(), default=0)
    ends = sum(1 for x in lines if x[-1] in ".!?")
    return [
        math.log1p(n) / 10, math.log1p(w) / 10, len(text) / w / 10, share(_LETTERS), 5 * share(_UPPER),
        5 * share(_DIGITS), 5 * share(_STOPS), 5 * share(_SYMBOLS), len(counts) / w, top / w,
        ends / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), math.log1p(w / max(1, len(lines))) / 5,
        sum(1 for x in words if len(x) == 1) / w, sum(1 for x in counts if x.isupper()) / len(counts) if counts else 0.0,
        sum(1 for x in words if len(x) > 25) / w,
    ]


def meta_features(columns: list[Column], length: Column) -> Column:
    """Hashed indicators of the metadata columns and the recorded length."""
    hashed = [F.pmod(F.xxhash64(F.lit(i), F.coalesce(c.cast("string"), F.lit("\0"))), F.lit(META_BUCKETS)).cast("int")
              for i, c in enumerate(columns)]
    size = F.log1p(F.greatest(F.coalesce(length.cast("double"), F.lit(0.0)), F.lit(0.0))) / 10
    slots = F.array(*hashed)
    indicators = F.transform(F.sequence(F.lit(0), F.lit(META_BUCKETS - 1)),
                             lambda k: F.array_contains(slots, k).cast("double"))
    return F.concat(indicators, F.array(size, size * size))


def features(docs: DataFrame, id_col: str, text_col: str, meta_cols: list[str], length_col: str) -> DataFrame:
    """``id, text_x, meta_x`` of every row."""
    meta = meta_features([F.col(c) for c in meta_cols], F.col(length_col))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), meta.alias("meta_x"))
    numbers = T.ArrayType(T.DoubleType())
    schema = src.select("id").schema.add("text_x", numbers).add("meta_x", numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([text_features(t.as_py()) for t in batch.column(1)], float).reshape(-1)
            text_x = pa.ListArray.from_arrays(np.arange(0, len(x) + 1, N_TEXT, dtype=np.int32), pa.array(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), text_x, batch.column(2)], names=["id", "text_x", "meta_x"])

    return src.mapInArrow(lean(run), schema)


class View:
    """A fitted logistic regression on one feature array."""

    def __init__(self, column: str, coef: list[float], intercept: float):
        self.column, self.coef, self.intercept = column, coef, intercept

    def logit(self) -> Column:
        weights = F.array(*[F.lit(float(c)) for c in self.coef])
        return F.aggregate(F.zip_with(weights, F.col(self.column), lambda a, b: a * b),
                           F.lit(float(self.intercept)), lambda t, x: t + x)


def fit(rows: DataFrame, column: str, label: str = "y", weight: str = "w") -> View:
    """Weighted logistic regression over all ``rows``."""
    data = rows.select(array_to_vector(F.col(column)).alias("features"), F.col(label).cast("double").alias("label"),
                       F.col(weight).alias("weight"))
    model = LogisticRegression(maxIter=ITERATIONS, regParam=1e-3, weightCol="weight").fit(data)
    return View(column, model.coefficients.toArray().tolist(), model.intercept)


class CoTrained:
    """Two views and the regression that combines their logits."""

    def __init__(self, views: list[View], combined: View | None, share: float):
        self.views, self.combined, self.share = views, combined, share

    def score(self, table: DataFrame, keep: list[str]) -> DataFrame:
        if self.combined is None:
            return table.select(*keep, F.lit(self.share).alias("score"))
        both = table.withColumn("both_x", F.array(*[v.logit() for v in self.views]))
        return both.select(*keep, (1 / (1 + F.exp(-self.combined.logit()))).alias("score"))


def train(table: DataFrame, labels: DataFrame, rounds: int = ROUNDS, sure: float = SURE) -> CoTrained:
    """Co-train on ``table`` (of :func:`features`) and ``labels`` (``id, y``)."""
    one = labels.where("y in (0, 1) and id is not null").groupBy("id").agg(F.min("y").alias("y"))
    joined = written(table.join(one, "id", "left").withColumn(
        "part", F.pmod(F.xxhash64("id", F.lit("part")), F.lit(4))), "cotrain")
    known = joined.where("y is not null")
    seen = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(seen.values())
    share = seen.get(1, 0) / total if total else 0.5
    base = known.where("part > 0").withColumn("w", F.lit(1.0))
    calibration = known.where("part = 0").withColumn("w", F.lit(1.0))
    both_sides = [df.agg(F.countDistinct("y")).first()[0] == 2 for df in (base, calibration)]
    if not all(both_sides):
        return CoTrained([], None, share)
    views = [fit(base, "text_x"), fit(base, "meta_x")]
    unlabelled = joined.where("y is null")
    for _ in range(rounds):
        logits = [v.logit() for v in views]
        marks = unlabelled.agg(*[F.percentile_approx(z, [sure * (1 - share), 1 - sure * share], 2000).alias(f"q{k}")
                                 for k, z in enumerate(logits)]).first()
        if marks["q0"] is None:
            break
        extra = []
        for k, z in enumerate(logits):
            low, high = marks[f"q{k}"]
            guess = F.when(z >= high, 1).when(z <= low, 0)
            # Only what the view itself believes in: beyond its own decision boundary.
            guess = F.when(((guess == 1) & (z > 0)) | ((guess == 0) & (z < 0)), guess)
            extra.append(unlabelled.withColumn("y", guess).where("y is not null").withColumn("w", F.lit(PSEUDO_WEIGHT)))
        views = [fit(base.unionByName(extra[1]), "text_x"), fit(base.unionByName(extra[0]), "meta_x")]
    both = calibration.withColumn("both_x", F.array(*[v.logit() for v in views]))
    return CoTrained(views, fit(both, "both_x"), share)
