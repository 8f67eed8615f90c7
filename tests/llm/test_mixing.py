from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from carelens.llm import mixing

from llm_helpers import awkward, empty, frame


def fill(sizes):
    """Reshare the excess by weight until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = (total - sum(target.values())) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] >= 2 * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in free}
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return target


def test_targets_sizes_and_limits(spark):
    rows = awkward()
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want, taken, largest = fill(sizes), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = mixing.mix(frame(spark, rows[::-1]).repartition(5))
    assert sorted(map(str, got)) == sorted(map(str, again.collect()))


def test_close_to_target_with_many_documents(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 17 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    got = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("want"))
    for r in got.collect():
        assert abs(r.t - r.want) <= 17


def test_rows_are_repeated_whole(spark):
    rows = awkward()
    docs = frame(spark, rows)
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.doc_id not in (3, None)}
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    seen = defaultdict(int)
    for r in out.collect():
        seen[r.doc_id] += 1
    assert {k: v for k, v in seen.items() if k in copies} == {k: v for k, v in copies.items() if v}


def test_empty(spark):
    assert mixing.mix(empty(spark)).count() == 0 and mixing.apply_mix(empty(spark)).count() == 0
