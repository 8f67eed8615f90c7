"""Importance resampling against a plain computation, feature by feature."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from carelens.llm import resample
from llm_helpers import awkward, empty, frame

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TARGET = ["ban dost kelo lip mump", "Ban, DOST; sover 42 9x", None, "", "日本 é ban ban ban"]


def features(text, order=2):
    ws = WORD.findall((text or "").translate(LOWER))
    return ws, [" ".join(ws[i:i + k]) for k in range(1, order + 1) for i in range(len(ws) - k + 1)]


def brute(rows, target, share=25, min_words=20, buckets=10_000, seed=7, order=2):
    count = [Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, order)[1])
             for texts in ([r[1] for r in rows], target)]
    s, t = (sum(c.values()) for c in count)
    out = []
    for r in rows:
        ws, fs = features(r[1], order)
        gains = [math.floor(1000 * math.log(((count[1][b] + 1.0) * (s + buckets)) / ((count[0][b] + 1.0) * (t + buckets))))
                 for b in (zlib.crc32(f.encode()) % buckets for f in fs)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append((r[0], len(ws), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    return out, able, share * len(able) // 100


def check(rows, target, df, **options):
    every, able, n = brute(rows, target, **options)
    got = [tuple(r) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()]
    assert sorted(map(str, every)) == sorted(str(g[:5]) for g in got)
    drawn = sorted((g for g in got if g[5] is not None), key=lambda g: g[5])
    assert [g[5] for g in drawn] == list(range(1, n + 1))
    assert [(g[0], g[4]) for g in drawn] == [(x[0], x[4]) for x in able[:n]]


def test_equal_to_plain_computation(spark):
    rows = awkward(n=80)
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")
    df = resample.resample(frame(spark, rows).repartition(6), target, min_words=10)
    check(rows, TARGET, df, min_words=10)


def test_longer_runs_small_chunks_and_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(resample, "ROWS_PER_RANGE", 4)
    rows = awkward(seed=3, n=60)
    target = spark.createDataFrame([(0, " ".join(TARGET[:2]))], "item_id long, text string")
    df = resample.resample(frame(spark, rows).repartition(3), target, min_words=1, order=3, share=60, seed=11, buckets=101)
    check(rows, [" ".join(TARGET[:2])], df, min_words=1, order=3, share=60, seed=11, buckets=101)


def test_empty_tables(spark):
    target = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(empty(spark), target).count() == 0
    rows = awkward(n=10)
    check(rows, [], resample.resample(frame(spark, rows), target))
    blank = [(1, None, None, None, None, None, None, None), (2, " ", None, None, None, None, None, None)]
    check(blank, [], resample.resample(frame(spark, blank), target))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=50))
def test_crcs_equal_zlib(features):
    assert resample.crcs(features).tolist() == [zlib.crc32(f) for f in features]


def test_crcs_of_large_groups_and_long_features(monkeypatch):
    monkeypatch.setattr(resample, "MATRIX_BYTES", 64)
    rng = np.random.default_rng(1)
    fs = [rng.bytes(int(n)) for n in rng.integers(0, 30, 500)] + [rng.bytes(n) for n in (4095, 4096, 4097, 50_000)]
    assert resample.crcs(fs).tolist() == [zlib.crc32(f) for f in fs]


def test_clashing_columns_are_not_read(spark):
    rows = awkward(n=30)
    docs = frame(spark, rows).selectExpr("*", "1 as rank", "'x' as weight", "2 as row_", "3 as n_words", "4 as part")
    target = spark.createDataFrame([(0, TARGET[0])], "item_id long, text string")
    check(rows, [TARGET[0]], resample.resample(docs, target))
