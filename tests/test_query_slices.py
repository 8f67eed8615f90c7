"""Retrieval searches its queries in slices and leaves only their hits behind."""

import os

from carelens.operators import retrieval
from carelens.session import materialize, shared_dir


def rows(df):
    return sorted(df.collect(), key=lambda r: tuple((x is None, str(x)) for x in r))


def own_tables(spark):
    out = []
    for folder, _, files in os.walk(shared_dir(spark).removeprefix("file:")):
        if any(f.endswith(".parquet") for f in files):
            out.append(folder)
    return set(out)


def test_queries_are_searched_in_slices(spark, monkeypatch):
    """More slices give the same hits, and leave only the hits of each behind."""
    words = [f"w{k:02d}" for k in range(23)]
    text = [" ".join(words[(i * j) % 23] for j in range(1, 6)) for i in range(40)]
    h = materialize(spark.createDataFrame([(i, text[i], "x" if i % 3 else "y") for i in range(40)], "doc_id long, text string, intent string"))
    q = materialize(spark.createDataFrame(
        [(i, text[(i * 7) % 40] + " w01", ["x", "y", "z", None][i % 4]) for i in range(12)], "qid long, text string, intent string"))
    monkeypatch.setattr(retrieval, "PAIRS", 10 ** 6)
    _, qt, index = retrieval.postings(q, h)
    assert retrieval.query_slices(qt, index) == 1
    one = rows(retrieval.top_hits(qt, index, 3))
    monkeypatch.setattr(retrieval, "query_slices", lambda *_: 2)
    before = own_tables(spark)
    assert rows(retrieval.top_hits(qt, index, 3)) == one and len(one) == 36
    assert len(own_tables(spark) - before) == 2


def test_slices_count_every_pair_of_a_term(spark, monkeypatch):
    """By hand: rare terms meet documents, common terms meet blocks; a block of all history meets every intent."""
    qt = spark.createDataFrame([(1, "x", 7, True), (2, "__all__", 7, True), (2, "__all__", 8, False)],
                               "qid long, block string, term long, rare boolean")
    terms = spark.createDataFrame([("x", 7, 1), ("x", 7, 2), ("y", 7, 3), ("y", 8, 3)], "intent string, term long, doc_id long")
    maxima = spark.createDataFrame([("x", 10, 8), ("y", 11, 8)], "intent string, bid long, term long")
    monkeypatch.setattr(retrieval, "PAIRS", 1)
    index = retrieval.Index(terms, None, maxima)
    assert retrieval.query_slices(qt, index) == 2  # 2 + 3 + 2 pairs over 4 terms
