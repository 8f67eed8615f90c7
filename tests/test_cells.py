"""Retrieval scores cells of queries and documents in memory and hands on the best of each."""

import numpy as np
import pyarrow as pa

from carelens.operators import retrieval, scoring
from carelens.session import materialize


def rows(df):
    return sorted(df.collect(), key=lambda r: tuple((x is None, str(x)) for x in r))


def inputs(spark):
    words = [f"w{k:02d}" for k in range(23)]
    text = [" ".join(words[(i * j) % 23] for j in range(1, 6)) for i in range(60)]
    docs = [(i, text[i], "x" if i % 3 else "y") for i in range(60)] + [(100 + i, text[1], "x") for i in range(40)] + [(200, None, "x"), (201, "", "y")]
    asked = [(i, text[(i * 7) % 60] + " w01", ["x", "y", "z", None][i % 4]) for i in range(24)] + [(90, None, "x"), (91, "nothing here", "y")]
    return (materialize(spark.createDataFrame(asked, "qid long, text string, intent string")),
            materialize(spark.createDataFrame(docs, "doc_id long, text string, intent string")))


def test_copies_of_a_document_make_no_pairs(spark):
    """Forty copies tie for every query that resembles them; only k of them leave a cell."""
    q, h = inputs(spark)
    _, qt, index = retrieval.postings(q, h)
    per = {r.qid: r["count"] for r in retrieval.candidates(qt, index, 3).groupBy("qid").count().collect()}
    assert len(per) == 24 and max(per.values()) == 3


def test_cells_of_any_size_give_the_same(spark, monkeypatch):
    q, h = inputs(spark)
    want = rows(retrieval.retrieve_topk(q, h))
    assert len(want) == 26 * 3
    for name, value in (("CELL_QUERIES", 4), ("CELL_DOCS", 9)):
        monkeypatch.setattr(retrieval, name, value)
    assert rows(retrieval.retrieve_topk(q, h)) == want
    monkeypatch.setattr(retrieval, "CELL_TERMS", 40)
    monkeypatch.setattr(retrieval, "PAIRS", 1)
    assert rows(retrieval.retrieve_topk(q, h)) == want


def cell(asked, docs):
    keys = [(q, None, v) for q, v in asked] + [(None, d, v) for d, v in docs]
    return pa.table({"qid": pa.array([x[0] for x in keys], pa.int64()), "doc_id": pa.array([x[1] for x in keys], pa.int64()),
                     "terms": pa.array([[t for t, _ in x[2]] for x in keys], pa.list_(pa.int64())),
                     "weights": pa.array([[w for _, w in x[2]] for x in keys], pa.list_(pa.float64()))})


def test_scores_equal_a_plain_sum(monkeypatch):
    """By matrix, by postings and by both; repeated terms and ids add up; ties go to the larger id."""
    rng = np.random.default_rng(5)
    side = lambda n, first: [(first + i, [(int(t), float(rng.integers(1, 9)) / 64) for t in rng.integers(-6, 14, rng.integers(0, 9))]) for i in range(n)]
    asked, docs = side(40, 0), side(70, 500)
    docs += [(900, docs[3][1]), (901, docs[3][1]), (510, docs[11][1]), (902, [])]
    want = {}
    for q, v in asked:
        sums = {}
        for d, u in docs:
            sums[d] = sums.get(d, 0) + sum(w * x for t, w in v for s, x in u if s == t)
        best = sorted(((round(s, 6), d) for d, s in sums.items() if round(s, 6) > 0), reverse=True)[:3]
        want |= {(q, d): s for s, d in best}
    for gain, most in ((0, 1 << 20), (6, 1 << 20), (10 ** 9, 1 << 20), (0, 3), (6, 150)):
        monkeypatch.setattr(scoring, "GAIN", gain)
        monkeypatch.setattr(scoring, "SCORES", most)
        monkeypatch.setattr(scoring, "PRODUCTS", most)
        got = scoring.best_of_cell(3)(cell(asked, docs)).to_pylist()
        assert {(r["qid"], r["doc_id"]): round(r["s"], 6) for r in got} == want and len(got) == len(want)


def test_cells_without_one_side_are_empty():
    some = [(1, [(7, 0.5)])]
    assert [len(scoring.best_of_cell(3)(cell(a, d))) for a, d in ((some, []), ([], some), ([(1, [])], some), (some, [(1, [])]))] == [0] * 4
