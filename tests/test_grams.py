"""Grams are counted for some documents at a time, as a plain count per document gives them."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from carelens.operators import grams


def batch(docs):
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.list_(pa.string()))],
                                      ["id", "_toks"])


def test_counts_equal_plain_counts(monkeypatch):
    rnd = random.Random(3)
    docs = [(i if i % 9 else None, rnd.choice([None, []]) if i % 7 == 0 else rnd.choices(["aa", "bb", "é1", "a_b", "zz"], k=rnd.randrange(1, 30))) for i in range(60)]
    want, df = Counter(), Counter()
    for i, t in docs:
        per = Counter([*(t or []), *(f"{a} {b}" for a, b in zip(t or [], (t or [])[1:], strict=False))])
        want.update((i, w, n) for w, n in per.items())
        df.update(per.keys())
    for most in (1, 40, 1 << 19):
        monkeypatch.setattr(grams, "TOKENS", most)
        halves = [batch(docs[:31]), batch(docs[31:]).slice(2), batch([])]
        first = [batch(docs[31:33])]
        got = pa.Table.from_batches(list(grams.counted(iter(halves + first)))).to_pylist()
        assert Counter((r["id"], r["word"], r["tf_count"]) for r in got) == want
        some = Counter()
        for r in pa.Table.from_batches(list(grams.held(iter(halves + first)))).to_pylist():
            some[r["word"]] += r["df"]
        assert some == df


def test_documents_of_a_batch_are_counted_together():
    """A word of all documents of a batch is one row there: what is shuffled are batches' words, not documents'."""
    rows = list(grams.held(iter([batch([(i, ["same", "words"]) for i in range(500)])])))
    assert sum(len(r) for r in rows) == 3 and np.array(rows[0].column("df")).tolist() == [500] * 3
