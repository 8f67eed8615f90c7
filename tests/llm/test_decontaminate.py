import hashlib
import random
import re
import string

import numpy as np
import pytest

from carelens.llm import decontaminate as fm

from llm_helpers import empty, frame, prose

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(docs, items):
    wins = {}
    for item, t in items:
        w = brute_words(t)
        if w:
            n = min(10, len(w))
            for i in range(len(w) - n + 1):
                wins.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    out = []
    for doc, t in docs:
        w, hit, found = brute_words(t), set(), set()
        for n in range(1, 11):
            for i in range(len(w) - n + 1):
                k = tuple(w[i:i + n])
                if k in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[k]
        out.append((doc, len(w), len(hit), len(found),
                    hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1], r[2])


@pytest.fixture(scope="module")
def items():
    rng = random.Random(5)
    return [(10, prose(rng, 25)), (9, prose(rng, 10)), (8, "Lonely Words, here!"), (7, None), (6, "..."), (5, "baria")]


def docs_with_items(items):
    from llm_helpers import awkward
    rng = random.Random(6)
    rows = awkward()
    extra = [prose(rng, 20) + " " + items[0][1].upper() + " " + prose(rng, 5), items[1][1] + items[1][1],
             "so LONELY words here.", "lonely\x00words-here", items[0][1][:80], "lonely words"]
    return rows + [(400 + k, t, "en", "s0", len(t), 0.1, "y", "z") for k, t in enumerate(extra)]


@pytest.mark.parametrize("block_words, shard", [(1 << 20, 1 << 20), (12, 500)])
def test_equals_brute_force(spark, items, block_words, shard):
    """Also with several query blocks and several shards to a batch."""
    rows = docs_with_items(items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = fm.digest(fm.find_contamination(frame(spark, rows), bench, block_words=block_words, shard_symbols=shard))
    got = sorted((tuple(r) for r in got.collect()), key=key)
    assert got == sorted(brute([(r[0], r[1]) for r in rows], items), key=key)


def test_removal_leaves_no_window(spark, items):
    rows = docs_with_items(items[:3])
    bench = spark.createDataFrame(items[:3], "item_id long, text string")
    found = fm.find_contamination(frame(spark, rows), bench)
    cut = fm.remove_spans(found)
    assert cut.columns == frame(spark, rows).columns and cut.count() == len(rows)
    again = fm.digest(fm.find_contamination(cut, bench))
    assert again.where("contaminated").count() == 0
    kept = {r.doc_id: r.text for r in cut.collect() if r.doc_id and r.doc_id >= 400}
    assert kept[402] == "so ." and kept[405] == "lonely words"


def test_empty_tables(spark, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert fm.digest(fm.find_contamination(empty(spark), bench)).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert fm.digest(fm.find_contamination(frame(spark), none)).where("contaminated").count() == 0


def test_index_against_plain_search():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 4, 4000)
    text[-1] = 0
    index = fm.FMIndex(text, 3)
    joined = "".join(map(str, text))
    for p in ("1", "12", "333", "1231", "22222222"):
        lo, hi = index.search(np.array([[int(c) for c in p]]), np.array([len(p)]))
        want = [i for i in range(len(joined)) if joined.startswith(p, i)]
        assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want
