import random
import re
import string

import numpy as np
import pytest

from carelens.llm import ngram_join as nj

from llm_helpers import SCHEMA, awkward, empty, frame, prose

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted(((i, len(sets[k]), least[find(k)] if sets[k] else i) for k, (i, _) in enumerate(rows)),
                  key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def variants():
    """A chain whose ends do not link, sizes across a band's edge, and a group of many variants."""
    rng = random.Random(9)
    rows, k = [], 1000
    w = prose(rng, 120).split()
    for step in range(8):  # each is close to the next only
        rows.append((k, " ".join(w)))
        k += 1
        for _ in range(2):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
    for n in (60, 64, 66, 70, 128, 132, 150):
        t = prose(rng, n + 4)
        rows += [(k, t), (k + 1, t + " " + prose(rng, n // 4)), (k + 2, t + " " + prose(rng, n // 3 + 2))]
        k += 3
    common = prose(rng, 100).split()
    for _ in range(60):
        v = list(common)
        v[rng.randrange(100)] = f"y{rng.randrange(10 ** 6)}"
        rows.append((k, " ".join(v)))
        k += 1
    passage = prose(rng, 40)
    for _ in range(40):  # a passage in common is no likeness
        rows.append((k, prose(rng, 60) + " " + passage))
        k += 1
    return rows


def test_equals_brute_force(spark):
    rows = [(r[0], r[1]) for r in awkward()] + variants()
    rng = random.Random(1)
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, cls string")
    got = nj.join(docs.repartition(4)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got),
                  key=lambda r: (r[0] is None, r[0] or 0, r[1])) == brute(rows)
    for r in got:
        assert "n_links" not in r
        assert (r.component_id == r.doc_id) >= r.representative or r.doc_id is None


def test_counts_every_link(spark, monkeypatch):
    """Links inside a component too, over several tiles, with copies."""
    monkeypatch.setattr(nj, "TILE_SETS", 16)
    rows = [(r[0], r[1]) for r in awkward()] + variants()
    rows += [(5000 + k, t) for k, (_, t) in enumerate(variants()[-90:-50])]
    sets = [shingles(t) for _, t in rows]
    want = sorted((-1 if i is None else i, len(a), sum(
        j != k and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets)) if a else 0)
        for k, ((i, _), a) in enumerate(zip(rows, sets, strict=True)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = nj.join(docs.repartition(5), count_links=True).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.n_links) for r in got) == want


@pytest.mark.parametrize("sides", [1, 2])
def test_linked_copies(sides):
    rng = np.random.default_rng(sides)
    base = rng.integers(0, 2 ** 63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(1, 60), replace=False),
                                      rng.integers(0, 2 ** 63, rng.integers(0, 6), dtype=np.uint64)])) for _ in range(90)]
    sets += [np.unique(np.append(base, np.uint64(k))) for k in range(20)]
    side, copies = rng.integers(0, sides, len(sets)), rng.integers(1, 4, len(sets))
    want = [sum(int(copies[j]) for j, b in enumerate(sets) if j != i and (sides == 1 or side[i] != side[j])
                and 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))) for i, a in enumerate(sets)]
    assert nj.linked_copies(sets, side, copies).tolist() == want


def two_blocks(rng):
    """Texts A, V, W, Z: V and W each link with A by one block, {A, V, Z} or {A, W, Z}, and lie between A and Z."""
    cache = nj.WordHashes()
    while True:
        w = [f"w{rng.randrange(10 ** 9)}" for _ in range(9)]
        sets = [nj.shingle_set(" ".join(t), cache) for t in (w, w[:-1], w[1:], [*w, "more"])]
        a, v, z, y = (nj.set_class(sets[k]) for k in (0, 1, 3, 2))
        ends = {*set(sets[0]) - set(sets[1]), *set(sets[0]) - set(sets[2])}
        if ends == set(sets[0][:2]) and min(a, z) < min(v, y) and max(v, y) < max(a, z):
            return [" ".join(t) for t in (w, w[:-1], w[1:], [*w, "more"])]


def test_short_texts_with_copies_over_partitions(spark):
    """Blocks of different sets stay apart when a set has a row for each of an even number of chunks."""
    rng, parts, k = random.Random(5), [[], [], [], []], 0
    for copies in (2, 4, 2, 4):
        a, v, w, z = two_blocks(rng)
        for j, ts in enumerate([[a, v, w, z], *[[v, w]] * (copies - 1)]):
            parts[j] += [(k + i, t) for i, t in enumerate(ts)]
            k += len(ts)
    docs = spark.createDataFrame(spark.sparkContext.parallelize(parts, 4).flatMap(lambda x: x),
                                 "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in nj.join(docs).collect())
    assert got == brute([r for p in parts for r in p])


def test_frequent_shingles_do_not_change_links():
    """Any list of frequent shingles leaves linked sets a block in common."""
    rng = np.random.default_rng(4)
    for n in (5, 40, 64, 65, 300, 1500):
        for trial in range(20):
            a = np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64))
            lost = rng.integers(0, max(1, len(a) // 7) + 1)
            more = rng.integers(0, max(1, (len(a) - lost) // 7) + 1)
            b = np.unique(np.concatenate([a[lost:], rng.integers(0, 2 ** 63, more, dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common < 75 * (len(a) + len(b) - common):
                continue
            hot = np.sort(rng.choice(a, len(a) // 2, replace=False))
            sig, of = nj.blocks([a, b], hot)
            assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist()), (n, trial)


def test_empty(spark):
    assert nj.join(empty(spark)).count() == 0
    rows = [(1, None, None, None, None, None, None, None), (2, " ", None, None, None, None, None, None)]
    assert [(r.doc_id, r.component_id, r.n_shingles) for r in nj.join(frame(spark, rows)).orderBy("doc_id").collect()] \
        == [(1, 1, 0), (2, 2, 0)]


@pytest.mark.parametrize("links, want", [
    ([(1, 2), (2, 3), (3, 4), (4, 5), (9, 8)], {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}), ([], {})])
def test_components(spark, links, want):
    df = spark.createDataFrame(links, "u long, v long")
    assert {r.node: r.label for r in nj.components(df).collect()} == want


def test_components_of_random_and_chained_links(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(1000, 1060)] + [(k, k + 2) for k in range(2000, 2100, 2)]
    links += [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        if u != v:
            parent[find(u)] = find(v)
    first, rest = links[::3], [x for k, x in enumerate(links) if k % 3]
    frame_of = lambda rows: spark.createDataFrame(rows, "u long, v long")
    whole = {r.node: r.label for r in nj.components(frame_of(links)).collect()}
    label = nj.components(frame_of(first))
    in_steps = {r.node: r.label for r in nj.compose(label, nj.components(nj.relabel(frame_of(rest), label))).collect()}
    for got in (whole, in_steps):
        assert set(got) == set(parent)
        assert len(set(got.values())) == len({find(x) for x in parent})
        assert all(find(x) == find(got[x]) for x in parent)
