import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from carelens.llm import suffix_dedup as sd

from llm_helpers import awkward, empty, frame, prose


def brute(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i:i + width] for b in texts for i in range(len(b) - width + 1))
    out = []
    for (doc, _), b in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(b) - width + 1):
            if seen[b[i:i + width]] > 1:
                gone |= set(range(i, i + width))
        runs = sum(1 for i in gone if i - 1 not in gone)
        kept = bytes(c for i, c in enumerate(b) if i not in gone)
        out.append((doc, len(b), len(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def rows_with_passages():
    rng = random.Random(8)
    rows = [(r[0], r[1]) for r in awkward(n=25)]
    passage, edge = prose(rng, 110), "z" * sd.WIDTH
    for k in range(12):
        rows.append((500 + k, prose(rng, 30) + " " + passage + " " + prose(rng, 20)))
    rows += [(600, passage + passage), (601, "a" * 1000), (602, edge), (603, edge + "q"), (604, edge[:-1]),
             (605, "é" * 300), (606, "x" + "é" * 260), (607, "😀" * 150)]
    return rows


@pytest.mark.parametrize("hot", [3000, 2])
def test_equals_brute_force(spark, monkeypatch, hot):
    """Also with nearly every anchor taken by the way of hot anchors."""
    monkeypatch.setattr(sd, "HOT_BLOCKS", hot)
    rows = rows_with_passages()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, spans int")
    got = sorted((tuple(r) for r in sd.dedup(docs.repartition(3)).collect()),
                 key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert got == brute(rows, sd.WIDTH)


def test_empty(spark):
    assert sd.dedup(empty(spark)).count() == 0


def test_suffix_array_and_prefixes_against_sorting():
    rng = random.Random(3)
    for _ in range(120):
        letters = rng.choice([b"ab", b"abc", b"a", bytes(range(97, 110))])
        blocks = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6))]
        blocks += blocks[:rng.randint(0, 1)]
        t, sa = sd.suffix_array(blocks)
        text = t.tolist()
        order = sorted(range(len(text)), key=lambda i: text[i:])
        assert sa.tolist() == order
        plcp, pred = sd.permuted_prefixes(t, sa)
        for a, b in zip(order, order[1:], strict=False):
            same = 0
            while a + same < len(text) and b + same < len(text) and text[a + same] == text[b + same]:
                same += 1
            assert (plcp[b], pred[b]) == (same, a)


def test_named_strings_are_sorted_recursively():
    """Few symbols and periods make several levels."""
    rng = random.Random(5)
    strings = [[rng.randrange(k) for _ in range(n)] for n in (1, 2, 3, 60, 500) for k in (1, 2, 3, 40) for _ in range(8)]
    word, longer = [0], [0, 1]
    for _ in range(11):
        word, longer = longer, longer + word
    strings += [longer, [0, 1, 0, 2] * 80, list(range(300)), list(range(300, 0, -1)), [3, 1] * 200 + [0]]
    for s in strings:
        assert sd.sort_named(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_long_texts_are_read_in_stretches(monkeypatch):
    monkeypatch.setattr(sd, "STRETCH", 1000)
    raw = bytes(random.Random(1).choice(b"abcdefgh ") for _ in range(5000))
    starts = [at + i for at, s in sd._segments(raw) for i in range(len(s) - sd.WIDTH + 1)]
    assert starts == list(range(len(raw) - sd.WIDTH + 1))


def test_equal_windows_have_equal_anchors():
    rng = random.Random(2)
    common = bytes(rng.choice(b"abcdef ") for _ in range(sd.WIDTH + 50))
    found = []
    for _ in range(2):
        raw = bytes(rng.choice(b"ghijk ") for _ in range(rng.randint(1, 900)))
        seg, first, count, anchor = sd.blocks_of([raw + common + raw[::-1]])
        by_place = {f + i: a for f, c, a in zip(first.tolist(), count.tolist(), anchor.tolist(), strict=True) for i in range(c)}
        found.append([by_place[len(raw) + i] for i in range(51)])
    assert found[0] == found[1]
