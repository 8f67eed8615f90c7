import random

import numpy as np
import pytest

from carelens.llm import token_shards as ts
from carelens.llm.registry import RANKS

from llm_helpers import awkward, empty, frame


def test_round_trip(spark):
    """Slots in stream order give back every text of every document."""
    rows = awkward()
    shards = ts.shards(frame(spark, rows), RANKS, seq_len=64, slots_per_shard=16).cache()
    enc, end = ts.encoding(RANKS)
    slots = {r.slot: np.frombuffer(r.ids, ts.DTYPE) for r in ts.read_from(shards, 0).collect()}
    n = len(slots)
    assert sorted(slots) == list(range(n)) and all(len(x) == 64 for x in slots.values())
    order = ts.Permutation(n).slot(np.arange(n))
    stream = np.concatenate([slots[s] for s in order.tolist()]).tolist()
    total = sum(r.n_tokens for r in shards.collect())
    assert all(x == end for x in stream[total:])
    texts, cur = [], []
    for x in stream[:total]:
        if x == end:
            texts.append(enc.decode(cur))
            cur = []
        else:
            cur.append(x)
    assert sorted(texts) == sorted(r[1] or "" for r in rows)
    for r in shards.collect():
        assert len(r.payload) == r.n_slots * r.stride and r.first_slot == r.shard * 16
    ids = {i for r in shards.collect() for i in r.doc_ids}
    assert ids == {r[0] for r in rows}
    late = [r.slot for r in ts.read_from(shards, n // 2 + 3).collect()]
    assert late == list(range(n // 2 + 3, n))


def test_written_shards_are_the_same(spark, tmp_path):
    docs = frame(spark)
    kept = ts.write_shards(docs, str(tmp_path / "s"), RANKS, seq_len=128, slots_per_shard=8)
    a = sorted((r.shard, r.payload_sha256) for r in kept.collect())
    b = sorted((r.shard, r.payload_sha256) for r in ts.shards(docs, RANKS, seq_len=128, slots_per_shard=8).collect())
    assert a == b


def test_empty(spark):
    assert ts.shards(empty(spark), RANKS).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    p = ts.Permutation(n)
    slots = p.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and (p.sequence(slots) == np.arange(n)).all()
    assert n < 17 or (slots != ts.Permutation(n, "other").slot(np.arange(n))).any()


def test_chunks_encode_like_whole_texts():
    rng = random.Random(1)
    parts = [" ", "  ", "\n", " \n", "\n ", "a", "bc", "don't", "é", "!!", "12", "\t", ".", "\x1c", "\x85", "日本"]
    chunks = ts.Chunks(RANKS)
    enc, end = ts.encoding(RANKS)
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(chunks.tokens(text), ts.DTYPE).tolist() == [*enc.encode_ordinary(text), end]


def test_blanks_beside_white_space_are_found():
    """The search begins at blanks alone, and finds what the plain alternation finds."""
    import itertools
    import re

    from carelens.llm.token_shards import _MIXED
    assert _MIXED.pattern[0] == " "
    plain = re.compile(r" \s|\s |^ | $")
    for n in range(1, 6):
        for t in map("".join, itertools.product("a \n\u00a0", repeat=n)):
            assert bool(t[0] == " " or _MIXED.search(t)) == bool(plain.search(t)), t
