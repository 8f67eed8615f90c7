import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from carelens.llm import toxicity as tx

from llm_helpers import SCHEMA, awkward, empty, frame, prose

BAD = ["horrid", "wretch", "vermin"]


@pytest.fixture(scope="module")
def lm():
    words = Counter({w: 50 for w in BAD})
    for w in prose(random.Random(1), 3000).split() + "the idiot moron lost class pass assist".split() * 40:
        words[w] += 1
    return tx.language_model(tx.trigram_counts(words))


@pytest.mark.parametrize("surface, want", [
    ("horrid", "horrid"), ("h0rr1d", "horrid"), ("HORR!D", "horrid"), ("hooooorrid", "horrid"),
    ("h-o-r-r-i-d", "horrid"), ("h.0.r.r.i.d", "horrid"), ("h o r r i d", "horrid"), ("verm1n!!!", "vermin"),
    ("id10t", "idiot"), ("m0r0n###", "moron"), ("2024", "2024"), ("", ""), ("!!!", ""), ("a b", "a b"),
    ("la$$$", "la"),
])
def test_restores(lm, surface, want):
    assert tx.restore(surface, lm) == want


@pytest.mark.parametrize("surface, want", [
    ("@$$", "ass"), ("1@$$", "lass"), ("p@$$", "pass"), ("2024", "2024"), ("1,000", "1,000"), ("10/12", "10/12"),
    ("50%", "50%")])
def test_restores_words_of_look_alikes_only(surface, want):
    words = Counter({w: 50 for w in ("ass", "lass", "class", "pass", "assist")})
    assert tx.restore(surface, tx.language_model(tx.trigram_counts(words))) == want


def test_every_state_is_kept():
    """Decoding equals the cheapest of all readings when wildcards make many states."""
    rng = random.Random(8)
    words = Counter({w: 9 for w in prose(rng, 300).split() + BAD})
    lm = tx.language_model(tx.trigram_counts(words))

    def cost(reading):
        a = b = tx.EDGE
        total = 0.0
        for price, x in reading:
            total += price
            if x:
                total += lm[(a * tx.SIGMA + b) * tx.SIGMA + tx.code(x)]
                a, b = b, tx.code(x)
        return total + (lm[(a * tx.SIGMA + b) * tx.SIGMA + tx.EDGE] if b != tx.EDGE else 0.0)

    def choices(ch):
        if ch.isalpha():
            return [(tx.COST_SAME, ch)]
        looks = tx.LOOKALIKES[ch]
        return [(tx.COST_LOOK_WILD if len(looks) > 2 else tx.COST_LOOK, x) for x in looks] + [(tx.COST_DROP, "")]

    for surface in ("q*1*6*", "z6*1*6", "x*16*1v"):
        best = min(itertools.product(*map(choices, surface)), key=cost)
        assert tx.viterbi(surface, lm) == "".join(x for _, x in best).split()


@pytest.mark.parametrize("lead", range(20, 46))
def test_restores_words_anywhere_in_long_stretches(lm, lead):
    """A word stays whole wherever it stands in a run of set-apart letters or a long token."""
    spaced = " ".join("lost" * 12)[:2 * lead] + " ".join("horridpass")
    assert any("horrid" in w for w in tx.restore(spaced, lm).split())
    token = ("lost-" * 20)[:2 * lead] + "h0rr1d"
    assert tx.restore(token, lm).endswith("horrid")


def table(spark, n=240):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        w = prose(rng, rng.randint(20, 120)).split()
        toxic = i % 3 == 0
        if toxic:
            word = rng.choice(BAD)
            if i % 2:
                word = word.replace("r", "rrrr", 1) if i % 4 == 1 else " ".join(word)
            w.insert(rng.randrange(len(w)), word)
        t = " ".join(w)
        rows.append((i, t, "en", "s", len(t), 0.0, "c", "r"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_finds_disguised_words_outside_the_training_rows(spark):
    docs, labels = table(spark)
    model = tx.train(docs, labels.where("doc_id % 5 <> 0"))
    got = tx.score(docs, model, ["doc_id"]).join(labels, "doc_id").where("doc_id % 5 = 0").collect()
    right = sum((r.score >= 0.5) == bool(r.toxic) for r in got)
    assert len(got) == 48 and right >= 46


def test_awkward_rows(spark):
    docs, labels = table(spark, 120)
    model = tx.train(docs.unionAll(frame(spark)), labels)
    rows = awkward()
    got = tx.score(frame(spark, rows), model, ["doc_id", "text", "score"], out_col="p").collect()
    assert len(got) == len(rows) and all(0 <= r.p <= 1 for r in got)
    assert len({r.p for r in got if not r.text}) == 1
    assert len({r.p for r in got if r.doc_id == 3}) == 1


def test_empty_and_one_class(spark):
    docs, labels = table(spark, 30)
    none = labels.where("false")
    for use in (none, labels.where("toxic = 1"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        model = tx.train(docs, use)
        assert tx.score(empty(spark), model, ["doc_id"]).count() == 0
        assert all(0 <= r.score <= 1 for r in tx.score(docs, model, ["doc_id"]).collect())
    assert tx.score(docs, tx.train(empty(spark), none), ["doc_id"]).count() == 30


def test_plain_words_skip_the_trimming(monkeypatch):
    """A word of letters alone has nothing to trim; its restored form is that of the lattice or itself."""
    from carelens.llm import toxicity
    monkeypatch.setattr(toxicity, "_DECOR", None)
    lm = [1.0] * toxicity.SIGMA ** 3
    assert toxicity.restore_word("plain", lm) == ["plain"]
    assert toxicity.restore_word("stuuupid", lm) == toxicity.viterbi("stuuupid", lm)
