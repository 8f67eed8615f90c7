import random

import numpy as np
from pyspark.sql import functions as F

from carelens.llm import langid as li
from carelens.llm.registry import PIECES

from llm_helpers import awkward, empty, frame

TONGUES = {"aa": "the house of water was under and over that tree".split(),
           "bb": "das Haus und der Wasser unter einem alten Baum".split(),
           "cc": "la maison est sous un arbre avec de l'eau".split()}


def table(spark, n=150):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = rng.choice(list(TONGUES))
        rows.append((i, " ".join(rng.choice(TONGUES[lang]) for _ in range(rng.randint(5, 40))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    docs = table(spark)
    for rounds in (1, 2):
        langs, probs = li.train(docs, F.col("doc_id") % 3 != 0, PIECES, rounds=rounds)
        assert langs == sorted(TONGUES) and np.allclose(probs.sum(axis=0), 1, atol=1e-6)
        got = li.predict(docs, langs, probs, PIECES, ["doc_id", "lang"]).where("doc_id % 3 = 0").collect()
        assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
        assert all(0 < r.score <= 1 for r in got)


def test_forward_sums_all_segmentations():
    pieces = li.piece_table(PIECES)
    ids = {p: k for k, p in enumerate(li.vocabulary(PIECES))}
    rng = np.random.default_rng(0)
    probs = rng.random((len(ids) + 1, 2))

    def by_hand(w):
        if not w:
            return np.ones(2)
        total = np.zeros(2)
        for k in range(1, len(w) + 1):
            at = ids.get(w[:k], len(ids) if k == 1 else None)
            if at is not None:
                total = total + probs[at] * by_hand(w[k:])
        return total

    words = ["▁the", "▁ception", "▁日本", "▁éa∆", "▁x"]
    got = li.Lattice(pieces, probs).log_probs(words)
    assert np.allclose(got, [np.log(by_hand(w)) for w in words])
    counts = li.Lattice(pieces, probs[:, :1]).expected(["▁x"], np.array([[2.0]]))
    assert counts.sum() > 2 - 1e-9


def test_awkward_rows(spark):
    docs = frame(spark)
    langs, probs = li.train(docs, F.lit(True), PIECES)
    assert langs == ["en", "fr"]
    got = li.predict(docs, langs, probs, PIECES, ["doc_id", "text"]).collect()
    assert len(got) == len(awkward())
    for r in got:
        blank = not r.text or not any(map(str.isalpha, r.text))
        assert (r.lang_pred == "und") == blank and (r.score == 0) == blank
    assert li.predict(empty(spark), langs, probs, PIECES, ["doc_id"]).count() == 0


def test_without_training_rows(spark):
    langs, probs = li.train(empty(spark), F.lit(True), PIECES)
    assert langs == [] and {r.lang_pred for r in li.predict(frame(spark), langs, probs, PIECES, ["doc_id"]).collect()} == {"und"}


def test_long_words_are_summed_whole(monkeypatch):
    """A word of 60 characters, also of characters in no piece: all segmentations, and their piece counts."""
    pieces, ids = li.piece_table(PIECES), {p: k for k, p in enumerate(li.vocabulary(PIECES))}
    rng = np.random.default_rng(1)
    probs = rng.random((len(ids) + 1, 2)) * 1e-3
    word = li.MARK + "".join(rng.choice(list("theandingßüж日"), 60))
    n = len(word)

    def sums(w):  # log sums of all beginnings, by the recursion
        out = [np.zeros(2)]
        for j in range(1, len(w) + 1):
            total = np.zeros(2)
            for i in range(max(0, j - pieces.longest), j):
                at = ids.get(w[i:j], len(ids) if j == i + 1 else None)
                if at is not None:
                    total = total + np.exp(out[i] - out[j - 1]) * probs[at]
            out.append(out[j - 1] + np.log(total))
        return out

    lattice = li.Lattice(pieces, probs)
    assert np.allclose(lattice.log_probs([word, "a"])[0], sums(word)[n])
    long = lattice.expected([word], np.array([[2.0, 3.0]]))
    monkeypatch.setattr(li, "SHORT_WORD", 100)
    assert np.allclose(lattice.log_probs([word])[0], sums(word)[n])
    assert np.allclose(lattice.expected([word], np.array([[2.0, 3.0]])), long)
    monkeypatch.undo()
    very = lattice.log_probs([word * 200])
    assert np.isfinite(very).all()
