"""model_triage fits its model on every row of the history."""

import pytest

from carelens.operators import classifier
from carelens.plans import catalog_text as ct
from carelens.sources.adapter import BRANDS, BRAND


def no_sample(*_):
    raise AssertionError("a sample was taken")


def test_model_triage_takes_no_sample(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(classifier, "hash_sample", no_sample)
    brand = BRANDS.index(BRAND)
    said = ["refund my payment please", "the app crashes again", "songs keep skipping", "add a sleep timer feature"]
    turns = [(conv, turn, "user" if turn % 2 == 0 else "assistant", said[(conv + turn // 2) % 4])
             for conv in (brand, brand + 5, brand + 25, 1, 2) for turn in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert ct.model_triage(spark, str(tmp_path)).count() == 4


def test_a_fit_without_a_limit_counts_every_row(spark, monkeypatch):
    h = spark.createDataFrame([(i, ["refund payment", "app crash"][i % 2], ["Billing", "App"][i % 2]) for i in range(40)],
                              "doc_id long, text string, intent string")
    part = classifier.train(h, "doc_id", "text", "intent", max_train_rows=10)
    assert sum(r.df for r in part.vocab.collect() if r.df) == 3 * 10
    monkeypatch.setattr(classifier, "hash_sample", no_sample)
    whole = classifier.train(h, "doc_id", "text", "intent", max_train_rows=None)
    assert {r.df for r in whole.vocab.collect()} == {20} and whole.vocab.count() == 6
    with pytest.raises(AssertionError, match="sample"):
        classifier.train(h, "doc_id", "text", "intent")


def test_replies_are_cleaned_once_per_historical_row(spark, tmp_path):
    """The plan of best_reply holds no pattern of the cleaning any more; the replies are those of the found rows."""
    from carelens.operators import replies
    said = [(1, 1, 0.9, "@u1 Hi there /LM"), (1, 2, 0.8, "Can you restart the app? https://t.co/1"), (2, 1, 0.5, "@u3")]
    found = spark.createDataFrame(said, "qid long, rank int, similarity double, brand_text string")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    plain = sorted(replies.best_reply(asked, found).collect(), key=lambda r: r.qid)
    assert [r.best_reply for r in plain][0] == "Can you restart the app?" and [r.used_fallback for r in plain] == [False, True, True]
    replies.with_replies(found).write.parquet(f"{tmp_path}/found")
    again = replies.best_reply(asked, spark.read.parquet(f"{tmp_path}/found"))
    assert "regexp_replace" not in again._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(again.collect(), key=lambda r: r.qid) == plain
