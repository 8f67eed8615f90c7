"""Retrieval against brute force, classifier behaviour, sampling,
streaming, and the keep-last dedupe."""

import math
import os
import re
import tempfile
from collections import Counter

from pyspark.sql import functions as F

from carelens.operators import classifier, pairing, retrieval, sampling, vectors
from carelens.plans import catalog_text as ct
from carelens.streaming import triage_stream
from conftest import SF_CHECK, SF_SMALL


def grams(s):
    toks = re.findall(r"\w{2,}", (s or "").lower())  # Python's Unicode \w
    return toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])]


def brute_force(history, queries, k=3):
    """Exhaustive scoring of every query against every document of its
    block, with the same tf-idf formulas, rounding and tie order."""
    n = len(history)
    tf = {d: Counter(grams(t)) for d, t, _ in history}
    df = Counter(term for c in tf.values() for term in c)
    vocab = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items() if c >= 2 and c <= 0.95 * n}

    def vec(counts):
        raw = {t: (1 + math.log(c)) * vocab[t] for t, c in counts.items() if t in vocab}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        return {t: v / norm for t, v in raw.items()} if norm else {}
    dv = {d: vec(c) for d, c in tf.items()}
    intents = {i for _, _, i in history}
    out = {}
    for qid, text, intent in queries:
        qv = vec(Counter(grams(text)))
        block = [d for d, _, i in history if (i == intent or intent not in intents)]
        scored = [(round(sum(w * dv[d].get(t, 0.0) for t, w in qv.items()), 6), d) for d in block]
        scored.sort(key=lambda x: (-x[0], -x[1]))
        out[qid] = [(d, s) for s, d in scored[:k]]
    return out


def test_retrieval_equals_brute_force(spark):
    h = ct.retrieval_history(spark, SF_CHECK)
    q = ct.retrieval_queries(spark, SF_CHECK)
    got = {}
    for r in retrieval.retrieve_topk(q, h, 3).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.doc_id, r.similarity))
    hist = [(r.doc_id, r.text, r.intent) for r in h.collect()]
    qs = [(r.qid, r.text, r.intent) for r in q.collect()]
    want = brute_force(hist, qs, 3)
    assert set(got) == set(want)
    for qid in want:
        assert [d for d, _ in got[qid]] == [d for d, _ in want[qid]], qid
        for (_, a), (_, b) in zip(got[qid], want[qid]):
            assert abs(a - b) < 2e-6


def test_retrieval_pads_and_fallback(spark):
    hist = spark.createDataFrame(
        [(1, "my app keeps crashing today", "App"), (2, "app crashing again today", "App"),
         (3, "refund my payment please", "Billing"), (4, "refund the payment now", "Billing"),
         (5, "the app is fine", "App")],
        "doc_id long, text string, intent string")
    queries = spark.createDataFrame(
        [(10, "zzz qqq nothing shared", "App"), (11, "refund payment", "Playlist"),
         (12, "app crashing", "App")], "qid long, text string, intent string")
    res = {}
    for r in retrieval.retrieve_topk(queries, hist, 3).orderBy("qid", "rank").collect():
        res.setdefault(r.qid, []).append((r.doc_id, r.similarity, r.block))
    # No shared term: three zero rows of the App block in tie order.
    assert [(d, s) for d, s, _ in res[10]] == [(5, 0.0), (2, 0.0), (1, 0.0)]
    # Intent without history: search all history.
    assert res[11][0][2] == retrieval.ALL_BLOCK and {res[11][0][0], res[11][1][0]} == {3, 4}
    assert res[12][0][1] > 0 and len(res[12]) == 3


def test_tfidf_rows_are_unit_length(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    idx = vectors.fit_tfidf(d, "doc_id", "text")
    norms = idx.weights.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("n"))
    assert norms.filter(F.abs(F.col("n") - 1.0) > 1e-9).count() == 0


def test_classifier_learns_weak_labels_and_round_trips(spark):
    h = ct.retrieval_history(spark, SF_CHECK)
    model = classifier.train(h, "doc_id", "text", "intent")
    pred = classifier.predict(model, h, "doc_id", "text").join(h.select("doc_id", "intent"), "doc_id")
    n = pred.count()
    acc = pred.filter(F.col("intent") == F.col("predicted_intent")).count() / n
    majority = h.groupBy("intent").count().agg(F.max("count")).first()[0] / n
    assert acc > majority
    again = classifier.predict(classifier.train(h, "doc_id", "text", "intent"), h, "doc_id", "text")
    a = {r.doc_id: r.predicted_intent for r in pred.collect()}
    b = {r.doc_id: r.predicted_intent for r in again.collect()}
    assert a == b
    path = tempfile.mkdtemp(prefix="carelens-model-")
    classifier.save(model, path)
    loaded = classifier.load(spark, path)
    c = {r.doc_id: r.predicted_intent for r in classifier.predict(loaded, h, "doc_id", "text").collect()}
    assert c == a


def test_keep_last(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 0), (1, "z", 2)],
                               "tweet_id long, text string, seq int")
    got = {r.tweet_id: r.text for r in pairing.keep_last(df).collect()}
    assert got == {1: "z", 2: "c"}


def test_stream_matches_batch(spark):
    from carelens.sources.adapter import messages_from_conversations
    m = messages_from_conversations(spark.read.parquet(f"{SF_SMALL}/conversations.parquet"))
    root = tempfile.mkdtemp(prefix="carelens-stream-")
    src = os.path.join(root, "in")
    m.drop("seq").write.parquet(src)
    q = triage_stream.start(spark, src, os.path.join(root, "out"), os.path.join(root, "ckpt"))
    q.awaitTermination(120)
    streamed = spark.read.parquet(os.path.join(root, "out"))
    batch = triage_stream.decide(spark.read.parquet(src))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_search_scores_few_pairs(spark):
    """Documents with and without a copy of themselves in the history, all in one block: the
    bounds leave less than 30 % of the pairs, and the first three are those of brute force."""
    d = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text", F.lit("all").alias("intent"))
    h = d.where(F.col("doc_id") % 2 == 0)
    hist = [(r.doc_id, r.text, r.intent) for r in h.collect()]
    for name, most, asked in (("copy", 0.1, d.where(F.col("doc_id") % 50 == 0)), ("other", 0.3, d.where(F.col("doc_id") % 50 == 1))):
        asked = asked.withColumnRenamed("doc_id", "qid")
        q, qt, index = retrieval.postings(asked, h)
        pairs = retrieval.candidates(qt, index, 3).count() / (asked.count() * h.count())
        assert 0 < pairs < most, (name, pairs)
        got = retrieval._top_k(retrieval.search(qt, index, 3), 3)
        found = {}
        for r in got.orderBy("qid", "rank").collect():
            found.setdefault(r.qid, []).append((r.doc_id, r.similarity))
        want = brute_force(hist, [(r.qid, r.text, r.intent) for r in asked.collect()], 3)
        for qid, rows in want.items():
            rows = [(i, s) for i, s in rows if s > 0]
            assert [i for i, _ in found.get(qid, [])][:len(rows)] == [i for i, _ in rows], qid


def test_hot_parent_is_split(spark):
    """Nine in ten replies answer one message: AQE splits that partition."""
    n = 20_000
    rows = spark.range(n).select(
        (F.col("id") + 10**6).alias("tweet_id"), F.lit("SpotifyCares").alias("author_id"), F.lit(False).alias("inbound"),
        F.lit("t").alias("created_at"), F.repeat(F.lit("reply "), 20).alias("text"),
        F.lit(None).cast("string").alias("response_tweet_id"),
        F.when(F.col("id") % 10 > 0, F.lit(1)).otherwise(F.col("id")).cast("long").alias("in_response_to_tweet_id"),
        F.lit(0).alias("seq"))
    asked = spark.range(n).select(
        F.col("id").alias("tweet_id"), F.lit("u").alias("author_id"), F.lit(True).alias("inbound"),
        F.lit("t").alias("created_at"), F.lit("help").alias("text"), F.lit(None).cast("string").alias("response_tweet_id"),
        F.lit(None).cast("long").alias("in_response_to_tweet_id"), F.lit(0).alias("seq"))
    root = tempfile.mkdtemp(prefix="carelens-hot-")
    rows.unionByName(asked).repartition(16).write.parquet(f"{root}/log")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        pairs = pairing.pair_conversations(spark.read.parquet(f"{root}/log"), ["SpotifyCares"])
        assert pairs.count() == n
        seen = pairs.select("brand_tweet_id", "customer_text")
        seen.collect()
        assert "skew=true" in seen._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_long_conversations_keep_their_ids_apart(spark):
    from carelens.sources.adapter import messages_from_conversations
    turns = spark.range(1500).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").cast("long").alias("turn"),
                                     F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                     F.concat(F.lit("t"), F.col("id")).alias("text"))
    both = turns.unionByName(turns.withColumn("conv_id", F.lit(2).cast("long")))
    m = messages_from_conversations(both)
    assert m.select("tweet_id").distinct().count() == m.count() == 3000
    from carelens.sources.adapter import BRANDS
    assert pairing.pair_conversations(m, BRANDS).count() == 1500


def test_scoring_equals_the_library(spark):
    """Lazy scoring by coefficients gives what MLlib's transform gives; the fit is at a stationary point."""
    h = ct.retrieval_history(spark, SF_CHECK)
    model = classifier.train(h, "doc_id", "text", "intent", solver="mllib")
    mine = {r.doc_id: r.predicted_intent for r in classifier.predict(model, h, "doc_id", "text").collect()}
    feats = classifier.features(h, "doc_id", "text", model.vocab, model.lr.numFeatures)
    theirs = {r.id: model.labels[int(r.prediction)] for r in model.lr.transform(feats).collect()}
    assert mine == theirs and set(mine.values()) <= set(model.labels)


def test_fit_is_stationary(spark):
    """The gradient of the stated objective vanishes at the fitted coefficients."""
    import numpy as np
    h = ct.retrieval_history(spark, SF_CHECK)
    model = classifier.train(h, "doc_id", "text", "intent", solver="mllib")
    rows = (classifier.features(h, "doc_id", "text", model.vocab, model.lr.numFeatures)
            .join(h.select(F.col("doc_id").alias("id"), "intent"), "id").collect())
    x = np.array([r.features.toArray() for r in rows])
    y = np.array([model.labels.index(r.intent) for r in rows])
    n, k = len(rows), len(model.labels)
    weight = n / (k * np.bincount(y, minlength=k)[y])
    coef, bias = model.lr.coefficientMatrix.toArray(), model.lr.interceptVector.toArray()
    z = x @ coef.T + bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(n), y] -= 1
    p *= weight[:, None] / n
    assert np.abs(p.T @ x + coef / n).max() < 1e-4 and np.abs(p.sum(axis=0)).max() < 1e-4


def test_fixed_steps_equal_numpy_and_near_the_optimum(spark):
    """The joins and sums of a step are the gradient step; the loss falls; nearly all rows get MLlib's class."""
    import numpy as np
    h = ct.retrieval_history(spark, SF_CHECK)
    mllib = classifier.train(h, "doc_id", "text", "intent", solver="mllib")
    model = classifier.train(h, "doc_id", "text", "intent")
    rows = (classifier.features(h, "doc_id", "text", mllib.vocab, mllib.lr.numFeatures)
            .join(h.select(F.col("doc_id").alias("id"), "intent"), "id").orderBy("id").collect())
    x = np.array([[*r.features.toArray(), 1.0] for r in rows])
    y = np.array([model.labels.index(r.intent) for r in rows])
    n, k = len(rows), len(model.labels)
    weight = n / (k * np.bincount(y, minlength=k)[y])
    ridge = np.full((x.shape[1], 1), 1 / n)
    ridge[-1] = 0

    def loss(w):
        z = x @ w
        z -= z.max(axis=1, keepdims=True)
        return (weight * (np.log(np.exp(z).sum(axis=1)) - z[np.arange(n), y])).mean() + (ridge * w * w).sum() / 2

    w = v = np.zeros((x.shape[1], k))
    losses = [loss(w)]
    for step in range(classifier.STEPS):
        p = np.exp(x @ v - (x @ v).max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        new = v - classifier.RATE * (x.T @ (p * weight[:, None]) / n + ridge * v)
        v, w = new + classifier.momentum(step) * (new - w), new
        losses.append(loss(w))
    assert all(b < a for a, b in zip(losses, losses[1:], strict=False)), losses
    order = {r.term: int(r.term_index) for r in mllib.vocab.collect()}
    for r in model.vocab.collect():
        assert np.abs(np.array(r.coefs) - w[order[r.term]]).max() < 1e-9
    assert np.abs(np.array(model.bias) - w[-1]).max() < 1e-9
    a, b = ({r.doc_id: r.predicted_intent for r in classifier.predict(m, h, "doc_id", "text").collect()} for m in (model, mllib))
    assert sum(a[i] == b[i] for i in a) >= 0.9 * len(a)


def test_classifier_edge_rows(spark):
    rows = [(1, "refund my payment", "Billing"), (2, "refund payment now", "Billing"), (3, None, "App"), (4, "", "App"),
            (5, "app crash again", "App"), (6, "app crash", "App"), (7, "refund", None)]
    h = spark.createDataFrame(rows, "doc_id long, text string, intent string")
    model = classifier.train(h, "doc_id", "text", "intent")
    got = {r.doc_id: r.predicted_intent for r in classifier.predict(model, h, "doc_id", "text").collect()}
    assert set(got) == set(range(1, 8)) and got[2] == got[7] == "Billing" and got[6] == "App"
    one = classifier.train(h.where("intent = 'App'"), "doc_id", "text", "intent")
    assert {r.predicted_intent for r in classifier.predict(one, h, "doc_id", "text").collect()} == {"App"}
