"""Registered queries: n-grams, TF-IDF, retrieval, replies, prompts,
response parsing and judge calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.functions import lexicon as lx
from carelens.functions import policy, prompts, responses
from carelens.functions import text as tx
from carelens.operators import judging, pairing, replies, retrieval, sampling, vectors
from carelens.plans.catalog import messages, pairs, register
from carelens.session import delete_path, materialize, write_once
from carelens.plans.catalog_more import GOLDEN_SIZE, customers, golden_sample, spotify_pairs
from carelens.sources import readers, responses_adapter
from carelens.sources.tables import table

# FIXED VALUES (must equal the reference): neighbours and calibration rows.
TOP_K = 3
CALIBRATION_SIZE = 8
SEED = 42


# --------------------------------------------------------------------
# Inputs
# --------------------------------------------------------------------

def _history_from_pairs(p: DataFrame) -> DataFrame:
    h = readers.load_history(p)
    return h.select(F.col("brand_tweet_id").alias("doc_id"),
                    F.col("customer_text").alias("text"),
                    lx.label_column(F.col("customer_text")).alias("intent"),
                    "customer_tweet_id", "brand_text")


def _queries_from(cust: DataFrame, brand_pairs: DataFrame) -> DataFrame:
    hist_ids = brand_pairs.select(F.col("customer_tweet_id").alias("tweet_id"))
    return (cust.join(hist_ids, "tweet_id", "left_anti")
            .select(F.col("tweet_id").alias("qid"), "text",
                    lx.label_column(F.col("text")).alias("intent")))


def retrieval_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand history: (doc_id = reply id, text = customer message, intent
    = rule label, customer_tweet_id, brand_text)."""
    return _history_from_pairs(spotify_pairs(spark, sf_dir))


def retrieval_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming messages: customer messages the brand history does not
    contain, labelled with the rule intent."""
    return _queries_from(customers(spark, sf_dir), spotify_pairs(spark, sf_dir))


def retrieval_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, history), each written once. The deduped customer
    messages are derived once and feed both the brand pairs and the
    incoming queries."""
    from carelens.sources.adapter import BRAND
    m = messages(spark, sf_dir)
    cust = materialize(pairing.keep_last(
        pairing.customer_messages(m).select("tweet_id", "author_id", "text", "created_at", "seq")))
    replies_ = pairing.brand_replies(m, [BRAND])
    brand_pairs = materialize(
        replies_.join(cust, replies_.parent_tweet_id == cust.tweet_id)
        .select(F.col("tweet_id").alias("customer_tweet_id"), F.col("text").alias("customer_text"),
                "brand_tweet_id", "brand_text"))
    history = materialize(_history_from_pairs(brand_pairs))
    queries = materialize(_queries_from(cust, brand_pairs))
    return queries, history


def retrieved_with_queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, results); the results have the cleaned replies, made once per historical row."""
    q, h = retrieval_inputs(spark, sf_dir)
    h = materialize(replies.with_replies(h))
    return q, retrieval.retrieve_topk(q, h, TOP_K, inputs_materialized=True)


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, h = retrieval_inputs(spark, sf_dir)
    return retrieval.retrieve_topk(q, h, TOP_K, inputs_materialized=True)


# --------------------------------------------------------------------
# Vectors
# --------------------------------------------------------------------

@register()
def ngrams(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return vectors.ngrams(d, "doc_id", "text").withColumnRenamed("id", "doc_id")


@register()
def vocabulary(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    idx = vectors.fit_tfidf(d, "doc_id", "text")
    vocab = materialize(idx.vocab)
    return vocab.join(vectors.words(idx.words, vocab), "term").select(
        F.col("word").alias("term"), "df", F.round("idf", 6).alias("idf"))


@register()
def tfidf_weights(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    idx = vectors.fit_tfidf(d, "doc_id", "text")
    vocab, path = write_once(idx.vocab, "vocabulary")
    named = materialize(vocab.select("term", "idf").join(vectors.words(idx.words, vocab), "term"))
    for done in (path, idx.words_path):
        delete_path(spark, done)
    return (vectors.transform_in_slices(d, "doc_id", "text", named, keep=["word"])
            .select(F.col("id").alias("doc_id"), F.col("word").alias("term"), "weight"))


# --------------------------------------------------------------------
# Retrieval and replies
# --------------------------------------------------------------------

RESULT_COLS = ["qid", "block", "rank", "doc_id", "similarity", "intent", "text",
               "customer_tweet_id", "brand_text"]


@register()
def retrieve_topk(spark, sf_dir):
    return retrieved(spark, sf_dir).select(*RESULT_COLS)


@register()
def retrieve_fallback(spark, sf_dir):
    return retrieved(spark, sf_dir).filter(F.col("block") == retrieval.ALL_BLOCK).select(*RESULT_COLS)


@register()
def best_reply(spark, sf_dir):
    q, r = retrieved_with_queries(spark, sf_dir)
    return replies.best_reply(q, r)


@register()
def build_prompts(spark, sf_dir):
    q, r = retrieved_with_queries(spark, sf_dir)
    return replies.grounded_prompts(q, r)


@register()
def triage(spark, sf_dir):
    """Per incoming message: intent -> top-k history -> best reply ->
    handling decision."""
    q, r = retrieved_with_queries(spark, sf_dir)
    best = replies.best_reply(q, r)
    d = policy.handling(F.col("intent"), F.col("text"))
    return (q.join(best, "qid")
            .select("qid", "intent", "best_reply", "used_fallback",
                    d.decision.alias("decision"), d.reason.alias("reason")))


# --------------------------------------------------------------------
# Prompts, responses, judge calibration
# --------------------------------------------------------------------

@register()
def reply_prompts(spark, sf_dir):
    c = customers(spark, sf_dir)
    return c.select(F.col("tweet_id").alias("customer_tweet_id"),
                    prompts.reply_prompt(F.col("text")).alias("prompt"))


@register()
def judge_prompts(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select("brand_tweet_id",
                    prompts.judge_prompt(F.col("customer_text"),
                                         tx.clean_reply(F.col("brand_text"))).alias("prompt"))


@register()
def parse_agent_responses(spark, sf_dir):
    r = responses.parse_agent_responses(responses_adapter.agent_responses(pairs(spark, sf_dir)))
    return r.select("request_id", "reply", "decision", "reason", "error")


@register()
def parse_judge_responses(spark, sf_dir):
    r = responses.parse_judge_responses(responses_adapter.judge_responses(pairs(spark, sf_dir)))
    return r.select("request_id", "score", "reason", "error")


def calibration_rows(spark, sf_dir) -> DataFrame:
    """Written once: the judge table feeds filters and joins, which must
    not pull the parse steps into their predicates."""
    p = materialize(pairs(spark, sf_dir))
    return materialize(judging.calibration_table(
        p, responses_adapter.judge_responses(p), responses_adapter.human_scores(p)))


@register()
def judge_agreement(spark, sf_dir):
    return judging.agreement(calibration_rows(spark, sf_dir))


@register()
def judge_pending(spark, sf_dir):
    sample = sampling.hash_sample(golden_sample(spark, sf_dir), CALIBRATION_SIZE,
                                  "brand_tweet_id", SEED)
    done = calibration_rows(spark, sf_dir).filter(F.col("llm_judge_score").isNotNull())
    return pairing.pairs_as_strings(judging.pending(sample, done, "brand_tweet_id"))


@register()
def judge_merge(spark, sf_dir):
    rows = calibration_rows(spark, sf_dir).filter(F.col("llm_judge_score").isNotNull())
    existing = rows.filter(F.col("request_id") % 2 == 0).withColumn("batch", F.lit("existing"))
    new = rows.filter(F.col("request_id") % 2 == 1).withColumn("batch", F.lit("new"))
    return judging.merge(existing, new)


# --------------------------------------------------------------------
# Classifier (rows-only oracle: an iterative fit has no SQL twin)
# --------------------------------------------------------------------

@register()
def train_intent_model(spark, sf_dir):
    """Training-set predictions of the fitted model next to the weak labels."""
    from carelens.operators import classifier
    _, h = retrieval_inputs(spark, sf_dir)
    model = classifier.train(h, "doc_id", "text", "intent")
    pred = classifier.predict(model, h, "doc_id", "text")
    return h.select("doc_id", "intent").join(pred, "doc_id")


@register()
def classifier_inputs(spark, sf_dir):
    """What the fit gets: label, balanced class weight and unit TF-IDF row of every training pair."""
    h = materialize(retrieval_history(spark, sf_dir).select("doc_id", "text", "intent"))
    per = h.groupBy("intent").agg(F.count(F.lit(1)).alias("n_c"))
    n = h.agg(F.count(F.lit(1))).scalar()
    k = h.agg(F.count_distinct("intent")).scalar()
    w = vectors.fit_tfidf(h, "doc_id", "text").weights.groupBy(F.col("id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("weight"), 6).alias("weight_sum"),
        F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("squares"))
    return (h.join(per, "intent").join(w, "doc_id", "left")
            .select("doc_id", "intent", F.round(n / (k * F.col("n_c")), 6).alias("class_weight"),
                    F.coalesce("n_terms", F.lit(0)).cast("bigint").alias("n_terms"), "weight_sum", "squares"))


def _fitted_without_golden(spark, sf_dir):
    """The model of the training sample without the golden rows, and these rows."""
    from carelens.operators import classifier
    p = materialize(spotify_pairs(spark, sf_dir))
    labelled = _queries_from(customers(spark, sf_dir), p).withColumnRenamed("qid", "customer_tweet_id")
    golden = materialize(sampling.hash_sample(labelled, GOLDEN_SIZE, "customer_tweet_id", SEED))
    train = (p.select("brand_tweet_id", "customer_tweet_id", F.col("customer_text").alias("text"),
                      lx.label_column(F.col("customer_text")).alias("intent"))
             .join(golden.select("customer_tweet_id"), "customer_tweet_id", "left_anti"))
    return classifier.train(train, "brand_tweet_id", "text", "intent"), golden


def _model_on_golden(spark, sf_dir):
    from carelens.operators import classifier
    from carelens.operators import evaluation as ev
    model, golden = _fitted_without_golden(spark, sf_dir)
    pred = classifier.predict(model, golden, "customer_tweet_id", "text").select(
        "customer_tweet_id", F.col("predicted_intent").alias("predicted"), F.lit(0).alias("batch"))
    aligned = ev.align(golden.select("customer_tweet_id", F.col("intent").alias("actual")), pred,
                       "customer_tweet_id", "batch")
    return aligned.join(golden.select("customer_tweet_id", "text"), "customer_tweet_id")


@register()
def model_report(spark, sf_dir):
    """Per-class report of the fitted model on golden rows it was not fitted on."""
    from carelens.operators import evaluation as ev
    return ev.classification_report(_model_on_golden(spark, sf_dir))


@register()
def model_handling(spark, sf_dir):
    """Policy decisions on the model's intent beside those on the label; the safety of each row."""
    rows = _model_on_golden(spark, sf_dir)
    got = policy.handling(F.col("predicted"), F.col("text"))
    want = policy.handling(F.col("actual"), F.col("text"))
    return rows.select("customer_tweet_id", "actual", "predicted", got.decision.alias("decision"),
                       want.decision.alias("expected_decision"),
                       ((want.decision == lx.AUTO_HANDLE) | (got.decision == lx.ESCALATE)).alias("safe"))


@register()
def model_triage(spark, sf_dir):
    """Triage with the intent, the retrieval block and the decision of the model fitted on all history."""
    from carelens.operators import classifier
    q, h = retrieval_inputs(spark, sf_dir)
    model = classifier.train(h, "doc_id", "text", "intent", max_train_rows=None)
    pred = classifier.predict(model, q, "qid", "text")
    asked = materialize(q.drop("intent").join(pred, "qid").withColumnRenamed("predicted_intent", "intent"))
    h = materialize(replies.with_replies(h))
    best = replies.best_reply(asked, retrieval.retrieve_topk(asked, h, TOP_K, inputs_materialized=True))
    d = policy.handling(F.col("intent"), F.col("text"))
    return asked.join(best, "qid").select("qid", "intent", "best_reply", "used_fallback",
                                          d.decision.alias("decision"), d.reason.alias("reason"))


@register()
def predict_intent(spark, sf_dir):
    """Model intent for every incoming message (batch scoring, once)."""
    from carelens.operators import classifier
    q, h = retrieval_inputs(spark, sf_dir)
    model = classifier.train(h, "doc_id", "text", "intent")
    return classifier.predict(model, q, "qid", "text")
