"""Registered queries: lexicon, policy, replies, evaluation, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.functions import lexicon as lx
from carelens.functions import policy, text
from carelens.operators import evaluation as ev
from carelens.operators import pairing, profiling, sampling
from carelens.plans.catalog import messages, pairs, register
from carelens.sources import readers
from carelens.sources.adapter import BRAND, BRANDS
from carelens.sources.tables import table

# FIXED VALUES (must equal the reference): sample sizes.
GOLDEN_SIZE = 200
TRAINING_SIZE = 5000
INTENT_SAMPLE_SIZE = 1000
SEED = 42


# --------------------------------------------------------------------
# Derived inputs (every one starts from the driver tables)
# --------------------------------------------------------------------

def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer messages, keep-last per id."""
    return pairing.keep_last(
        pairing.customer_messages(messages(spark, sf_dir))
        .select("tweet_id", "author_id", "text", "created_at", "seq"))


def intent_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer messages with the ordered-rule intent as the label and the
    keyword baseline as the prediction."""
    c = customers(spark, sf_dir)
    return c.select(F.col("tweet_id").alias("customer_tweet_id"),
                    F.col("text").alias("customer_text"),
                    lx.label_column(F.col("text")).alias("intent"),
                    lx.label_column(F.col("text"), lx.KEYWORD_BASELINE_RULES).alias("predicted_intent"))


def _eval_view(spark, sf_dir) -> DataFrame:
    return intent_eval(spark, sf_dir).withColumnsRenamed(
        {"intent": "actual", "predicted_intent": "predicted"})


def spotify_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir, [BRAND]).drop("brand")


def intent_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 1000 brand pairs (explicit order: reply id)."""
    return profiling.first_rows(spotify_pairs(spark, sf_dir), ["brand_tweet_id"], INTENT_SAMPLE_SIZE)


def golden_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_sample(intent_sample(spark, sf_dir), GOLDEN_SIZE, "brand_tweet_id", SEED)


def training_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_sample(spotify_pairs(spark, sf_dir), TRAINING_SIZE, "brand_tweet_id", SEED)


# --------------------------------------------------------------------
# Lexicon, policy, replies
# --------------------------------------------------------------------

@register()
def weak_label(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select("brand_tweet_id", "customer_tweet_id", "customer_text",
                    lx.label_column(F.col("customer_text")).alias("intent"),
                    lx.rule_index_column(F.col("customer_text")).alias("rule_priority"))


@register()
def label_distribution(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return (p.groupBy(lx.label_column(F.col("customer_text")).alias("intent"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "intent"))


@register()
def keyword_baseline(spark, sf_dir):
    return intent_eval(spark, sf_dir).select("customer_tweet_id", "customer_text", "predicted_intent")


@register()
def clean_reply(spark, sf_dir):
    r = pairing.brand_replies(messages(spark, sf_dir), BRANDS)
    return r.select("brand_tweet_id", "brand_text", text.clean_reply(F.col("brand_text")).alias("clean_text"))


@register()
def useful_reply(spark, sf_dir):
    r = pairing.brand_replies(messages(spark, sf_dir), BRANDS)
    cleaned = text.clean_reply(F.col("brand_text"))
    return r.select("brand_tweet_id", cleaned.alias("clean_text"),
                    policy.is_useful_reply(cleaned).alias("useful"))


def _decisions(spark, sf_dir) -> DataFrame:
    e = intent_eval(spark, sf_dir)
    d = policy.handling(F.col("predicted_intent"), F.col("customer_text"))
    return e.select("customer_tweet_id", "customer_text", "intent", "predicted_intent",
                    d.decision.alias("decision"), d.reason.alias("reason"), d.basis.alias("basis"))


@register()
def handling_decision(spark, sf_dir):
    return _decisions(spark, sf_dir).select("customer_tweet_id", "predicted_intent",
                                            "decision", "reason", "basis")


@register()
def handling_counts(spark, sf_dir):
    d = _decisions(spark, sf_dir)
    return d.agg(F.count_if(F.col("decision") == lx.AUTO_HANDLE).cast("bigint").alias("auto_handle"),
                 F.count_if(F.col("decision") == lx.ESCALATE).cast("bigint").alias("escalate"),
                 F.count(F.lit(1)).alias("total"),
                 F.count_if(F.col("basis") == "intent").cast("bigint").alias("escalate_by_intent"),
                 F.count_if(F.col("basis") == "pattern").cast("bigint").alias("escalate_by_pattern"))


def _consistency(spark, sf_dir) -> DataFrame:
    """Decisions under the rule intent beside those under the predicted intent."""
    e = intent_eval(spark, sf_dir)
    expected = policy.handling(F.col("intent"), F.col("customer_text")).decision
    actual = policy.handling(F.col("predicted_intent"), F.col("customer_text")).decision
    return e.select(expected.alias("expected_decision"), actual.alias("actual_decision"))


def labelled_documents(spark, sf_dir) -> DataFrame:
    """Documents with labels that no rule of this engine made."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id")


def _safety(spark, sf_dir) -> DataFrame:
    """Policy cases with a stored expectation: a text labelled toxic is for a person."""
    intent = lx.label_column(F.col("text"))
    return labelled_documents(spark, sf_dir).select(
        F.when(F.col("toxic") == 1, lx.ESCALATE).otherwise(lx.AUTO_HANDLE).alias("expected_decision"),
        policy.handling(intent, F.col("text")).decision.alias("actual_decision"))


def _rules_on_labels(spark, sf_dir) -> DataFrame:
    """Stored quality beside the weak rules' verdict: whether any rule names an intent."""
    named = lx.label_column(F.col("text")) != lx.OTHER
    return labelled_documents(spark, sf_dir).select(
        F.when(F.col("quality") == 1, "good").otherwise("poor").alias("actual"),
        F.when(named, "good").otherwise("poor").alias("predicted"))


def safety_summary(cases: DataFrame) -> DataFrame:
    passed = F.count_if(F.col("expected_decision") == F.col("actual_decision")).cast("bigint")
    return cases.agg(passed.alias("passed"), F.count(F.lit(1)).alias("total")).select(
        "passed", "total",
        F.round(F.coalesce(F.try_divide(F.col("passed") * 100.0, F.col("total")), F.lit(0.0)), 6)
        .alias("safety_score"))


@register()
def safety_score(spark, sf_dir):
    return safety_summary(_safety(spark, sf_dir))


@register()
def safety_confusion(spark, sf_dir):
    """Stored expectation against decision, all four cells."""
    return ev.confusion_matrix_long(_safety(spark, sf_dir).withColumnsRenamed(
        {"expected_decision": "actual", "actual_decision": "predicted"}))


@register()
def policy_consistency(spark, sf_dir):
    return safety_summary(_consistency(spark, sf_dir))


@register()
def weak_label_quality(spark, sf_dir):
    """The weak rules against stored labels, per class and over all."""
    return ev.classification_report(_rules_on_labels(spark, sf_dir))


@register()
def weak_label_confusion(spark, sf_dir):
    return ev.confusion_matrix_long(_rules_on_labels(spark, sf_dir))


@register()
def trust_gate(spark, sf_dir):
    acc = ev.accuracy(_eval_view(spark, sf_dir)).select(
        F.round(F.col("accuracy") * 100.0, 6).alias("intent_accuracy_pct")).scalar()
    s = safety_summary(_safety(spark, sf_dir))
    return s.select(acc.alias("intent_accuracy_pct"),
                    F.col("safety_score").alias("safety_score_pct"),
                    F.when(F.col("safety_score") >= lx.SAFETY_PASS_THRESHOLD, "PASS")
                    .otherwise("NEEDS IMPROVEMENT").alias("safety_assessment"))


# --------------------------------------------------------------------
# Evaluation kit
# --------------------------------------------------------------------

@register()
def prediction_table(spark, sf_dir):
    e = intent_eval(spark, sf_dir)
    return e.select("customer_tweet_id", "customer_text", "intent", "predicted_intent",
                    F.col("intent").eqNullSafe(F.col("predicted_intent")).alias("correct"))


@register()
def intent_accuracy(spark, sf_dir):
    return ev.accuracy(_eval_view(spark, sf_dir))


@register()
def intent_f1(spark, sf_dir):
    return ev.f1_summary(_eval_view(spark, sf_dir))


@register()
def classification_report(spark, sf_dir):
    return ev.classification_report(_eval_view(spark, sf_dir))


@register()
def confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix_long(_eval_view(spark, sf_dir))


@register()
def confusion_pairs(spark, sf_dir):
    return ev.confusion_pairs(_eval_view(spark, sf_dir))


@register()
def misclassified(spark, sf_dir):
    return ev.misclassified(intent_eval(spark, sf_dir), "customer_tweet_id",
                            "intent", "predicted_intent")


@register()
def majority_baseline(spark, sf_dir):
    return ev.majority_baseline(_eval_view(spark, sf_dir))


# --------------------------------------------------------------------
# Sources, sampling and leakage
# --------------------------------------------------------------------

@register()
def resolve_columns(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    col = readers.resolve_column(b, readers.TEXT_CANDIDATES)
    return b.select("item_id", F.col(col).alias("customer_text"))


@register()
def load_history(spark, sf_dir):
    return readers.load_history(pairing.pairs_as_strings(pairs(spark, sf_dir)), strip=True)


@register()
def sample_golden(spark, sf_dir):
    return pairing.pairs_as_strings(golden_sample(spark, sf_dir))


@register()
def golden_template(spark, sf_dir):
    g = golden_sample(spark, sf_dir)
    return g.select("customer_tweet_id", "customer_text", F.lit("").alias("intent"))


@register()
def sample_training(spark, sf_dir):
    return pairing.pairs_as_strings(training_sample(spark, sf_dir))


@register()
def training_without_golden(spark, sf_dir):
    t = training_sample(spark, sf_dir)
    g = golden_sample(spark, sf_dir).select("customer_tweet_id")
    return pairing.pairs_as_strings(t.join(g, "customer_tweet_id", "left_anti"))


@register()
def leakage_check(spark, sf_dir):
    t = training_sample(spark, sf_dir)
    g = golden_sample(spark, sf_dir).select("customer_tweet_id").distinct()
    flagged = t.join(g.withColumn("in_golden", F.lit(True)), "customer_tweet_id", "left")
    golden_rows = golden_sample(spark, sf_dir).agg(F.count(F.lit(1))).scalar()
    return flagged.agg(
        F.count(F.lit(1)).alias("training_rows"),
        F.count_if(F.col("in_golden")).cast("bigint").alias("overlapping_rows"),
        F.count_distinct(F.when(F.col("in_golden"), F.col("customer_tweet_id"))).alias("overlapping_ids"),
    ).select(golden_rows.alias("golden_rows"), "*")


# --------------------------------------------------------------------
# Predictions aligned with labels by key; samples over a larger table
# --------------------------------------------------------------------

def prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predictions table as it may arrive: some keys without a prediction,
    some predicted twice, some never asked for."""
    e = intent_eval(spark, sf_dir)
    key = F.col("customer_tweet_id")
    kept = e.where(key % 7 != 0).select(
        key.alias("customer_tweet_id"), F.col("predicted_intent").alias("predicted"), F.lit(0).alias("batch"))
    again = e.where((key % 7 != 0) & (key % 5 == 0)).select(
        key.alias("customer_tweet_id"), F.lit(lx.OTHER).alias("predicted"), F.lit(1).alias("batch"))
    extra = e.where(key % 7 == 0).select(
        (-key - 1).alias("customer_tweet_id"), F.col("predicted_intent").alias("predicted"), F.lit(0).alias("batch"))
    return kept.unionByName(again).unionByName(extra)


@register()
def aligned_predictions(spark, sf_dir):
    golden = intent_eval(spark, sf_dir).select("customer_tweet_id", F.col("intent").alias("actual"))
    return ev.align(golden, prediction_rows(spark, sf_dir), "customer_tweet_id", "batch")


@register()
def aligned_accuracy(spark, sf_dir):
    """Accuracy over the golden keys: a missing prediction counts as wrong."""
    return ev.accuracy(aligned_predictions(spark, sf_dir).where("status <> 'extra_prediction'"))


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


def _golden_orders(spark, sf_dir):
    first = profiling.first_rows(_orders(spark, sf_dir), ["o_orderkey"], INTENT_SAMPLE_SIZE)
    return sampling.hash_sample(first, GOLDEN_SIZE, "o_orderkey", SEED)


def _training_orders(spark, sf_dir):
    # Another seed than the golden draw, so that the two overlap in part only.
    return sampling.hash_sample(_orders(spark, sf_dir), TRAINING_SIZE, "o_orderkey", SEED + 1)


@register()
def first_orders(spark, sf_dir):
    return profiling.first_rows(_orders(spark, sf_dir), ["o_orderkey"], INTENT_SAMPLE_SIZE)


@register()
def sample_golden_orders(spark, sf_dir):
    return _golden_orders(spark, sf_dir)


@register()
def training_orders_without_golden(spark, sf_dir):
    golden = _golden_orders(spark, sf_dir).select("o_orderkey")
    return _training_orders(spark, sf_dir).join(golden, "o_orderkey", "left_anti")


@register()
def leakage_orders(spark, sf_dir):
    golden = _golden_orders(spark, sf_dir).select("o_orderkey", F.lit(True).alias("in_golden"))
    flagged = _training_orders(spark, sf_dir).join(golden, "o_orderkey", "left")
    return flagged.agg(F.count(F.lit(1)).alias("training_rows"),
                       F.count_if(F.col("in_golden")).cast("bigint").alias("overlapping_rows"))
