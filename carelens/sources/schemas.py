"""Declared schemas: nothing is inferred."""

from pyspark.sql import types as T

MESSAGES = T.StructType([
    T.StructField("tweet_id", T.LongType()),
    T.StructField("author_id", T.StringType()),
    T.StructField("inbound", T.BooleanType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("response_tweet_id", T.StringType()),
    T.StructField("in_response_to_tweet_id", T.LongType()),
])

PAIRS = T.StructType([
    T.StructField("customer_tweet_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("customer_text", T.StringType()),
    T.StructField("customer_created_at", T.StringType()),
    T.StructField("brand_tweet_id", T.StringType()),
    T.StructField("parent_tweet_id", T.StringType()),
    T.StructField("brand_text", T.StringType()),
    T.StructField("brand_created_at", T.StringType()),
])

GOLDEN = T.StructType([
    T.StructField("customer_tweet_id", T.LongType()),
    T.StructField("customer_text", T.StringType()),
    T.StructField("intent", T.StringType()),
])

PREDICTIONS = T.StructType([
    T.StructField("customer_tweet_id", T.LongType()),
    T.StructField("customer_text", T.StringType()),
    T.StructField("intent", T.StringType()),
    T.StructField("predicted_intent", T.StringType()),
    T.StructField("correct", T.BooleanType()),
])

# The calibration file is ragged (rows carry 7 to 9 fields under a
# 6-name header), so it is read with nine positional fields.
CALIBRATION_RAW = T.StructType([
    T.StructField("customer_text", T.StringType()),
    T.StructField("generated_reply", T.StringType()),
    T.StructField("llm_judge_score", T.StringType()),
    T.StructField("llm_judge_reason", T.StringType()),
    T.StructField("blank", T.StringType()),
    T.StructField("human_score", T.StringType()),
    T.StructField("note1", T.StringType()),
    T.StructField("note2", T.StringType()),
    T.StructField("note3", T.StringType()),
])
