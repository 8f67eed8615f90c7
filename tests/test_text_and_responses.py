"""Cleaning, tokens, prompts, response parsing and judge calibration."""

from pyspark.sql import functions as F

from carelens.functions import policy, prompts, responses
from carelens.functions import text as tx
from carelens.operators import judging
from carelens.sources import readers
from conftest import data_file


# Message and the reply expected from it, written by hand.
CLEAN_CASES = [
    ("@SpotifyCares Hi there! Try this https://t.co/abc123 /LM", "Hi there! Try this"),
    ("@Éva_1 Bonjour à vous /AU", "Bonjour à vous"),
    ("Multiple   spaces\n\tand tabs /JS done", "Multiple spaces and tabs done"),
    ("No initials /lm here /ABC and /XY", "No initials /lm here /ABC and"),
    ("  leading and trailing  ", "leading and trailing"),
    ("handle@inside word and @user_2 http://x.y/z?q=1", "handle word and"),
    ("/AB", ""),
    ("émoji 😭😭 @u12 https://t.co/ab /LM", "émoji 😭😭"),
    ("", ""),
    (None, None),
]


def test_clean_reply_cases(spark):
    df = spark.createDataFrame([(s,) for s, _ in CLEAN_CASES], "t string")
    got = [r.c for r in df.select(tx.clean_reply(F.col("t")).alias("c")).collect()]
    assert got == [want for _, want in CLEAN_CASES]


def test_tokens_and_bigrams(spark):
    cases = [
        ("Étion dans, ç x 12 a_b", ["étion", "dans", "12", "a_b", "étion dans", "dans 12", "12 a_b"]),
        ("one", ["one"]), ("", []), (None, None),
        ("Hello hello WORLD", ["hello", "hello", "world", "hello hello", "hello world"])]
    df = spark.createDataFrame([(s,) for s, _ in cases], "t string")
    got = [r.g for r in df.select(tx.unigrams_and_bigrams(tx.tokens(F.col("t"))).alias("g")).collect()]
    assert got == [want for _, want in cases]


def test_py_strip(spark):
    cases = ["  x y 　", "\n\tz", "a"]
    df = spark.createDataFrame([(s,) for s in cases], "t string")
    assert [r.s for r in df.select(tx.py_strip(F.col("t")).alias("s")).collect()] == [s.strip() for s in cases]


def test_useful_reply(spark):
    cases = [("Can you restart the app?", True), ("We've sent you a bit more info over DM", False),
             ("Thanks!", False), ("Which OS are you on", True), ("most welcome", True), (None, False)]
    df = spark.createDataFrame(cases, "t string, e boolean")
    for r in df.select("e", policy.is_useful_reply(F.col("t")).alias("u")).collect():
        assert r.u == r.e


def test_template_render(spark):
    df = spark.createDataFrame([("my app crashed", "Thanks, try again")], "c string, r string")
    got = df.select(prompts.judge_prompt(F.col("c"), F.col("r")).alias("p")).first().p
    rubric = prompts.RUBRIC.format()
    assert got == prompts.JUDGE_PROMPT.format(customer_text="my app crashed", reply="Thanks, try again",
                                              rubric=rubric)
    ex = df.select(prompts.example_block(F.lit(2), F.col("c"), F.col("r"), F.lit(0.12345)).alias("e")).first().e
    assert ex == prompts.EXAMPLE_TEMPLATE.format(rank=2, customer_text="my app crashed",
                                                 reply="Thanks, try again", similarity="0.123")
    g = df.select(prompts.grounded_prompt(F.col("c"), F.lit("Other / Unclear"), F.lit("EX")).alias("g")).first().g
    assert g == prompts.GROUNDED_PROMPT.format(customer_text="my app crashed", intent="Other / Unclear",
                                               examples="EX")


# Response text and (reply, decision, reason, error) expected from it.
AGENT_CASES = [
    ('{"reply": " Hi! ", "decision": "AUTO-HANDLE", "reason": "simple"}', ("Hi!", "AUTO-HANDLE", "simple", None)),
    ('```json\n{"reply": "Hello", "decision": "escalate", "reason": "billing"}\n```',
     ("Hello", "ESCALATE", "billing", None)),
    ('```JSON {"reply": "x", "decision": "ESCALATE", "reason": "r"}```', ("x", "ESCALATE", "r", None)),
    ('{"reply": "x", "decision": "ESCALATE"}', (None, None, None, "missing_fields")),
    ('{"reply": "x", "decision": "MAYBE", "reason": "r"}', (None, None, None, "invalid_decision")),
    ("Sorry, I cannot do that.", (None, None, None, "invalid_json")),
    ('{"reply": null, "decision": "ESCALATE", "reason": "r"}', ("None", "ESCALATE", "r", None)),
    ("[1, 2]", (None, None, None, "invalid_json")),
    ('{"reply": true, "decision": "ESCALATE", "reason": false}', ("True", "ESCALATE", "False", None)),
    ('{"reply": 1.0, "decision": "ESCALATE", "reason": 12}', ("1.0", "ESCALATE", "12", None)),
    ('{"reply": ["a"], "decision": "ESCALATE", "reason": "r"}', (None, None, None, "nested_field")),
    ('{"reply": "a", "decision": "ESCALATE", "reason": {"k": 1}}', (None, None, None, "nested_field")),
    (None, (None, None, None, "invalid_json")),
]


def test_parse_agent_response(spark):
    df = spark.createDataFrame([(s,) for s, _ in AGENT_CASES], "r string")
    got = [tuple(r) for r in responses.parse_agent_responses(df, "r")
           .select("reply", "decision", "reason", "error").collect()]
    assert got == [want for _, want in AGENT_CASES]


# Response text and (score, reason, error) expected from it.
JUDGE_CASES = [
    ('{"score": 4, "reason": "good"}', (4, "good", None)),
    ('```json\n{"score": 5, "reason": "fenced"}\n```', (5, "fenced", None)),
    ('Sure! Here it is: {"score": 3, "reason": "ok"} Hope this helps.', (3, "ok", None)),
    ('{"score": 0, "reason": "bad"}', (None, None, "score_out_of_range")),
    ('{"score": 6, "reason": "too high"}', (None, None, "score_out_of_range")),
    ('{"score": 4.7, "reason": "decimal"}', (4, "decimal", None)),
    ('{"score": "4", "reason": "text"}', (4, "text", None)),
    ('{"score": "4.7", "reason": "text decimal"}', (None, None, "invalid_score")),
    ("no braces at all", (None, None, "no_json")),
    ('{"reason": "no score"}', (None, None, "missing_score")),
    ('{"score": 2}', (None, None, "missing_reason")),
    ('{"score": 3, "reason": "multi\nline"}', (None, None, "invalid_json")),
    ('{"score": true, "reason": true}', (1, "True", None)),
    ('{"score": 2, "reason": 1.5}', (2, "1.5", None)),
    ('{"score": 2, "reason": ["x"]}', (None, None, "nested_field")),
]


def test_parse_judge_response(spark):
    df = spark.createDataFrame([(s,) for s, _ in JUDGE_CASES], "r string")
    got = [tuple(r) for r in responses.parse_judge_responses(df, "r")
           .select("score", "reason", "error").collect()]
    assert got == [want for _, want in JUDGE_CASES]


def test_calibration_file_and_agreement(spark):
    """Rows of 7 to 9 fields, one with a line break inside quotes."""
    cal = readers.read_calibration(spark, data_file("calibration.csv"))
    rows = {r.customer_text: r for r in cal.collect()}
    assert len(rows) == 6
    assert {t[:5]: r.human_score for t, r in rows.items()} == {
        "first": 5, "secon": 3, "third": 4, "fourt": 1, "fifth": None, "sixth": 2}
    assert rows["second message"].human_notes == "slow, but right, mostly"
    assert rows["third\nmessage"].llm_judge_score == 4
    a = judging.agreement(cal).first()  # |5-5| |3-4| |4-4| |1-5| and |2-3|
    assert a.n == 5
    assert abs(a.exact_agreement_pct - 40.0) < 1e-9
    assert abs(a.within_one_pct - 80.0) < 1e-9
    assert abs(a.mean_abs_diff - 1.2) < 1e-9
    assert abs(a.human_mean - 3.0) < 1e-9 and abs(a.judge_mean - 4.2) < 1e-9
    assert (a.human_min, a.human_max, a.judge_min, a.judge_max) == (1, 5, 3, 5)


def test_calibration_table_joins_by_request(spark):
    pairs = spark.createDataFrame([(7, "hi", "@u1 hello /AB"), (8, "yo", "ok")],
                                  "brand_tweet_id long, customer_text string, brand_text string")
    judged = spark.createDataFrame([(7, '{"score": 4, "reason": "x"}'), (9, "?")], "request_id long, response string")
    human = spark.createDataFrame([(7, "n/a"), (8, "3")], "request_id long, human_score string")
    rows = judging.calibration_table(pairs, judged, human).collect()
    assert [tuple(r) for r in rows] == [(7, "hi", "hello", 4, "x", None)]


def test_resolve_columns(spark):
    df = spark.createDataFrame([(1, "x", "y")], "id long, message string, label string")
    assert readers.resolve_column(df, readers.TEXT_CANDIDATES) == "message"
    assert readers.resolve_column(df, readers.LABEL_CANDIDATES) == "label"
