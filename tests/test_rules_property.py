"""Property test: the compiled CASE/contains labeller and policy agree
with a plain-Python statement of the rules on generated texts."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carelens.functions import lexicon as lx
from carelens.functions import policy

FRAGMENTS = sorted({p for _, ph in lx.INTENT_RULES for p in ph}
                   | set(lx.SENSITIVE_PATTERNS) | {"happy", "most", "curiosity", "ADMIN", "Éva"})


def py_label(text, rules=lx.INTENT_RULES, default=lx.OTHER):
    t = text.lower()
    for label, phrases in rules:
        if any(p in t for p in phrases):
            return label
    return default


def py_decision(intent, text):
    if intent in lx.ESCALATION_INTENTS:
        return lx.ESCALATE
    if any(p in text.lower() for p in lx.SENSITIVE_PATTERNS):
        return lx.ESCALATE
    return lx.AUTO_HANDLE


texts = st.lists(st.one_of(st.sampled_from(FRAGMENTS), st.text(max_size=6)), max_size=6).map(" ".join)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(texts, min_size=50, max_size=50))
def test_rules_match_plain_python(spark, batch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, t string")
    intent = lx.label_column(F.col("t"))
    rows = df.select("i", "t", intent.alias("a"),
                     lx.label_column(F.col("t"), lx.KEYWORD_BASELINE_RULES).alias("b"),
                     policy.handling(intent, F.col("t")).decision.alias("d")).collect()
    for r in rows:
        assert r.a == py_label(r.t)
        assert r.b == py_label(r.t, lx.KEYWORD_BASELINE_RULES)
        assert r.d == py_decision(r.a, r.t)


PIECES = ["@SpotifyCares", "@Éva_1", "@u12", "https://t.co/ab", "http://x.y/z?q=1", " /LM", "/AU",
          "/ABC", "/lm", "/XYé", "/XY1", "/XY_", "é/AB", " ", " ", "\n", "\t", "  ", "ü", "ß",
          "😭", "a", "Z9", "_", "/", "@", " ", "x　y"]
replies = st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=4)), max_size=10).map("".join)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(replies, min_size=60, max_size=60))
def test_cleaned_replies_hold_nothing_to_clean(spark, batch):
    """Invariants: no URL, no handle, no outer or double space; cleaning twice changes nothing more
    unless the first pass brought new parts together."""
    import re

    from carelens.functions import text as tx
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, t string")
    once = df.select("t", tx.clean_reply(F.col("t")).alias("c"))
    for r in once.collect():
        assert "http://" not in r.c or not re.search(r"http://\S", r.c), repr(r.t)
        assert re.search(r"\s\s", r.c) is None and r.c == r.c.strip(), repr(r.t)
        assert re.search(r"[^\S ]", r.c) is None, repr(r.t)
        assert len(r.c) <= len(r.t), repr(r.t)
    plain = df.where(~F.col("t").rlike("[@/]")).select(
        tx.clean_reply(F.col("t")).alias("c"), tx.clean_reply(tx.clean_reply(F.col("t"))).alias("cc"))
    assert all(r.c == r.cc for r in plain.collect())
