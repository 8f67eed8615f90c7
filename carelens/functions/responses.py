"""Validation of language-model response tables.

Responses are parsed JVM-side with the VARIANT functions; instead of
raising on the first bad row, every row gets an ``error`` code and the
caller splits good rows from quarantined ones. A field that holds an object
or an array has no agreed text form and is refused (``nested_field``); of a
repeated key, and of numbers JSON does not have (``NaN``), the parser makes
``invalid_json``. These two are this engine's own choices.

Parsing is written as a few ``withColumns`` steps (stripped text, JSON
body, parsed variant, ...). Each step is referenced several times by the
next; as separate projections Catalyst keeps them computed once instead
of inlining one large expression into every use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.functions import lexicon as lx
from carelens.functions.text import WS, py_strip

REQUIRED_AGENT_FIELDS = ["reply", "decision", "reason"]


def _kind(v, path: str):
    return F.coalesce(F.schema_of_variant(F.variant_get(v, path, "variant")), F.lit("VOID"))


def _nested(v, path: str):
    """Whether the value is an object or an array: such fields have no text form here."""
    return _kind(v, path).startswith("OBJECT") | _kind(v, path).startswith("ARRAY")


def _py_str(v, path: str):
    """Text of a JSON scalar: strings as they are, ``None`` for null, ``True`` and
    ``False``, whole numbers plainly, other numbers as doubles (``1.0``)."""
    kind = _kind(v, path)
    text = F.try_variant_get(v, path, "string")
    return (F.when(F.is_variant_null(F.variant_get(v, path, "variant")), F.lit("None"))
            .when(kind == "BOOLEAN", F.initcap(text))
            .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"),
                  F.try_variant_get(v, path, "double").cast("string"))
            .otherwise(text))


def parse_agent_responses(df: DataFrame, col: str = "response") -> DataFrame:
    """Adds reply, decision, reason, error (values NULL when error)."""
    t = F.regexp_replace(py_strip(F.col(col)), f"(?i)^```json[{WS}]*", "")
    t = F.regexp_replace(t, f"[{WS}]*```$", "")
    s1 = df.withColumn("_t", t)
    s2 = s1.withColumns({
        "_pv": F.try_parse_json(F.col("_t")),
        "_keys": F.json_object_keys(F.col("_t")),
    })
    s2 = s2.withColumn("_v", F.when(F.schema_of_variant(F.col("_pv")).startswith("OBJECT")
                                    & F.col("_t").rlike(r"^\{[\s\S]*\}$"), F.col("_pv")))
    missing = None
    for f in REQUIRED_AGENT_FIELDS:
        m = ~F.coalesce(F.array_contains(F.col("_keys"), F.lit(f)), F.lit(False))
        missing = m if missing is None else (missing | m)
    s3 = s2.withColumns({
        "_decision": F.upper(py_strip(_py_str(F.col("_v"), "$.decision"))),
        "_missing": missing,
        "_nested": _nested(F.col("_v"), "$.reply") | _nested(F.col("_v"), "$.decision") | _nested(F.col("_v"), "$.reason"),
    })
    error = (F.when(F.col("_v").isNull(), F.lit("invalid_json"))
             .when(F.col("_missing"), F.lit("missing_fields"))
             .when(F.col("_nested"), F.lit("nested_field"))
             .when(~F.col("_decision").isin(lx.AUTO_HANDLE, lx.ESCALATE), F.lit("invalid_decision")))
    s4 = s3.withColumn("error", error)
    ok = F.col("error").isNull()
    return s4.withColumns({
        "reply": F.when(ok, py_strip(_py_str(F.col("_v"), "$.reply"))),
        "decision": F.when(ok, F.col("_decision")),
        "reason": F.when(ok, py_strip(_py_str(F.col("_v"), "$.reason"))),
    }).drop("_t", "_pv", "_v", "_keys", "_decision", "_missing", "_nested")


def parse_judge_responses(df: DataFrame, col: str = "response") -> DataFrame:
    """Adds score (INT), reason, error (values NULL when error)."""
    t = F.regexp_replace(F.col(col), "(?i)```json", "")
    t = py_strip(F.regexp_replace(t, "```", ""))
    s1 = df.withColumn("_body", F.regexp_extract(t, r"(?s)\{.*\}", 0))
    s2 = s1.withColumns({
        "_v": F.try_parse_json(F.when(F.col("_body") != "", F.col("_body"))),
        "_keys": F.json_object_keys(F.col("_body")),
    })
    s3 = s2.withColumns({
        "_kind": F.schema_of_variant(F.variant_get(F.col("_v"), "$.score", "variant")),
        "_num": F.try_variant_get(F.col("_v"), "$.score", "double"),
        "_txt": F.try_variant_get(F.col("_v"), "$.score", "string"),
        "_bool": F.try_variant_get(F.col("_v"), "$.score", "boolean"),
    })
    kind = F.col("_kind")
    score = (F.when(kind == "BOOLEAN", F.when(F.col("_bool"), 1).otherwise(0))
             .when(kind == "STRING",
                   F.when(F.col("_txt").rlike(f"^[{WS}]*[+-]?[0-9]+[{WS}]*$"),
                          F.regexp_replace(F.col("_txt"), f"[{WS}+]", "").try_cast("bigint")))
             .when(kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT"),
                   F.col("_num").try_cast("bigint")))
    s4 = s3.withColumn("_score", score)

    def has(k):
        return F.coalesce(F.array_contains(F.col("_keys"), F.lit(k)), F.lit(False))
    error = (F.when(F.col("_body") == "", F.lit("no_json"))
             .when(F.col("_v").isNull(), F.lit("invalid_json"))
             .when(~has("score"), F.lit("missing_score"))
             .when(F.col("_score").isNull(), F.lit("invalid_score"))
             .when(~has("reason"), F.lit("missing_reason"))
             .when(_nested(F.col("_v"), "$.reason"), F.lit("nested_field"))
             .when((F.col("_score") < 1) | (F.col("_score") > 5), F.lit("score_out_of_range")))
    s5 = s4.withColumn("error", error)
    ok = F.col("error").isNull()
    return s5.withColumns({
        "score": F.when(ok, F.col("_score").cast("int")),
        "reason": F.when(ok, _py_str(F.col("_v"), "$.reason")),
    }).drop("_body", "_v", "_keys", "_kind", "_num", "_txt", "_bool", "_score")
