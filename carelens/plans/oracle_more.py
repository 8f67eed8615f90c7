"""Oracle SQL for the lexicon, policy, evaluation and sampling queries.

The rule lists are rendered into SQL from the same fixed-value tables the
Spark builders use; the SQL form (CASE over ``contains``) is written out
independently here.
"""

from __future__ import annotations

from carelens.functions import lexicon as lx
from carelens.plans.oracle import BRAND, q, sql_list, with_messages

# Python's whitespace and word classes for RE2 (DuckDB). RE2 has no
# lookahead, so "initials not followed by a word character" captures the
# next character and writes it back.
WS = (r"\t\n\x{0B}\f\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WORD = r"\p{L}\p{N}_"


def contains_any_sql(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in phrases) + ")"


def label_sql(col: str, rules=lx.INTENT_RULES, default: str = lx.OTHER) -> str:
    low = f"lower({col})"
    whens = " ".join(f"WHEN {contains_any_sql(low, ph)} THEN {q(lab)}" for lab, ph in rules)
    return f"(CASE {whens} ELSE {q(default)} END)"


def rule_index_sql(col: str, rules=lx.INTENT_RULES) -> str:
    low = f"lower({col})"
    whens = " ".join(f"WHEN {contains_any_sql(low, ph)} THEN {i}"
                     for i, (_, ph) in enumerate(rules, start=1))
    return f"(CASE {whens} ELSE 0 END)"


def clean_sql(x: str) -> str:
    s = f"regexp_replace({x}, {q('https?://[^' + WS + ']+')}, '', 'g')"
    s = f"regexp_replace({s}, {q('@[' + WORD + ']+')}, '', 'g')"
    s = f"regexp_replace({s}, {q('[' + WS + ']*/[A-Z]{2}([^' + WORD + ']|$)')}, '\\1', 'g')"
    s = f"regexp_replace({s}, {q('[' + WS + ']+')}, ' ', 'g')"
    return f"trim({s})"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {q('^[' + WS + ']+|[' + WS + ']+$')}, '', 'g')"


def useful_sql(x: str) -> str:
    low = f"lower({x})"
    return (f"coalesce(NOT {contains_any_sql(low, lx.VAGUE_REPLY_PATTERNS)} "
            f"AND {contains_any_sql(low, lx.USEFUL_REPLY_PATTERNS)}, FALSE)")


def decision_sql(intent: str, text: str, field: str = "decision") -> str:
    low = f"lower({text})"
    vals = {
        "decision": (lx.ESCALATE, lx.ESCALATE, lx.AUTO_HANDLE),
        "reason": (lx.REASON_INTENT, lx.REASON_PATTERN, lx.REASON_DEFAULT),
        "basis": ("intent", "pattern", "default"),
    }[field]
    return (f"(CASE WHEN {intent} IN ({sql_list(lx.ESCALATION_INTENTS)}) THEN {q(vals[0])} "
            f"WHEN {contains_any_sql(low, lx.SENSITIVE_PATTERNS)} THEN {q(vals[1])} "
            f"ELSE {q(vals[2])} END)")


# Per-label counts and rates of ``ev (actual, predicted)``.
MARGIN_CTES = """
marg AS (
  SELECT coalesce(s.label, p.label) AS label,
         coalesce(s.support, 0) AS support, coalesce(p.pc, 0) AS predicted_count,
         coalesce(t.tp, 0) AS tp
  FROM (SELECT actual AS label, count(*) AS support FROM ev GROUP BY actual) s
  FULL OUTER JOIN (SELECT predicted AS label, count(*) AS pc FROM ev GROUP BY predicted) p
    ON s.label = p.label
  LEFT JOIN (SELECT actual AS label, count(*) AS tp FROM ev
             WHERE actual IS NOT DISTINCT FROM predicted GROUP BY actual) t
    ON t.label = coalesce(s.label, p.label)
),
m2 AS (
  SELECT *, coalesce(tp::DOUBLE / nullif(predicted_count, 0), 0.0) AS precision,
         coalesce(tp::DOUBLE / nullif(support, 0), 0.0) AS recall,
         coalesce(2.0 * tp / nullif(predicted_count + support, 0), 0.0) AS f1
  FROM marg
),
"""

INTENT_EVAL_CTE = f"""
intent_eval AS (
  SELECT tweet_id AS customer_tweet_id, text AS customer_text,
         {label_sql('text')} AS intent,
         {label_sql('text', lx.KEYWORD_BASELINE_RULES)} AS predicted_intent
  FROM customers
),
ev AS (SELECT intent AS actual, predicted_intent AS predicted FROM intent_eval),
{MARGIN_CTES}dec AS (
  SELECT customer_tweet_id, predicted_intent,
         {decision_sql('predicted_intent', 'customer_text')} AS decision,
         {decision_sql('predicted_intent', 'customer_text', 'reason')} AS reason,
         {decision_sql('predicted_intent', 'customer_text', 'basis')} AS basis,
         {decision_sql('intent', 'customer_text')} AS expected_decision
  FROM intent_eval
),
consistency AS (
  SELECT CAST(count_if(expected_decision = decision) AS BIGINT) AS passed,
         CAST(count(*) AS BIGINT) AS total,
         round(coalesce(count_if(expected_decision = decision) * 100.0 / nullif(count(*), 0), 0.0), 6)
           AS safety_score
  FROM dec
),
labelled AS (SELECT doc_id, text, quality, toxic FROM documents JOIN labels USING (doc_id)),
cases AS (
  SELECT CASE WHEN toxic = 1 THEN {q(lx.ESCALATE)} ELSE {q(lx.AUTO_HANDLE)} END AS expected_decision,
         {decision_sql(label_sql('text'), 'text')} AS decision
  FROM labelled
),
safety AS (
  SELECT CAST(count_if(expected_decision = decision) AS BIGINT) AS passed,
         CAST(count(*) AS BIGINT) AS total,
         round(coalesce(count_if(expected_decision = decision) * 100.0 / nullif(count(*), 0), 0.0), 6)
           AS safety_score
  FROM cases
)
"""

F1_SELECT = """
SELECT CAST(coalesce(sum(support), 0) AS BIGINT) AS total, CAST(coalesce(sum(tp), 0) AS BIGINT) AS correct,
       round(coalesce(sum(tp)::DOUBLE / nullif(sum(support), 0), 0.0), 6) AS accuracy,
       round(coalesce(avg(f1), 0.0), 6) AS macro_f1,
       round(coalesce(sum(f1 * support) / nullif(sum(support), 0), 0.0), 6) AS weighted_f1
FROM m2"""

SAMPLE_CTE = f"""
sp AS (SELECT * EXCLUDE (brand) FROM pairs WHERE brand = {q(BRAND)}),
fp AS (SELECT * FROM sp ORDER BY brand_tweet_id LIMIT 1000),
gs AS (SELECT * FROM fp ORDER BY md5('42:' || CAST(brand_tweet_id AS VARCHAR)), brand_tweet_id LIMIT 200),
ts AS (SELECT * FROM sp ORDER BY md5('42:' || CAST(brand_tweet_id AS VARCHAR)), brand_tweet_id LIMIT 5000)"""

PAIR_STR_COLS = """CAST(customer_tweet_id AS VARCHAR) AS customer_tweet_id, customer_id, customer_text,
       customer_created_at, CAST(brand_tweet_id AS VARCHAR) AS brand_tweet_id,
       CAST(parent_tweet_id AS VARCHAR) AS parent_tweet_id, brand_text, brand_created_at"""


REPORT = """
SELECT label AS row_label, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1_score, CAST(support AS BIGINT) AS support, 0 AS section FROM m2
UNION ALL
SELECT 'accuracy', NULL, NULL, round(coalesce(sum(tp)::DOUBLE / nullif(sum(support), 0), 0.0), 6),
       CAST(sum(support) AS BIGINT), 1 FROM m2
UNION ALL
SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       CAST(sum(support) AS BIGINT), 2 FROM m2
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / nullif(sum(support), 0), 6),
       round(sum(recall * support) / nullif(sum(support), 0), 6),
       round(sum(f1 * support) / nullif(sum(support), 0), 6), CAST(sum(support) AS BIGINT), 3 FROM m2"""


CONFUSION = """
SELECT a.l AS actual, p.l AS predicted, CAST(count(e.actual) AS BIGINT) AS n
FROM (SELECT DISTINCT actual AS l FROM ev) a
CROSS JOIN (SELECT DISTINCT actual AS l FROM ev) p
LEFT JOIN ev e ON e.actual = a.l AND e.predicted = p.l
GROUP BY a.l, p.l"""

# The weak rules and the policy beside stored labels, as ``ev``.
RULE_CASES = f"""
WITH ev AS (
  SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS actual,
         CASE WHEN {label_sql('text')} <> {q(lx.OTHER)} THEN 'good' ELSE 'poor' END AS predicted
  FROM documents JOIN labels USING (doc_id))"""


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    E = INTENT_EVAL_CTE

    o["weak_label"] = with_messages(f"""
SELECT brand_tweet_id, customer_tweet_id, customer_text,
       {label_sql('customer_text')} AS intent, {rule_index_sql('customer_text')} AS rule_priority
FROM pairs""")
    o["label_distribution"] = with_messages(f"""
SELECT {label_sql('customer_text')} AS intent, CAST(count(*) AS BIGINT) AS n FROM pairs GROUP BY 1""")
    o["keyword_baseline"] = with_messages(
        "SELECT customer_tweet_id, customer_text, predicted_intent FROM intent_eval", E)
    o["clean_reply"] = with_messages(
        f"SELECT brand_tweet_id, brand_text, {clean_sql('brand_text')} AS clean_text FROM replies")
    o["useful_reply"] = with_messages(f"""
SELECT brand_tweet_id, clean_text, {useful_sql('clean_text')} AS useful
FROM (SELECT brand_tweet_id, {clean_sql('brand_text')} AS clean_text FROM replies) r""")
    o["handling_decision"] = with_messages(
        "SELECT customer_tweet_id, predicted_intent, decision, reason, basis FROM dec", E)
    o["handling_counts"] = with_messages("""
SELECT CAST(count_if(decision = 'AUTO-HANDLE') AS BIGINT) AS auto_handle,
       CAST(count_if(decision = 'ESCALATE') AS BIGINT) AS escalate,
       CAST(count(*) AS BIGINT) AS total,
       CAST(count_if(basis = 'intent') AS BIGINT) AS escalate_by_intent,
       CAST(count_if(basis = 'pattern') AS BIGINT) AS escalate_by_pattern
FROM dec""", E)
    o["safety_score"] = with_messages("SELECT passed, total, safety_score FROM safety", E)
    o["policy_consistency"] = with_messages("SELECT passed, total, safety_score FROM consistency", E)
    o["safety_confusion"] = with_messages(
        CONFUSION.replace(" ev", " sc"), E + ", sc AS (SELECT expected_decision AS actual, decision AS predicted FROM cases)")
    o["weak_label_quality"] = RULE_CASES + ",\n" + MARGIN_CTES.strip().rstrip(",") + REPORT
    o["weak_label_confusion"] = RULE_CASES + CONFUSION
    o["trust_gate"] = with_messages("""
SELECT (SELECT round(round(coalesce(count_if(actual IS NOT DISTINCT FROM predicted)::DOUBLE
                                    / nullif(count(*), 0), 0.0), 6) * 100.0, 6) FROM ev) AS intent_accuracy_pct,
       safety_score AS safety_score_pct,
       CASE WHEN safety_score >= 85 THEN 'PASS' ELSE 'NEEDS IMPROVEMENT' END AS safety_assessment
FROM safety""", E)

    o["prediction_table"] = with_messages("""
SELECT customer_tweet_id, customer_text, intent, predicted_intent,
       intent IS NOT DISTINCT FROM predicted_intent AS correct FROM intent_eval""", E)
    o["intent_accuracy"] = with_messages("""
SELECT CAST(count(*) AS BIGINT) AS total,
       CAST(count_if(actual IS NOT DISTINCT FROM predicted) AS BIGINT) AS correct,
       round(coalesce(count_if(actual IS NOT DISTINCT FROM predicted)::DOUBLE / nullif(count(*), 0), 0.0), 6)
         AS accuracy
FROM ev""", E)
    o["intent_f1"] = with_messages(F1_SELECT, E)
    o["classification_report"] = with_messages(REPORT, E)
    o["confusion_matrix"] = with_messages(CONFUSION, E)
    o["confusion_pairs"] = with_messages("""
SELECT actual, predicted, CAST(count(*) AS BIGINT) AS n FROM ev
WHERE actual IS DISTINCT FROM predicted
GROUP BY actual, predicted ORDER BY n DESC, actual, predicted LIMIT 10""", E)
    o["misclassified"] = with_messages("""
SELECT customer_tweet_id, customer_text, intent, predicted_intent FROM intent_eval
WHERE intent IS DISTINCT FROM predicted_intent""", E)
    o["majority_baseline"] = with_messages(f"""
SELECT maj.majority_label, t.* FROM
  (SELECT actual AS majority_label FROM ev GROUP BY actual ORDER BY count(*) DESC, actual LIMIT 1) maj,
  ({F1_SELECT.replace('FROM m2', 'FROM mb2')}) t""",
        E + """,
mbev AS (SELECT actual, (SELECT actual FROM ev GROUP BY actual ORDER BY count(*) DESC, actual LIMIT 1)
                 AS predicted FROM ev),
mb AS (
  SELECT coalesce(s.label, p.label) AS label, coalesce(s.support, 0) AS support,
         coalesce(p.pc, 0) AS predicted_count, coalesce(t.tp, 0) AS tp
  FROM (SELECT actual AS label, count(*) AS support FROM mbev GROUP BY actual) s
  FULL OUTER JOIN (SELECT predicted AS label, count(*) AS pc FROM mbev GROUP BY predicted) p
    ON s.label = p.label
  LEFT JOIN (SELECT actual AS label, count(*) AS tp FROM mbev WHERE actual = predicted GROUP BY actual) t
    ON t.label = coalesce(s.label, p.label)),
mb2 AS (SELECT *, coalesce(2.0 * tp / nullif(predicted_count + support, 0), 0.0) AS f1 FROM mb)""")

    o["resolve_columns"] = "SELECT item_id, text AS customer_text FROM benchmark"
    o["load_history"] = with_messages(f"""
SELECT brand, CAST(customer_tweet_id AS VARCHAR) AS customer_tweet_id, customer_id,
       {strip_sql('customer_text')} AS customer_text, customer_created_at,
       CAST(brand_tweet_id AS VARCHAR) AS brand_tweet_id, CAST(parent_tweet_id AS VARCHAR) AS parent_tweet_id,
       {strip_sql('brand_text')} AS brand_text, brand_created_at
FROM pairs WHERE customer_text IS NOT NULL AND brand_text IS NOT NULL""")
    pred = """
pred AS (
  SELECT customer_tweet_id, predicted_intent AS predicted, 0 AS batch FROM intent_eval WHERE customer_tweet_id % 7 <> 0
  UNION ALL
  SELECT customer_tweet_id, {0} AS predicted, 1 AS batch FROM intent_eval
  WHERE customer_tweet_id % 7 <> 0 AND customer_tweet_id % 5 = 0
  UNION ALL
  SELECT -customer_tweet_id - 1, predicted_intent, 0 FROM intent_eval WHERE customer_tweet_id % 7 = 0),
lastp AS (
  SELECT customer_tweet_id, predicted FROM (
    SELECT *, row_number() OVER (PARTITION BY customer_tweet_id ORDER BY batch DESC, predicted DESC) AS r FROM pred) t
  WHERE r = 1),
aligned AS (
  SELECT coalesce(e.customer_tweet_id, p.customer_tweet_id) AS customer_tweet_id, e.intent AS actual, p.predicted,
         CASE WHEN p.customer_tweet_id IS NULL THEN 'missing_prediction'
              WHEN e.customer_tweet_id IS NULL THEN 'extra_prediction' ELSE 'matched' END AS status
  FROM intent_eval e FULL OUTER JOIN lastp p ON e.customer_tweet_id = p.customer_tweet_id)""".format(q(lx.OTHER))
    o["aligned_predictions"] = with_messages(
        "SELECT customer_tweet_id, actual, predicted, status FROM aligned", E + "," + pred)
    o["aligned_accuracy"] = with_messages("""
SELECT CAST(count(*) AS BIGINT) AS total,
       CAST(count_if(actual IS NOT DISTINCT FROM predicted) AS BIGINT) AS correct,
       round(coalesce(count_if(actual IS NOT DISTINCT FROM predicted)::DOUBLE / nullif(count(*), 0), 0.0), 6)
         AS accuracy
FROM aligned WHERE status <> 'extra_prediction'""", E + "," + pred)
    cols = "o_orderkey, o_custkey, o_orderstatus"
    by_hash = "md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey"
    first = f"SELECT {cols} FROM orders ORDER BY o_orderkey LIMIT 1000"
    golden = f"SELECT * FROM ({first}) f ORDER BY {by_hash} LIMIT 200"
    training = f"SELECT {cols} FROM orders ORDER BY {by_hash.replace('42:', '43:')} LIMIT 5000"
    o["first_orders"] = first
    o["sample_golden_orders"] = golden
    o["training_orders_without_golden"] = (
        f"SELECT * FROM ({training}) t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({golden}) g)")
    o["leakage_orders"] = (
        "SELECT CAST(count(*) AS BIGINT) AS training_rows, "
        f"CAST(count_if(o_orderkey IN (SELECT o_orderkey FROM ({golden}) g)) AS BIGINT) AS overlapping_rows "
        f"FROM ({training}) t")
    o["sample_golden"] = with_messages(f"SELECT {PAIR_STR_COLS} FROM gs", SAMPLE_CTE)
    o["golden_template"] = with_messages(
        "SELECT customer_tweet_id, customer_text, '' AS intent FROM gs", SAMPLE_CTE)
    o["sample_training"] = with_messages(f"SELECT {PAIR_STR_COLS} FROM ts", SAMPLE_CTE)
    o["training_without_golden"] = with_messages(f"""
SELECT {PAIR_STR_COLS} FROM ts WHERE customer_tweet_id NOT IN (SELECT customer_tweet_id FROM gs)""",
        SAMPLE_CTE)
    o["leakage_check"] = with_messages("""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM gs) AS golden_rows,
       CAST(count(*) AS BIGINT) AS training_rows,
       CAST(count_if(customer_tweet_id IN (SELECT customer_tweet_id FROM gs)) AS BIGINT) AS overlapping_rows,
       CAST(count(DISTINCT CASE WHEN customer_tweet_id IN (SELECT customer_tweet_id FROM gs)
                                THEN customer_tweet_id END) AS BIGINT) AS overlapping_ids
FROM ts""", SAMPLE_CTE)

    from carelens.plans import oracle_text
    o.update(oracle_text.oracle_sql())
    return o
