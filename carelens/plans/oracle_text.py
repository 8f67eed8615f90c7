"""Oracle SQL for vectors, retrieval, replies, prompts and judging."""

from __future__ import annotations

from carelens.functions import lexicon as lx
from carelens.functions import prompts as pr
from carelens.operators import classifier
from carelens.plans.oracle import BRAND, q, with_messages
from carelens.sources.adapter import TURNS
from carelens.plans.oracle_more import (MARGIN_CTES, REPORT, WS, clean_sql, decision_sql, label_sql, strip_sql,
                                        useful_sql)

TOKEN_RE = r"[\p{L}\p{N}_]{2,}"


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), {q(TOKEN_RE)})"


# Tokens then adjacent bigrams of a token column ``t`` (a column, so that the
# pattern runs once per document and not once per bigram).
GRAMS = "list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))"


def grams_from(docs: str, id_col: str, text_col: str) -> str:
    """Subquery (id, g) with the gram list of every document."""
    return f"(SELECT id, {GRAMS} AS g FROM (SELECT {id_col} AS id, {tokens_sql(text_col)} AS t FROM {docs}) k)"


def tfidf_ctes(prefix: str, docs: str, id_col: str, text_col: str) -> str:
    """CTEs {prefix}tf, {prefix}vocab, {prefix}w(id, term, weight)."""
    p = prefix
    return f"""
{p}tf AS (
  SELECT id, term, count(*) AS tf FROM (
    SELECT id, unnest(g) AS term FROM {grams_from(docs, id_col, text_col)} x) g
  GROUP BY id, term),
{p}n AS (SELECT count(*)::DOUBLE AS n FROM {docs}),
{p}vocab AS (
  SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf
  FROM (SELECT term, count(*) AS df FROM {p}tf GROUP BY term) d, {p}n
  WHERE df >= 2 AND df <= 0.95 * n),
{p}w AS (
  SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight
  FROM (SELECT id, term, (1 + ln(tf)) * idf AS raw FROM {p}tf JOIN {p}vocab USING (term)) r)"""


def fixed3_sql(x: str) -> str:
    v = f"CAST(round({x} * 1000) AS BIGINT)"
    return f"(CAST({v} // 1000 AS VARCHAR) || '.' || lpad(CAST({v} % 1000 AS VARCHAR), 3, '0'))"


def render_sql(template: str, **slots: str) -> str:
    out = []
    for kind, v in pr.template_parts(template):
        out.append(q(v) if kind == "lit" else f"coalesce({slots[v]}, NULL)")
    return "(" + " || ".join(out) + ")"


RETRIEVAL_CTE = f"""
hist AS (
  SELECT brand_tweet_id AS doc_id, customer_text AS text, {label_sql('customer_text')} AS intent,
         customer_tweet_id, brand_text
  FROM pairs WHERE brand = {q(BRAND)} AND customer_text IS NOT NULL AND brand_text IS NOT NULL),
qry AS (
  SELECT tweet_id AS qid, text, {label_sql('text')} AS intent FROM customers
  WHERE tweet_id NOT IN (SELECT customer_tweet_id FROM pairs WHERE brand = {q(BRAND)})),
qb AS (
  SELECT *, CASE WHEN intent IN (SELECT intent FROM hist) THEN intent ELSE '__all__' END AS block
  FROM qry),
{tfidf_ctes('h', 'hist', 'doc_id', 'text')},
qtf AS (
  SELECT id, term, count(*) AS tf FROM (
    SELECT id, unnest(g) AS term FROM {grams_from('qry', 'qid', 'text')} x) g
  GROUP BY id, term),
qw AS (
  SELECT id AS qid, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS wq
  FROM (SELECT id, term, (1 + ln(tf)) * idf AS raw FROM qtf JOIN hvocab USING (term)) r),
sc AS (
  SELECT qw.qid, hw.id AS doc_id, round(sum(qw.wq * hw.weight), 6) AS similarity
  FROM qw JOIN qb ON qb.qid = qw.qid
  JOIN hw ON hw.term = qw.term
  JOIN hist h ON h.doc_id = hw.id AND (qb.block = '__all__' OR h.intent = qb.block)
  GROUP BY qw.qid, hw.id),
hits AS (
  SELECT qid, doc_id, similarity FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, doc_id DESC) AS r FROM sc) t
  WHERE r <= 3),
pads AS (
  SELECT intent AS block, doc_id FROM (
    SELECT intent, doc_id, row_number() OVER (PARTITION BY intent ORDER BY doc_id DESC) AS r FROM hist) t
  WHERE r <= 3
  UNION ALL
  SELECT '__all__' AS block, doc_id FROM (SELECT doc_id FROM hist ORDER BY doc_id DESC LIMIT 3) a),
cands AS (
  SELECT qid, doc_id, max(similarity) AS similarity FROM (
    SELECT qid, doc_id, similarity FROM hits
    UNION ALL
    SELECT qb.qid, p.doc_id, 0.0 FROM qb JOIN pads p ON p.block = qb.block) u
  GROUP BY qid, doc_id),
top AS (
  SELECT t.qid, qb.block, CAST(t.rank AS INTEGER) AS rank, t.doc_id, t.similarity, h.intent, h.text,
         h.customer_tweet_id, h.brand_text
  FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, doc_id DESC) AS rank
        FROM cands) t
  JOIN hist h ON h.doc_id = t.doc_id JOIN qb ON qb.qid = t.qid
  WHERE t.rank <= 3),
cand AS (
  SELECT qid, rank, similarity, reply, {useful_sql('reply')} AS useful FROM (
    SELECT qid, rank, similarity, {clean_sql('brand_text')} AS reply FROM top) c
  WHERE length(reply) > 0),
best AS (
  SELECT qid, reply, useful, similarity, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY useful DESC, similarity DESC, rank ASC) AS r
    FROM cand) b WHERE r = 1),
bestq AS (
  SELECT qb.qid, coalesce(best.reply, {q(lx.FALLBACK_REPLY)}) AS best_reply, best.useful,
         best.similarity, best.rank AS source_rank, best.qid IS NULL AS used_fallback
  FROM qb LEFT JOIN best ON best.qid = qb.qid)"""

RESULT_COLS = "qid, block, rank, doc_id, similarity, intent, text, customer_tweet_id, brand_text"


def agent_response_sql() -> str:
    reply = clean_sql("brand_text")
    reason = "('Reply ' || CAST(brand_tweet_id AS VARCHAR))"

    def full(d: str) -> str:
        return f"CAST(json_object('reply', {reply}, 'decision', {q(d)}, 'reason', {reason}) AS VARCHAR)"
    return f"""
agent_resp AS (
  SELECT brand_tweet_id AS request_id, CASE brand_tweet_id % 6
    WHEN 0 THEN {full('AUTO-HANDLE')}
    WHEN 1 THEN '```json' || chr(10) || {full('ESCALATE')} || chr(10) || '```'
    WHEN 2 THEN CAST(json_object('reply', {reply}, 'decision', 'ESCALATE') AS VARCHAR)
    WHEN 3 THEN {full('MAYBE')}
    WHEN 4 THEN {full(' escalate ')}
    ELSE {reply} END AS response
  FROM pairs),
agent_t AS (
  SELECT request_id,
         regexp_replace(regexp_replace({strip_sql('response')}, {q('^(?i:```json)[' + WS + ']*')}, ''),
                        {q('[' + WS + ']*```$')}, '') AS t
  FROM agent_resp),
agent_p AS (
  SELECT request_id, t,
         coalesce(CASE WHEN json_valid(t) THEN json_type(CASE WHEN json_valid(t) THEN t END) END = 'OBJECT', FALSE)
           AND regexp_matches(t, '^\\{{(?s:.*)\\}}$') AS ok_json,
         CASE WHEN json_valid(t) THEN json_keys(CASE WHEN json_valid(t) THEN t END) END AS keys
  FROM agent_t),
agent_v AS (
  SELECT request_id, ok_json,
         list_contains(keys, 'reply') AND list_contains(keys, 'decision') AND list_contains(keys, 'reason')
           AS has_all,
         coalesce(json_extract_string(jt, '$.reply'), 'None') AS reply,
         upper({strip_sql("coalesce(json_extract_string(jt, '$.decision'), 'None')")}) AS decision,
         coalesce(json_extract_string(jt, '$.reason'), 'None') AS reason
  FROM (SELECT *, CASE WHEN ok_json THEN t END AS jt FROM agent_p) a),
agent_parsed AS (
  SELECT request_id,
         CASE WHEN NOT coalesce(ok_json, FALSE) THEN 'invalid_json'
              WHEN NOT coalesce(has_all, FALSE) THEN 'missing_fields'
              WHEN decision NOT IN ('AUTO-HANDLE', 'ESCALATE') THEN 'invalid_decision' END AS error,
         reply, decision, reason
  FROM agent_v)"""


def judge_response_sql() -> str:
    s = "CAST(brand_tweet_id % 5 + 1 AS VARCHAR)"
    return f"""
judge_resp AS (
  SELECT brand_tweet_id AS request_id, CASE brand_tweet_id % 7
    WHEN 0 THEN '{{"score": ' || {s} || ', "reason": "plain"}}'
    WHEN 1 THEN '```json' || chr(10) || '{{"score": ' || {s} || ', "reason": "fenced"}}' || chr(10) || '```'
    WHEN 2 THEN 'Here is my review: {{"score": ' || {s} || ', "reason": "prose"}} Thanks.'
    WHEN 3 THEN '{{"score": 0, "reason": "too low"}}'
    WHEN 4 THEN '{{"score": 4.7, "reason": "decimal"}}'
    WHEN 5 THEN '{{"score": "4", "reason": "text"}}'
    ELSE 'I cannot score this reply.' END AS response
  FROM pairs),
judge_t AS (
  SELECT request_id,
         coalesce(regexp_extract({strip_sql("regexp_replace(regexp_replace(response, '(?i)```json', '', 'g'), '```', '', 'g')")},
                                 '(?s)\\{{.*\\}}'), '') AS body
  FROM judge_resp),
judge_k AS (
  SELECT request_id, body, json_valid(body) AS ok,
         CASE WHEN json_valid(body) THEN json_keys(body) END AS keys,
         CASE WHEN json_valid(body) THEN json_type(body, '$.score') END AS kind,
         CASE WHEN json_valid(body) THEN json_extract_string(body, '$.score') END AS sv
  FROM judge_t),
judge_s AS (
  SELECT *, CASE
      WHEN kind = 'BOOLEAN' THEN CASE WHEN sv = 'true' THEN 1 ELSE 0 END
      WHEN kind = 'VARCHAR' THEN CASE WHEN regexp_matches(sv, {q('^[' + WS + ']*[+-]?[0-9]+[' + WS + ']*$')})
                                      THEN TRY_CAST(regexp_replace(sv, {q('[' + WS + '+]')}, '', 'g') AS BIGINT) END
      WHEN kind IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN TRY_CAST(trunc(TRY_CAST(sv AS DOUBLE)) AS BIGINT)
    END AS score
  FROM judge_k),
judge_parsed AS (
  SELECT request_id,
         CASE WHEN body = '' THEN 'no_json'
              WHEN NOT ok THEN 'invalid_json'
              WHEN NOT coalesce(list_contains(keys, 'score'), FALSE) THEN 'missing_score'
              WHEN score IS NULL THEN 'invalid_score'
              WHEN NOT coalesce(list_contains(keys, 'reason'), FALSE) THEN 'missing_reason'
              WHEN score < 1 OR score > 5 THEN 'score_out_of_range' END AS error,
         score,
         CASE WHEN json_valid(body) THEN coalesce(json_extract_string(body, '$.reason'), 'None') END AS reason
  FROM judge_s),
judge_ok AS (
  SELECT request_id, CASE WHEN error IS NULL THEN CAST(score AS INTEGER) END AS score,
         CASE WHEN error IS NULL THEN reason END AS reason, error
  FROM judge_parsed),
calib AS (
  SELECT p.brand_tweet_id AS request_id, p.customer_text, {clean_sql('p.brand_text')} AS generated_reply,
         j.score AS llm_judge_score, j.reason AS llm_judge_reason,
         TRY_CAST(CASE WHEN (p.customer_tweet_id // {TURNS}) % 9 = 0 THEN 'n/a'
                       ELSE CAST((p.customer_tweet_id // {TURNS}) % 5 + 1 AS VARCHAR) END AS INTEGER) AS human_score
  FROM pairs p JOIN judge_ok j ON j.request_id = p.brand_tweet_id)"""


def fit_ctes(p: str, train: str, whole: bool = False) -> str:
    """CTEs of the classifier's fit on ``train (id, text, intent)``: {p}lab, {p}vocab, {p}coef (term, c, w).

    ``whole``: on every row, not on those of the lowest id hash."""
    first = f" ORDER BY md5('42:' || CAST(id AS VARCHAR)), id LIMIT {classifier.MAX_TRAIN_ROWS}"
    ctes = [f"""
{p}train AS MATERIALIZED (
  SELECT id, text, intent FROM {train}{'' if whole else first}),
{tfidf_ctes(p, f'{p}train', 'id', 'text')},
{p}lab AS MATERIALIZED (
  SELECT intent AS label, row_number() OVER (ORDER BY intent) - 1 AS c, count(*)::DOUBLE AS n_c,
         (SELECT count(*) FROM {p}train)::DOUBLE AS total, (count(*) OVER ())::DOUBLE AS k
  FROM {p}train GROUP BY intent),
{p}x AS MATERIALIZED (
  SELECT id, term, weight AS x FROM {p}w UNION ALL SELECT id, '' AS term, 1.0::DOUBLE AS x FROM {p}train),
{p}y AS MATERIALIZED (
  SELECT t.id, l.c, CASE WHEN l.label = t.intent THEN 1.0 ELSE 0.0 END AS y, o.total / (o.k * o.n_c) AS wt, o.total
  FROM {p}train t JOIN {p}lab o ON o.label = t.intent CROSS JOIN {p}lab l),
{p}s0 AS MATERIALIZED (
  SELECT term, c, 0.0::DOUBLE AS w, 0.0::DOUBLE AS v FROM (SELECT DISTINCT term FROM {p}x) t CROSS JOIN {p}lab)"""]
    for s in range(classifier.STEPS):
        ahead = classifier.momentum(s)
        ctes.append(f"""
{p}e{s} AS MATERIALIZED (
  SELECT id, c, exp(z - max(z) OVER (PARTITION BY id)) AS e
  FROM (SELECT id, c, sum(x * v) AS z FROM {p}x JOIN {p}s{s} USING (term) GROUP BY id, c) z),
{p}g{s} AS MATERIALIZED (
  SELECT id, c, wt * (e / sum(e) OVER (PARTITION BY id) - y) / total AS g FROM {p}e{s} JOIN {p}y USING (id, c)),
{p}s{s + 1} AS MATERIALIZED (
  SELECT term, c, w1 AS w, w1 + {ahead!r}::DOUBLE * (w1 - w) AS v FROM (
    SELECT s.term, s.c, s.w,
      s.v - {classifier.RATE!r}::DOUBLE * (d.d + CASE WHEN s.term = '' THEN 0.0 ELSE 1.0 / (SELECT max(total) FROM {p}lab) END * s.v) AS w1
    FROM {p}s{s} s JOIN (SELECT term, c, sum(x * g) AS d FROM {p}x JOIN {p}g{s} USING (id) GROUP BY term, c) d
      ON d.term = s.term AND d.c = s.c) m)""")
    return ",".join([*ctes, f"\n{p}coef AS (SELECT term, c, w FROM {p}s{classifier.STEPS})"])


def predicted_ctes(p: str, model: str, docs: str) -> str:
    """CTE {p}pred (id, predicted_intent) of ``docs (id, text)`` under the model of :func:`fit_ctes`."""
    return f"""
{p}tf AS MATERIALIZED (
  SELECT id, term, count(*) AS tf FROM (
    SELECT id, unnest(g) AS term FROM {grams_from(docs, 'id', 'text')} x) g
  GROUP BY id, term),
{p}x AS MATERIALIZED (
  SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS x
  FROM (SELECT id, term, (1 + ln(tf)) * idf AS raw FROM {p}tf JOIN {model}vocab USING (term)) r),
{p}z AS (
  SELECT d.id, l.label, round(coalesce(z.z, 0) + b.w, 9) AS z
  FROM (SELECT id FROM {docs}) d CROSS JOIN {model}lab l JOIN {model}coef b ON b.term = '' AND b.c = l.c
  LEFT JOIN (SELECT id, c, sum(x * w) AS z FROM {p}x JOIN {model}coef USING (term) GROUP BY id, c) z
    ON z.id = d.id AND z.c = l.c),
{p}pred AS MATERIALIZED (
  SELECT id, label AS predicted_intent FROM (
    SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY z DESC, label) AS r FROM {p}z) t WHERE r = 1)"""


def model_sql(o: dict[str, str]) -> None:
    """Twins of the queries that fit the classifier."""
    hist = "hdoc AS (SELECT doc_id AS id, text, intent FROM hist), qdoc AS (SELECT qid AS id, text FROM qry)"
    fitted = f"{RETRIEVAL_CTE}, {hist}, {fit_ctes('m', 'hdoc')}"
    o["train_intent_model"] = with_messages(
        "SELECT h.doc_id, h.intent, p.predicted_intent FROM hist h JOIN tpred p ON p.id = h.doc_id",
        f"{fitted}, {predicted_ctes('t', 'm', 'hdoc')}")
    o["predict_intent"] = with_messages(
        "SELECT id AS qid, predicted_intent FROM tpred", f"{fitted}, {predicted_ctes('t', 'm', 'qdoc')}")
    # The golden rows are the first of the incoming messages by hash; none of them is in the history.
    golden = f"""{RETRIEVAL_CTE},
gold AS MATERIALIZED (SELECT qid AS id, text, intent FROM qry ORDER BY md5('42:' || CAST(qid AS VARCHAR)), qid LIMIT 200),
tdoc AS (SELECT doc_id AS id, text, intent FROM hist WHERE customer_tweet_id NOT IN (SELECT id FROM gold)),
{fit_ctes('m', 'tdoc')}, {predicted_ctes('t', 'm', 'gold')},
ev AS (SELECT g.id, g.text, g.intent AS actual, p.predicted_intent AS predicted FROM gold g JOIN tpred p USING (id))"""
    o["model_report"] = with_messages(REPORT, golden + ",\n" + MARGIN_CTES.strip().rstrip(","))
    got, want = decision_sql("predicted", "text"), decision_sql("actual", "text")
    o["model_handling"] = with_messages(f"""
SELECT id AS customer_tweet_id, actual, predicted, {got} AS decision, {want} AS expected_decision,
       ({want} = {q(lx.AUTO_HANDLE)} OR {got} = {q(lx.ESCALATE)}) AS safe
FROM ev""", golden)
    # The same retrieval with the model's intent in place of the rules'.
    asked = f"""{fit_ctes('m', 'hdoc', whole=True)}, {predicted_ctes('t', 'm', 'qdoc')},
aqry AS (SELECT r.qid, r.text, p.predicted_intent AS intent FROM qry r JOIN tpred p ON p.id = r.qid)"""
    head, tail = RETRIEVAL_CTE.split("qb AS (", 1)
    first = head + f"hdoc AS (SELECT doc_id AS id, text, intent FROM hist), qdoc AS (SELECT qid AS id, text FROM qry), {asked},\n"
    o["model_triage"] = with_messages(f"""
SELECT qb.qid, qb.intent, bestq.best_reply, bestq.used_fallback,
       {decision_sql('qb.intent', 'qb.text')} AS decision,
       {decision_sql('qb.intent', 'qb.text', 'reason')} AS reason
FROM qb JOIN bestq ON bestq.qid = qb.qid""", first + "qb AS (" + tail.replace("FROM qry)", "FROM aqry)"))


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    model_sql(o)
    o["ngrams"] = f"""
SELECT id AS doc_id, CAST(pos - 1 AS INTEGER) AS pos, term FROM (
  SELECT id, unnest(g) AS term, unnest(range(1, len(g) + 1)) AS pos
  FROM {grams_from('documents', 'doc_id', 'text')} x) y"""
    o["vocabulary"] = ("WITH " + tfidf_ctes("d", "documents", "doc_id", "text").strip()
                       + "\nSELECT term, df, round(idf, 6) AS idf FROM dvocab")
    o["tfidf_weights"] = ("WITH " + tfidf_ctes("d", "documents", "doc_id", "text").strip()
                          + "\nSELECT id AS doc_id, term, round(weight, 6) AS weight FROM dw")
    o["classifier_inputs"] = with_messages("""
SELECT h.doc_id, h.intent,
       round((SELECT count(*) FROM hist) / ((SELECT count(DISTINCT intent) FROM hist) * c.n_c), 6) AS class_weight,
       CAST(coalesce(w.n_terms, 0) AS BIGINT) AS n_terms, w.weight_sum, w.squares
FROM hist h JOIN (SELECT intent, count(*)::DOUBLE AS n_c FROM hist GROUP BY intent) c ON c.intent = h.intent
LEFT JOIN (SELECT id, count(*) AS n_terms, round(sum(weight), 6) AS weight_sum, round(sum(weight * weight), 6) AS squares
           FROM hw GROUP BY id) w ON w.id = h.doc_id""", RETRIEVAL_CTE)
    o["retrieve_topk"] = with_messages(f"SELECT {RESULT_COLS} FROM top", RETRIEVAL_CTE)
    o["retrieve_fallback"] = with_messages(
        f"SELECT {RESULT_COLS} FROM top WHERE block = '__all__'", RETRIEVAL_CTE)
    o["best_reply"] = with_messages(
        "SELECT qid, best_reply, useful, similarity, source_rank, used_fallback FROM bestq", RETRIEVAL_CTE)
    example = render_sql(pr.EXAMPLE_TEMPLATE, rank="CAST(rank AS VARCHAR)", customer_text="text",
                         reply=clean_sql("brand_text"), similarity=fixed3_sql("similarity"))
    prompt = render_sql(pr.GROUNDED_PROMPT, customer_text="qb.text", intent="qb.intent",
                        examples="coalesce(ex.examples, '')")
    o["build_prompts"] = with_messages(f"""
SELECT qb.qid, qb.intent, {prompt} AS prompt
FROM qb LEFT JOIN (
  SELECT qid, string_agg(example, chr(10) ORDER BY rank) AS examples
  FROM (SELECT qid, rank, {example} AS example FROM top) e GROUP BY qid) ex ON ex.qid = qb.qid""",
        RETRIEVAL_CTE)
    o["triage"] = with_messages(f"""
SELECT qb.qid, qb.intent, bestq.best_reply, bestq.used_fallback,
       {decision_sql('qb.intent', 'qb.text')} AS decision,
       {decision_sql('qb.intent', 'qb.text', 'reason')} AS reason
FROM qb JOIN bestq ON bestq.qid = qb.qid""", RETRIEVAL_CTE)
    o["reply_prompts"] = with_messages(
        f"SELECT tweet_id AS customer_tweet_id, {render_sql(pr.REPLY_PROMPT, customer_text='text')} AS prompt "
        "FROM customers")
    judge = render_sql(pr.JUDGE_PROMPT, customer_text="customer_text", reply=clean_sql("brand_text"),
                       rubric=q(pr.rubric_text()))
    o["judge_prompts"] = with_messages(f"SELECT brand_tweet_id, {judge} AS prompt FROM pairs")
    o["parse_agent_responses"] = with_messages("""
SELECT request_id,
       CASE WHEN error IS NULL THEN {0} END AS reply,
       CASE WHEN error IS NULL THEN decision END AS decision,
       CASE WHEN error IS NULL THEN {1} END AS reason, error
FROM agent_parsed""".format(strip_sql("reply"), strip_sql("reason")), agent_response_sql())
    o["parse_judge_responses"] = with_messages(
        "SELECT request_id, score, reason, error FROM judge_ok", judge_response_sql())
    o["judge_agreement"] = with_messages("""
SELECT CAST(count(*) AS BIGINT) AS n,
       round(avg(CASE WHEN human_score = llm_judge_score THEN 1.0 ELSE 0.0 END) * 100.0, 6) AS exact_agreement_pct,
       round(avg(CASE WHEN abs(human_score - llm_judge_score) <= 1 THEN 1.0 ELSE 0.0 END) * 100.0, 6)
         AS within_one_pct,
       round(avg(abs(human_score - llm_judge_score)), 6) AS mean_abs_diff,
       round(avg(human_score), 6) AS human_mean, round(avg(llm_judge_score), 6) AS judge_mean,
       min(human_score) AS human_min, max(human_score) AS human_max,
       min(llm_judge_score) AS judge_min, max(llm_judge_score) AS judge_max,
       round(avg(llm_judge_score - human_score), 6) AS mean_judge_minus_human
FROM calib WHERE human_score IS NOT NULL AND llm_judge_score IS NOT NULL""", judge_response_sql())
    from carelens.plans.oracle_more import PAIR_STR_COLS, SAMPLE_CTE
    o["judge_pending"] = with_messages(f"""
SELECT {PAIR_STR_COLS} FROM (
  SELECT * FROM gs ORDER BY md5('42:' || CAST(brand_tweet_id AS VARCHAR)), brand_tweet_id LIMIT 8) s
WHERE brand_tweet_id NOT IN (SELECT request_id FROM calib WHERE llm_judge_score IS NOT NULL)""",
        SAMPLE_CTE + "," + judge_response_sql())
    o["judge_merge"] = with_messages("""
SELECT *, CASE WHEN request_id % 2 = 0 THEN 'existing' ELSE 'new' END AS batch
FROM calib WHERE llm_judge_score IS NOT NULL""", judge_response_sql())
    return o
