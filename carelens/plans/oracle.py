"""DuckDB SQL twins of the registered queries (the correctness oracle).

The driver pre-registers the parquet tables as views. Each entry is
plain SQL over them; the shared CTEs below restate the message-log
adapter and the pairing in SQL so every oracle starts from the given
tables, exactly like its Spark query.
"""

from __future__ import annotations

from carelens.sources.adapter import (TURNS, AGENT_INITIALS, ASSISTANT_CLOSERS, BRAND,
                                      BRANDS, USER_SENTENCES)


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return ", ".join(q(v) for v in values)


def pick(values: list[str], index_sql: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values))
    return f"(CASE {index_sql} {whens} END)"


BRANDS_SQL = sql_list(BRANDS)

MESSAGES_CTE = f"""
base AS (
  SELECT c.conv_id, c.turn, c.role,
         c.conv_id * {TURNS} + c.turn AS tweet_id,
         CASE WHEN c.role = 'user' THEN TRUE WHEN c.role = 'assistant' THEN FALSE END AS inbound,
         CASE WHEN c.role = 'user' THEN 'u' || CAST(c.conv_id % 37 AS VARCHAR)
              WHEN c.role = 'assistant' THEN {pick(BRANDS, 'c.conv_id % 5')}
              ELSE 'system' END AS author_id,
         CAST(c.conv_id AS VARCHAR) AS created_at,
         CASE WHEN c.role = 'assistant' THEN
                '@u' || CAST(c.conv_id % 37 AS VARCHAR) || ' ' || c.text
                || {pick(ASSISTANT_CLOSERS, 'c.conv_id % 4')}
                || ' https://t.co/' || CAST(c.conv_id AS VARCHAR) || ' /'
                || {pick(AGENT_INITIALS, 'c.turn % 3')}
              WHEN c.role = 'user' THEN c.text || {pick(USER_SENTENCES, '(2 * (c.conv_id % 5) + c.turn // 2) % 12')}
              ELSE c.text END AS text,
         CASE WHEN c.turn > 0 THEN c.conv_id * {TURNS} + c.turn - 1 END AS in_response_to_tweet_id,
         CASE WHEN EXISTS (SELECT 1 FROM conversations n
                           WHERE n.conv_id = c.conv_id AND n.turn = c.turn + 1)
              THEN CAST(c.conv_id * {TURNS} + c.turn + 1 AS VARCHAR) END AS response_tweet_id
  FROM conversations c
),
kept AS (
  SELECT * FROM base
  WHERE NOT (role = 'user' AND turn <= 1 AND conv_id % 11 = 0)
),
messages AS (
  SELECT tweet_id, author_id, inbound, created_at, text, response_tweet_id,
         in_response_to_tweet_id, 0 AS seq FROM kept
  UNION ALL
  SELECT tweet_id, author_id, inbound, created_at, text || ' (edited)', response_tweet_id,
         in_response_to_tweet_id, 1 AS seq FROM kept
  WHERE role = 'user' AND conv_id % 13 = 0
),
replies AS (
  SELECT author_id AS brand, tweet_id AS brand_tweet_id,
         in_response_to_tweet_id AS parent_tweet_id, text AS brand_text,
         created_at AS brand_created_at
  FROM messages
  WHERE NOT inbound AND author_id IN ({BRANDS_SQL}) AND in_response_to_tweet_id IS NOT NULL
),
customers AS (
  SELECT tweet_id, author_id, text, created_at, seq FROM (
    SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY seq DESC) AS rn
    FROM messages WHERE inbound) t
  WHERE rn = 1
),
pairs AS (
  SELECT r.brand, c.tweet_id AS customer_tweet_id, c.author_id AS customer_id,
         c.text AS customer_text, c.created_at AS customer_created_at,
         r.brand_tweet_id, r.parent_tweet_id, r.brand_text, r.brand_created_at
  FROM replies r JOIN customers c ON r.parent_tweet_id = c.tweet_id
)
"""


def with_messages(body: str, extra_ctes: str = "") -> str:
    extra = ("," + extra_ctes) if extra_ctes.strip() else ""
    return f"WITH {MESSAGES_CTE}{extra}\n{body}"


UPPER_MEDIAN = "CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY {x} DESC) AS BIGINT)"


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}

    o["scan_messages"] = with_messages(
        "SELECT tweet_id, author_id, inbound, created_at, text, response_tweet_id, "
        "in_response_to_tweet_id, seq FROM messages")

    o["preview_messages"] = with_messages(
        "SELECT tweet_id, author_id, inbound, created_at, text, response_tweet_id, "
        "in_response_to_tweet_id, seq FROM messages ORDER BY tweet_id, seq LIMIT 10")

    o["direction_counts"] = with_messages(
        "SELECT CAST(count(*) AS BIGINT) AS total_messages, "
        "CAST(count_if(inbound) AS BIGINT) AS inbound_messages, "
        "CAST(count_if(NOT inbound) AS BIGINT) AS outbound_messages FROM messages")

    o["top_authors"] = with_messages("""
SELECT direction, author_id, n_messages, rank FROM (
  SELECT CASE WHEN inbound THEN 'inbound' ELSE 'outbound' END AS direction, author_id,
         CAST(count(*) AS BIGINT) AS n_messages,
         CAST(row_number() OVER (PARTITION BY inbound ORDER BY count(*) DESC, author_id) AS BIGINT) AS rank
  FROM messages WHERE inbound IS NOT NULL AND author_id IS NOT NULL
  GROUP BY inbound, author_id) t
WHERE (direction = 'inbound' AND rank <= 20) OR (direction = 'outbound' AND rank <= 30)""")

    o["link_counts"] = with_messages(
        "SELECT CAST(count(response_tweet_id) AS BIGINT) AS with_response_tweet_id, "
        "CAST(count(in_response_to_tweet_id) AS BIGINT) AS with_in_response_to_tweet_id "
        "FROM messages")

    o["brand_replies"] = with_messages(
        "SELECT brand, brand_tweet_id, parent_tweet_id, brand_text, brand_created_at FROM replies")

    o["dedupe_messages"] = with_messages("""
SELECT tweet_id, author_id, inbound, created_at, text, response_tweet_id, in_response_to_tweet_id, seq
FROM (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY seq DESC) AS rn FROM messages) t
WHERE rn = 1""")

    o["answered_customer_messages"] = with_messages("""
SELECT tweet_id, author_id, inbound, created_at, text, response_tweet_id, in_response_to_tweet_id, seq
FROM messages m
WHERE inbound AND tweet_id IN (SELECT parent_tweet_id FROM replies)""")

    o["pair_conversations"] = with_messages("""
SELECT brand, CAST(customer_tweet_id AS VARCHAR) AS customer_tweet_id, customer_id, customer_text,
       customer_created_at, CAST(brand_tweet_id AS VARCHAR) AS brand_tweet_id,
       CAST(parent_tweet_id AS VARCHAR) AS parent_tweet_id, brand_text, brand_created_at
FROM pairs""")

    o["orphan_replies"] = with_messages("""
SELECT brand, brand_tweet_id, parent_tweet_id, brand_text, brand_created_at FROM replies r
WHERE NOT EXISTS (SELECT 1 FROM messages m WHERE m.inbound AND m.tweet_id = r.parent_tweet_id)""")

    med = UPPER_MEDIAN.format(x="linked_len")
    o["brand_stats"] = with_messages(f"""
SELECT b.brand,
       CAST(coalesce(s.brand_tweets, 0) AS BIGINT) AS brand_tweets,
       CAST(coalesce(s.linked_replies, 0) AS BIGINT) AS linked_replies,
       CAST(coalesce(u.unique_customers, 0) AS BIGINT) AS unique_customers,
       round(coalesce(s.avg_len, 0.0), 6) AS avg_reply_length,
       CAST(coalesce(s.median_len, 0) AS BIGINT) AS median_reply_length
FROM brand_list b
LEFT JOIN (
  SELECT author_id AS brand, count(*) AS brand_tweets, count(in_response_to_tweet_id) AS linked_replies,
         avg(linked_len) AS avg_len, {med} AS median_len
  FROM (SELECT *, CASE WHEN in_response_to_tweet_id IS NOT NULL THEN length(text) END AS linked_len
        FROM messages WHERE NOT inbound AND author_id IN ({BRANDS_SQL})) t
  GROUP BY author_id) s ON s.brand = b.brand
LEFT JOIN (
  SELECT r.brand, count(DISTINCT m.author_id) AS unique_customers
  FROM (SELECT DISTINCT brand, parent_tweet_id FROM replies) r
  JOIN messages m ON m.inbound AND m.tweet_id = r.parent_tweet_id
  GROUP BY r.brand) u ON u.brand = b.brand""",
        extra_ctes="brand_list AS (SELECT unnest([" + BRANDS_SQL + "]) AS brand)")

    o["pairing_coverage"] = with_messages("""
SELECT (SELECT CAST(count(DISTINCT parent_tweet_id) AS BIGINT) FROM replies) AS referenced_customer_ids,
       CAST(count(*) AS BIGINT) AS matched_customer_rows,
       CAST(count(DISTINCT tweet_id) AS BIGINT) AS matched_customer_ids
FROM messages WHERE inbound AND tweet_id IN (SELECT parent_tweet_id FROM replies)""")

    med = UPPER_MEDIAN.format(x="reply_len")
    o["response_diversity"] = with_messages(f"""
SELECT brand, CAST(count(*) AS BIGINT) AS paired_conversations,
       round(avg(reply_len), 6) AS avg_reply_length,
       {med} AS median_reply_length,
       CAST(count_if(contains(lower(brand_text), 'dm')) AS BIGINT) AS dm_replies,
       CAST(count_if(contains(brand_text, '?')) AS BIGINT) AS question_replies
FROM (SELECT *, CASE WHEN length(brand_text) > 0 THEN length(brand_text) END AS reply_len FROM pairs) p
GROUP BY brand""")

    o["examples_per_brand"] = with_messages("""
SELECT brand, example_rank, customer_tweet_id, customer_id, customer_text, customer_created_at,
       brand_tweet_id, brand_text FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY brand ORDER BY brand_tweet_id) AS BIGINT) AS example_rank
  FROM pairs) t
WHERE example_rank <= 10""")

    o["first_pairs"] = with_messages(f"""
SELECT CAST(customer_tweet_id AS VARCHAR) AS customer_tweet_id, customer_id, customer_text,
       customer_created_at, CAST(brand_tweet_id AS VARCHAR) AS brand_tweet_id,
       CAST(parent_tweet_id AS VARCHAR) AS parent_tweet_id, brand_text, brand_created_at
FROM pairs WHERE brand = {q(BRAND)} ORDER BY brand_tweet_id LIMIT 1000""")

    from carelens.plans import oracle_more
    o.update(oracle_more.oracle_sql())
    return o
