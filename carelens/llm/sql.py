"""DuckDB twins of the corpus queries that SQL can express."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DECONTAMINATE = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN CAST([] AS VARCHAR[]) ELSE
    regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
    regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
        FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, k)),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit
      FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS q FROM (SELECT DISTINCT doc_id, i, n FROM h))
      GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
  coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""

MIXING = r"""
WITH s AS (
  SELECT doc_id, source AS src,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size
  FROM documents),
p AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM s GROUP BY src),
c AS (
  SELECT *, source_size * 2.0::DOUBLE AS top, sum(source_size) OVER () * 1.5::DOUBLE AS total,
    source_size * 2.0::DOUBLE / w AS ratio FROM p),
l AS (
  SELECT *, (total - coalesce(sum(top) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM c WINDOW b AS (ORDER BY ratio, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT first(level ORDER BY ratio, src NULLS LAST) AS level FROM l WHERE top > level * w),
t AS (
  SELECT src, source_size, CASE WHEN f.level IS NULL OR top <= f.level * w THEN top ELSE f.level * w END AS target
  FROM l LEFT JOIN f ON true),
r AS (
  SELECT src, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole
  FROM t),
q AS (
  SELECT s.doc_id, s.src, s.size, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS remaining,
    (CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)::DOUBLE + 0.5)
      / 4503599627370496.0::DOUBLE AS u
  FROM s JOIN r ON s.src IS NOT DISTINCT FROM r.src),
o AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY src ORDER BY u / (1 - u) / sqrt(greatest(size, 1)::DOUBLE), doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM q),
k AS (
  SELECT *, CASE WHEN size = 0 THEN 0
    ELSE CAST(whole AS BIGINT) + CASE WHEN 2 * run + size <= 2 * remaining THEN 1 ELSE 0 END END AS copies FROM o)
SELECT doc_id, src AS source, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies AS BIGINT) AS copies,
  CAST(copies * size AS BIGINT) AS taken
FROM k
"""

RESAMPLE = rf"""
WITH RECURSIVE bit AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8),
tbl AS (SELECT list(c ORDER BY i) AS crc_of FROM bit WHERE k = 8),
w AS (
  SELECT row_number() OVER () AS rid, doc_id, CASE WHEN text IS NULL THEN CAST([] AS VARCHAR[]) ELSE
    regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w FROM documents),
bw AS (
  SELECT regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
f AS (
  SELECT rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM bw),
x AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM f UNION SELECT f FROM bf)),
b AS (
  SELECT f, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)),
    lambda c, y: xor(crc_of[(xor(c, y) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM x, tbl),
s AS (SELECT bucket, count(*) AS s FROM f JOIN b USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN b USING (f) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0)::DOUBLE + 1) * ((SELECT count(*) FROM f)::DOUBLE + 10000))
    / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT count(*) FROM bf)::DOUBLE + 10000)))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM b) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
d AS (
  SELECT rid, CAST(count(*) AS BIGINT) AS n, CAST(sum(gain) AS BIGINT) AS total
  FROM f JOIN b USING (f) JOIN g USING (bucket) GROUP BY rid),
e AS (
  SELECT rid, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features,
    CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
    CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT)::DOUBLE AS h
  FROM w LEFT JOIN d USING (rid)),
sc AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM e),
r AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS rank,
    25 * count(*) OVER () // 100 AS n_drawn FROM sc WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CAST(CASE WHEN rank <= n_drawn THEN rank END AS BIGINT) AS rank
FROM sc LEFT JOIN r USING (rid)
"""

HARD_NEGATIVES = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
  AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_BARE = "[A-Za-z0-9]([A-Za-z0-9+/_.=-]*[A-Za-z0-9])?"

SECRETS = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
marked AS (
  SELECT rid, 0 AS k, regexp_replace(t, '{_ASSIGN}', chr(57344) || '\0' || chr(57344), 'g') AS x FROM d
  UNION ALL SELECT rid, 1, regexp_replace(t, 'AKIA[A-Z0-9]+', chr(57344) || '\0' || chr(57344), 'g') FROM d
  UNION ALL SELECT rid, 2, regexp_replace(t, '[0-9a-f]+', chr(57344) || '\0' || chr(57344), 'g') FROM d
  UNION ALL SELECT rid, 3, regexp_replace(t, '{_BARE}', chr(57344) || '\0' || chr(57344), 'g') FROM d),
piece AS (
  SELECT rid, k, unnest(p) AS s, generate_subscripts(p, 1) AS i
  FROM (SELECT rid, k, string_split(x, chr(57344)) AS p FROM marked)),
placed AS (SELECT rid, k, i, s, sum(length(s)) OVER (PARTITION BY rid, k ORDER BY i) AS e FROM piece),
m AS (
  SELECT rid, k, s, CAST(e - length(s) AS BIGINT) AS a, CAST(e AS BIGINT) AS e,
    CASE WHEN k = 0 THEN regexp_extract(s, '{_ASSIGN}', 2) ELSE s END AS v
  FROM placed WHERE i % 2 = 0),
ok AS (
  SELECT rid, k, a, e, regexp_extract(v, '{_BARE}') AS v FROM m
  WHERE length(v) >= CASE k WHEN 1 THEN 18 WHEN 2 THEN 16 ELSE 12 END
    AND (k < 3 OR regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]'))),
c AS (
  SELECT * FROM ok WHERE k < 3 OR NOT EXISTS (
    SELECT 1 FROM ok o WHERE o.rid = ok.rid AND o.k < 3 AND o.a < ok.e AND o.e > ok.a)),
own AS (
  SELECT v, count(DISTINCT coalesce('s' || source, 'n')) AS n_owners,
    count(DISTINCT coalesce('s' || source, 'n') || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS n_repositories,
    max(k < 2) AS named,
    regexp_matches(v, '[0-9]') AND len(list_distinct(string_split(v, ''))) >= 8 AS random,
    length(v) >= 20 AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AS mixed
  FROM c JOIN d USING (rid) GROUP BY v),
j AS (
  SELECT rid, a, e, v, CASE WHEN n_owners >= 3 THEN 'example' WHEN random THEN 'live' ELSE 'weak' END AS verdict,
    CASE WHEN k < 3 THEN k WHEN n_owners >= 3 OR NOT random THEN NULL WHEN named THEN 3
      WHEN mixed AND n_owners = 1 AND n_repositories > 1 THEN 4 END AS k
  FROM c JOIN own USING (v)),
g AS (
  SELECT rid, count_if(k = 0) AS n0, count_if(k = 1) AS n1, count_if(k = 2) AS n2, count_if(k = 3) AS n3,
    count_if(k = 4) AS n4, count_if(verdict = 'live') AS n_live, count_if(verdict = 'example') AS n_example,
    string_agg(['assign', 'access', 'hex', 'reused', 'owned'][k + 1] || ':' || a || ':' || e, ',' ORDER BY a, k, e)
      FILTER (k < 3) AS base,
    string_agg(['assign', 'access', 'hex', 'reused', 'owned'][k + 1] || ':' || a || ':' || e, ',' ORDER BY a, k, e) AS spans
  FROM j WHERE k IS NOT NULL GROUP BY rid)
SELECT doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access,
  CAST(coalesce(n2, 0) AS BIGINT) AS n_hex, CAST(coalesce(n3, 0) AS BIGINT) AS n_reused,
  CAST(coalesce(n4, 0) AS BIGINT) AS n_owned, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  CAST(coalesce(n_live, 0) AS BIGINT) AS n_live, CAST(coalesce(n_example, 0) AS BIGINT) AS n_example
FROM d LEFT JOIN g USING (rid)
"""
