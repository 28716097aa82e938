"""DuckDB SQL of the filter audit and of importance resampling."""

from __future__ import annotations

from glintscan.llm.filter_audit import MAX_CAPITALS, MIN_DISTINCT, MIN_WORDS

AUDIT_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), l AS (
  SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic
  FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic,
         (len(ws) < {MIN_WORDS})::INT
         + 2 * (100 * len(list_distinct(ws)) < {MIN_DISTINCT} * len(ws))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT
         + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)::INT AS fails
  FROM d LEFT JOIN l USING (doc_id)
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step::INT AS step, (1 << (ascii(filter_order[step]) - 65))::INT AS own,
         coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::INT AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
), g AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), r AS (
  SELECT part, filter_order, step, own, g.*,
         fails & own <> 0 AND fails & earlier = 0 AS here,
         fails & own <> 0 AND fails & earlier <> 0 AS late
  FROM g, steps
), counted AS (
  SELECT part, filter_order, step, any_value(own) AS own,
         sum(CASE WHEN here THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN late THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN here THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN here THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
         sum(n) AS all_docs
  FROM r GROUP BY part, filter_order, step
)
SELECT part, filter_order, step,
       (all_docs - sum(removed) OVER (PARTITION BY part, filter_order ORDER BY step))::BIGINT AS kept,
       removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""

# CRC-32 byte by byte: what eight shifts make of each byte, then one lookup a byte.
IMPORTANCE_SQL = rf"""
WITH RECURSIVE shifted AS (
  SELECT unnest(range(0, 256))::BIGINT AS byte, unnest(range(0, 256))::BIGINT AS v, 0 AS k
  UNION ALL
  SELECT byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1
  FROM shifted WHERE k < 8
), lookup AS (
  SELECT list(v ORDER BY byte) AS step FROM shifted WHERE k = 8
), d AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark
), p AS (
  SELECT doc_id, unnest(ws) AS w FROM d
), vocabulary AS (
  SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM p UNION SELECT w FROM b)
), hashed AS (
  SELECT w, xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2),
             lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)),
           lambda a, x: xor(a >> 8, step[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM vocabulary, lookup
), source AS (
  SELECT bucket, count(*) AS n FROM p JOIN hashed USING (w) GROUP BY bucket
), target AS (
  SELECT bucket, count(*) AS n FROM b JOIN hashed USING (w) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(
           (coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM source) + 10000)::DOUBLE
           / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM target) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT unnest(range(0, 10000)) AS bucket) LEFT JOIN source s USING (bucket) LEFT JOIN target t USING (bucket)
), weights AS (
  SELECT doc_id, sum(gain)::BIGINT AS weight
  FROM p JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY doc_id
), scores AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln(
           (('0x' || substr(sha256('2024:' || d.doc_id::VARCHAR), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (doc_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) FILTER (n_features >= 20) OVER () AS eligible
  FROM scores
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= eligible * 10 // 100 THEN place END AS rank
FROM ranked
"""
