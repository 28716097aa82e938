"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from glintscan.llm.quality import MAX_LINE_SHARE, MAX_SHARE

_GRAMS = ", ".join(map(str, sorted(MAX_SHARE)))
_PIVOT = ", ".join(
    f"coalesce(max(chars) FILTER (n = {n}), 0)::BIGINT AS dup_chars_{n}" for n in sorted(MAX_SHARE)
)
_COUNTS = ", ".join(f"coalesce(g.dup_chars_{n}, 0)::BIGINT AS dup_chars_{n}" for n in sorted(MAX_SHARE))
_FAILED = "(c.n_words < 20 OR 100 * coalesce(g.n_repeat_words, 0) > 30 * c.n_words)"
_RULES = " AND ".join(
    f"coalesce(g.dup_chars_{n}, 0) <= {share} * c.word_chars" for n, share in sorted(MAX_SHARE.items())
)

QUALITY_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), c AS (
  SELECT doc_id, len(ws) AS n_words,
         coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols
  FROM d
), w AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d
), windows AS (
  SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS gram
  FROM w, (SELECT unnest([{_GRAMS}]) AS n) WHERE i + n - 1 <= len(ws)
), repeated AS (
  SELECT doc_id, n, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, n, gram) > 1
), covered AS (
  SELECT DISTINCT doc_id, n, i + unnest(range(0, n)) AS i FROM repeated
), g AS (
  SELECT doc_id, max(places) FILTER (n = 8) AS n_repeat_words, {_PIVOT}
  FROM (
    SELECT v.doc_id, v.n, count(*) AS places, sum(length(w.ws[v.i])) AS chars
    FROM covered v JOIN w ON w.doc_id = v.doc_id AND w.i = v.i GROUP BY ALL
  ) GROUP BY doc_id
), split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d
), lines AS (
  SELECT doc_id, sum(k - 1)::BIGINT AS n_dup_lines, sum((k - 1) * chars)::BIGINT AS dup_line_chars
  FROM (
    SELECT doc_id, line, count(*) AS k,
           length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars
    FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL
  ) GROUP BY doc_id
)
SELECT c.doc_id, c.n_words, c.word_chars, c.n_symbols,
       coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines,
       coalesce(g.n_repeat_words, 0)::BIGINT AS n_repeat_words,
       coalesce(l.dup_line_chars, 0)::BIGINT AS dup_line_chars, {_COUNTS},
       {_FAILED} AS base_failed,
       NOT {_FAILED} AND coalesce(l.dup_line_chars, 0) <= {MAX_LINE_SHARE} * c.word_chars
         AND {_RULES} AS kept
FROM c LEFT JOIN g USING (doc_id) LEFT JOIN lines l USING (doc_id)
"""

_TURN = "'<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)"

CHAT_SQL = f"""
WITH c AS (
  SELECT conv_id,
         list_sort(list({{'turn': turn, 'role': role, 'text': text}})) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), own AS (
  SELECT *, list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') AS own FROM c
), p AS (
  SELECT conv_id,
         list_transform(turns, lambda t: {{'role': t.role, 'text': t.text}}) AS a,
         list_transform(
           CASE WHEN len(own) > 1 THEN list_transform(range(1, len(turns) + 1), lambda i:
             turns[CASE WHEN i = own[-1] THEN own[-2] WHEN i = own[-2] THEN own[-1] ELSE i END])
           ELSE turns[1 : own[1] - 1] END,
           lambda t: {{'role': t.role, 'text': t.text}}) AS b
  FROM own WHERE len(own) > 0
), n AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1,
                     least(len(a), len(b))) AS n_common
  FROM p
), r AS (
  SELECT conv_id, n_common, list_transform(a, lambda t: {_TURN}) AS ra,
         list_transform(b, lambda t: {_TURN}) AS rb, a, b
  FROM n
), m AS (
  SELECT *,
    list_transform(list_filter(range(n_common + 1, len(a) + 1), lambda i: a[i].role = 'assistant'), lambda i:
      (length(array_to_string(ra[1 : i - 1], '')) + 12 + length(a[i].role) + 1)::VARCHAR || '-' ||
      length(array_to_string(ra[1 : i], ''))::VARCHAR) AS ma,
    list_transform(list_filter(range(n_common + 1, len(b) + 1), lambda i: b[i].role = 'assistant'), lambda i:
      (length(array_to_string(rb[1 : i - 1], '')) + 12 + length(b[i].role) + 1)::VARCHAR || '-' ||
      length(array_to_string(rb[1 : i], ''))::VARCHAR) AS mb
  FROM r
)
SELECT conv_id, n_common::BIGINT AS n_common,
       coalesce(array_to_string(ra[1 : n_common], ''), '') AS prompt,
       coalesce(array_to_string(ra[n_common + 1 :], ''), '') AS chosen,
       coalesce(array_to_string(rb[n_common + 1 :], ''), '') AS rejected,
       coalesce(array_to_string(ma, ','), '') AS chosen_mask,
       coalesce(array_to_string(mb, ','), '') AS rejected_mask
FROM m
"""
