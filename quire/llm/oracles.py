"""DuckDB SQL of the queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

OP4 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w
), e AS MATERIALIZED (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s
), links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN both_ways l ON r.y = l.x
)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, c.component_id
FROM s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON s.doc_id = c.x
"""

OP6 = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

#: Windows of 200 bytes as hexadecimal digits, by MD5; those that occur twice are joined to runs.
OP11 = """WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  part AS (SELECT r, base, substr(h, 2 * base + 1, 1198) AS h FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199, 400)) AS base FROM d WHERE length(h) >= 400)),
  w AS MATERIALIZED (SELECT r, base + i AS i, md5(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT r, base, h, unnest(range(least(400, length(h) // 2 - 199))) AS i FROM part)),
  s AS (SELECT r, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
  g AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM s),
  k AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM g),
  spans AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM k GROUP BY r, k),
  gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM spans),
  kept AS (SELECT r, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS reach, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS before FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(before, '') || substr(h, 2 * coalesce(reach, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""

#: CRC-32 by its table of 256 rests, made by rule; then, for each period, the stretches of words that equal the word one period later.
OP13 = r"""WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
  d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS own,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM documents, t),
  e AS (SELECT r, doc_id, own, len(own) AS n, h % 10 = 0 AND len(own) > 0 AS planted, h // 10 AS g FROM d),
  f AS (SELECT *, CASE WHEN planted THEN g % n END AS a FROM e),
  w AS (SELECT r, doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: own[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE own END AS ws FROM f),
  m AS (SELECT r, q, list_filter(range(1, n - q + 1), lambda i: ws[i] = ws[i + q]) AS l FROM (SELECT r, n, ws, unnest(range(1, n // 4 + 1)) AS q FROM w)),
  p AS (SELECT r, q, unnest(l) AS i, generate_subscripts(l, 1) AS j FROM m WHERE len(l) >= greatest(3 * q, 6 - q)),
  u AS (SELECT r, q, min(i) - 1 AS s, count(*) + q AS length FROM p GROUP BY r, q, i - j HAVING count(*) >= greatest(3 * q, 6 - q)),
  runs AS (SELECT r, s, length, min(q) AS q FROM u GROUP BY r, s, length),
  best AS (SELECT r, s, length, q FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / q DESC, s, q) AS k FROM runs) WHERE k = 1),
  texts AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r),
  gone AS (SELECT DISTINCT r, unnest(range(s + q + 1, s + length + 1)) AS i FROM runs),
  cut AS (SELECT r, list(i) AS dropped FROM gone GROUP BY r),
  kept AS (SELECT w.r, doc_id, array_to_string(CASE WHEN dropped IS NULL THEN ws ELSE list_transform(list_filter(list_zip(ws, range(1, n + 1)), lambda x: NOT list_contains(dropped, x[2])), lambda x: x[1]) END, ' ') AS body FROM w LEFT JOIN cut USING (r))
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, length, q AS period, 1000 * length // q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(body) AS collapsed_sha256 FROM kept LEFT JOIN texts USING (r) LEFT JOIN best USING (r)"""
