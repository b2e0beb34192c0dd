"""The tables of ``adapters`` as DuckDB common table expressions, for the equivalents of queries."""

CTE = {
    "lines": """lines AS (
  SELECT doc_id AS version_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents)""",
    "blocks": """blocks AS (
  SELECT version_id, p::INT AS p, (p // 5)::INT AS page_index, (p % 5)::INT AS reading_order,
    CASE WHEN p % 21 = 20 THEN 'References'
         WHEN p % 7 = 2 THEN (p // 7 + 1) || ' Section ' || (p // 7 + 1)
         WHEN p % 7 = 4 THEN 'Fig. ' || (p // 7 + 1) || '. ' || raw
         WHEN p % 7 = 1 THEN raw || ' [1, 2] see 10.1234/q' || version_id || '.'
         WHEN p % 21 = 19 THEN '[' || (p // 7 + 1) || '] ' || raw ELSE raw END AS text,
    0.1::DOUBLE AS x0, t AS y0, 0.9::DOUBLE AS x1, t + 0.05::DOUBLE AS y1,
    CASE WHEN p = 0 THEN 14.0 WHEN p % 7 = 2 THEN 12.0 ELSE 10.0 END::DOUBLE AS font_size,
    CASE WHEN p % 13 = 5 THEN ['math'] WHEN p % 13 = 8 THEN ['in_table'] ELSE []::VARCHAR[] END AS quality_flags
  FROM (SELECT version_id, p, ls[p + 1] AS raw, ([0.02, 0.2, 0.4, 0.6, 0.93]::DOUBLE[])[p % 5 + 1] AS t
        FROM (SELECT version_id, ls, unnest(range(len(ls))) AS p FROM lines)))""",
    "papers": """papers AS (
  SELECT doc_id AS paper_id, doc_id AS version_id, CASE WHEN doc_id % 3 = 0 THEN 'team' ELSE 'local' END AS owner_id,
    CASE WHEN doc_id % 6 = 1 THEN '<b>' || substr(ls[1], 1, 290) || '</b>' ELSE substr(ls[1], 1, 300) END AS title,
    sha256(coalesce(text, '')) AS sha256, TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS created_at,
    CASE WHEN doc_id % 4 = 0 THEN TIMESTAMP '2024-01-02' + to_seconds(doc_id) END AS last_opened_at,
    CASE WHEN doc_id % 5 = 1 THEN '' WHEN doc_id % 5 > 1 THEN '10.1234/p' || doc_id END AS doi,
    CASE WHEN doc_id % 17 = 0 THEN TIMESTAMP '2024-01-03' + to_seconds(doc_id) END AS deleted_at, (1900 + doc_id % 130)::INT AS year, source
  FROM documents JOIN lines ON doc_id = version_id)""",
    "answers": """answers AS (
  SELECT conv_id * 1000 + turn AS answer_id, conv_id AS session, turn, prompt,
    text || ' [cite ' || (turn % 4 + 1) || '¶' || (conv_id % 3 + 1) || ', 9] and [cite ' || (conv_id % 5 + 1) || '] see Fig. ' || (conv_id % 3 + 1) || ', p.1' || (conv_id % 9)
      || chr(10) || '```html title' || chr(10) || '<p>' || conv_id || '</p>' || chr(10) || '```' || chr(10) || 'end' AS markdown,
    TIMESTAMP '2024-01-01' + to_seconds(conv_id * 600 + turn * 60) AS created_at, CASE WHEN conv_id % 7 = 0 THEN 'import' ELSE 'chat' END AS origin,
    CASE WHEN (conv_id + turn) % 11 = 0 THEN TIMESTAMP '2024-01-01' + to_seconds(conv_id * 600 + turn * 60 + 5) END AS discarded_at, conv_id AS packet_id
  FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prompt FROM conversations)
  WHERE role = 'assistant')""",
    "paper_tags": """paper_tags AS (
  SELECT doc_id AS paper_id, 'Quality' AS tag FROM labels WHERE quality = 1
  UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'toxic' ELSE 'TOXIC' END FROM labels WHERE toxic = 1
  UNION ALL SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'quality' ELSE 'poor' END FROM labels WHERE quality = 0)""",
    "annotations": """annotations AS (
  SELECT event_id AS annotation_id, user_id AS version_id, (event_id % 40)::INT AS page_index, (event_id * 7919 % 1000)::DOUBLE / 1000 AS v, (event_id * 104729 % 1000)::DOUBLE / 1000 AS u,
    CASE WHEN event_id % 3 = 0 THEN 'region' ELSE 'text' END AS kind, CASE WHEN event_id % 5 < 3 THEN 'c' || (event_id % 5 + 1) END AS color,
    'Quote ' || (event_id % 50) AS quote, CASE WHEN event_id % 4 = 0 THEN 'x^2 ' || (event_id % 9) END AS display_quote,
    CASE event_type WHEN 'click' THEN 'Note ' || props WHEN 'view' THEN '' WHEN 'signup' THEN NULL ELSE event_type END AS comment, ts AS created_at, value
  FROM events)""",
    "page_stats": """page_stats AS (
  SELECT version_id, page_index, sum(length(replace(text, ' ', '')))::BIGINT AS chars, sum(length(regexp_replace(text, '[^#%$&]', '', 'g')))::BIGINT AS unmapped,
    CASE WHEN (version_id + page_index) % 9 = 0 THEN 0.9 ELSE 0.1 END::DOUBLE AS coverage
  FROM blocks GROUP BY version_id, page_index)""",
}
NEEDS = {"blocks": ["lines"], "papers": ["lines"], "page_stats": ["blocks"]}


def with_tables(*names: str, body: str, more: str = "") -> str:
    """``body`` behind the expressions of the named tables; ``more`` are further expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ", ".join([*(CTE[n] for n in order), *([more] if more else [])]) + " " + body
