"""Queries over threads, marks and contexts, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers as N
from ..operators import library as L
from ..operators import search as R
from ..operators import structure as S
from ..operators import threads as H
from ..sources import adapters as A
from ..sources import library as SRC
from ..sources.adapters_sql import with_tables
from .more_queries import ANCHORS, CAPTION_SQL, _box_anchors
from .structure_queries import HEADS, NOT_BODY_SQL


def _threads(x, d):
    """A thread for every second conversation; every ninth is deleted."""
    c = A.table(x, d, "conversations").select(F.col("conv_id").alias("session")).distinct().filter("session % 2 = 0")
    return c.select("session", F.concat(F.lit("Thread "), F.col("session").cast("string")).alias("title"), F.when(F.col("session") % 9 == 0, F.lit("2024-02-01").cast("timestamp")).alias("deleted_at"))


THREADS = "threads AS (SELECT DISTINCT conv_id AS session, 'Thread ' || conv_id AS title, CASE WHEN conv_id % 9 = 0 THEN TIMESTAMP '2024-02-01' END AS deleted_at FROM conversations WHERE conv_id % 2 = 0)"


def _forks(x, d):
    """Every third session forks from the one before it: at its first answer, at an unknown one, or at none."""
    s = F.col("session")
    return A.answers(x, d).select("session").distinct().filter("session % 3 > 0").select("session", (s - 1).alias("parent"), F.when(s % 4 == 0, F.lit(-5).cast("long")).when(s % 4 > 1, (s - 1) * 1000 + 1).alias("at"))


def _runs(x, d):
    e = A.table(x, d, "events")
    return e.select(F.col("user_id").alias("version_id"), F.when(F.col("event_type") == "view", "QUEUED").when(F.col("event_type") == "click", "RUNNING").otherwise("DONE").alias("status"), (F.col("event_id") % 50).cast("int").alias("parser"))


def _quotes(x, d):
    return A.annotations(x, d).withColumn("quote", F.concat("quote", F.lit("\u0001  x"), F.lit("\ty")))


def _queries(x, d):
    b = A.table(x, d, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.concat(F.lit('"'), F.substring("text", 1, 20), F.lit('" OR -- '), F.substring("text", 30, 40)).alias("query"))


def _expected(x, d):
    from ..operators.translation import sentences

    return sentences(A.blocks(x, d)).withColumnRenamed("sentence_no", "n")


CITES = r"""g AS (SELECT answer_id, unnest(range(len(l))) AS pos, l FROM (SELECT answer_id, flatten(list_transform(regexp_extract_all(markdown, '\[cite ([^\[\]]*)\]', 1), lambda x: regexp_split_to_array(x, ', *'))) AS l FROM answers)), i AS (SELECT answer_id, pos, l[pos + 1] AS item FROM g),
  c AS (SELECT answer_id, regexp_extract(item, '^(?:\w+ )?(\d+)', 1)::INT AS number, CASE WHEN regexp_extract(item, '¶ *(\d+)', 1) = '' THEN NULL ELSE regexp_extract(item, '¶ *(\d+)', 1)::INT END AS paragraph, min(pos)::INT AS pos FROM i WHERE regexp_extract(item, '^(?:\w+ )?(\d+)', 1) <> '' GROUP BY 1, 2, 3)"""


def thread_queries() -> dict:
    b, ans, an = A.blocks, A.answers, A.annotations
    return {
        "readable_quotes": (lambda x, d: H.readable_quotes(_quotes(x, d)).select("annotation_id", "quote"), with_tables("annotations", body="SELECT annotation_id, quote || ' x' || chr(9) || 'y' AS quote FROM annotations")),
        "threads_with_answers": (lambda x, d: H.threads_with_answers(_threads(x, d), ans(x, d)).select("session", "title"), with_tables("answers", more=THREADS, body="SELECT session, title FROM threads WHERE session IN (SELECT session FROM answers WHERE discarded_at IS NULL)")),
        "versions_to_reprocess": (lambda x, d: H.versions_to_reprocess(A.papers(x, d), _runs(x, d).filter("parser < 30 or status = 'DONE'"), 7).select("version_id"), "SELECT doc_id AS version_id FROM documents WHERE doc_id NOT IN (SELECT user_id FROM events WHERE (event_id % 50 < 30 OR event_type NOT IN ('view', 'click')) AND (event_type IN ('view', 'click') OR event_id % 50 = 7))"),
        "name_conversations": (
            lambda x, d: N.name_conversations(ans(x, d), ans(x, d).select("session").distinct().filter("session % 5 = 0").select("session", F.concat(F.lit("Own "), F.col("session").cast("string")).alias("title")), _threads(x, d).withColumn("kind", F.when(F.col("session") % 4 == 0, "explain"))),
            with_tables("answers", more=THREADS + ", c AS (SELECT session, count(*) AS answers, epoch(max(created_at))::BIGINT AS last_s, arg_min(packet_id, (created_at, answer_id)) AS source, coalesce(substr(trim(regexp_replace(arg_min_null(prompt, (created_at, answer_id)), '[ \\t\\r\\n]+', ' ', 'g')), 1, 80), 'Untitled') AS prompt FROM answers WHERE discarded_at IS NULL GROUP BY session)", body="SELECT c.session, c.answers, last_s, source, CASE WHEN c.session % 5 = 0 THEN 'Own ' || c.session ELSE coalesce(t.title, prompt) END AS title, CASE WHEN t.session IS NOT NULL AND c.session % 4 = 0 THEN 'explain' ELSE 'chat' END AS kind FROM c LEFT JOIN threads t ON t.session = c.session AND t.deleted_at IS NULL"),
        ),
        "orphan_tags": (lambda x, d: H.orphan_tags(A.table(x, d, "documents").select(F.when(F.col("doc_id") % 3 == 0, "TOXIC").when(F.col("doc_id") % 3 == 1, "poor").otherwise(F.concat(F.lit("tag"), F.col("source"))).alias("name")).distinct(), A.paper_tags(x, d)), with_tables("paper_tags", body="SELECT DISTINCT name FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'TOXIC' WHEN doc_id % 3 = 1 THEN 'poor' ELSE 'tag' || source END AS name FROM documents) WHERE lower(name) NOT IN (SELECT lower(tag) FROM paper_tags)")),
        "session_titles": (lambda x, d: H.session_titles(N.sessions_of(ans(x, d)).filter("session % 3 = 0").select("session", "title"), _threads(x, d)), with_tables("answers", more=THREADS + ", q AS (SELECT session, arg_min_null(prompt, (created_at, answer_id)) AS q FROM answers WHERE session % 3 = 0 GROUP BY 1)", body="SELECT session, CASE WHEN length(q) > 40 THEN substr(q, 1, 40) || '…' ELSE q END AS title FROM q UNION ALL SELECT session, title FROM threads WHERE deleted_at IS NULL AND session NOT IN (SELECT session FROM q)")),
        "list_threads": (lambda x, d: H.list_threads(_threads(x, d), ans(x, d)), with_tables("answers", more=THREADS, body="SELECT session, any_value(title) AS title, count(*) AS answers, epoch(max(created_at))::BIGINT AS last_s FROM threads JOIN answers USING (session) WHERE deleted_at IS NULL AND discarded_at IS NULL GROUP BY session")),
        "conversation_turns": (
            lambda x, d: H.conversation_turns(ans(x, d), _forks(x, d)),
            with_tables("answers", more="""own AS (SELECT session, list(answer_id ORDER BY created_at, answer_id) AS ids, list(created_at ORDER BY created_at, answer_id) AS ts FROM answers GROUP BY 1),
              l AS (SELECT session, ids, ts, CASE WHEN session % 3 > 0 AND session - 1 IN (SELECT session FROM own) THEN session - 1 END AS parent, CASE WHEN session % 4 = 0 THEN -5 WHEN session % 4 > 1 THEN (session - 1) * 1000 + 1 END AS cut_at FROM own),
              t AS (SELECT session, ids, ts, len(ids) AS n_own FROM l WHERE parent IS NULL UNION ALL
                SELECT l.session, list_concat(CASE WHEN cut_at IS NULL THEN list_filter(t.ids, lambda x, i: t.ts[i] < l.ts[1]) WHEN list_contains(t.ids, cut_at) THEN t.ids[1:list_position(t.ids, cut_at)] ELSE t.ids END, l.ids), list_concat(CASE WHEN cut_at IS NULL THEN list_filter(t.ts, lambda x: x < l.ts[1]) WHEN list_contains(t.ids, cut_at) THEN t.ts[1:list_position(t.ids, cut_at)] ELSE t.ts END, l.ts), len(l.ids) FROM t JOIN l ON l.parent = t.session)""",
                        body="SELECT session, (i - 1)::INT AS position, ids[i] AS answer_id, i <= len(ids) - n_own AS inherited FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM t)"),
        ),
        "paper_artifacts": (lambda x, d: N.paper_artifacts(ans(x, d)).select("packet_id", "answer_id", "number", "language"), with_tables("answers", body="SELECT packet_id, answer_id, 0 AS number, 'html' AS language FROM (SELECT *, row_number() OVER (PARTITION BY packet_id ORDER BY created_at DESC, answer_id) AS k FROM answers WHERE discarded_at IS NULL) WHERE k <= 200")),
        "parse_queries": (
            lambda x, d: R.parse_queries(_queries(x, d)).select("query_id", "term_no", F.array_join("tokens", " ").alias("tokens"), "is_prefix"),
            r"""WITH q AS (SELECT item_id AS query_id, '"' || substr(text, 1, 20) || '" OR -- ' || substr(text, 30, 40) AS query FROM benchmark), t AS (SELECT query_id, list_filter(regexp_extract_all(substr(query, 1, 200), '("[^"]*"|[^\s"]+)', 1), lambda x: regexp_matches(x, '[\p{L}\p{N}]'))[1:16] AS items FROM q), u AS (SELECT query_id, unnest(range(len(items)))::INT AS term_no, unnest(items) AS item FROM t)
              SELECT query_id, term_no, array_to_string(list_filter(regexp_split_to_array(lower(item), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') AS tokens, NOT starts_with(item, '"') AS is_prefix FROM u""",
        ),
        "highlight": (
            lambda x, d: R.highlight(A.papers(x, d).select(F.col("paper_id").alias("doc"), "title"), "title", ["the", "and", "of", "und", "que"]),
            with_tables("papers", more="w AS (SELECT paper_id AS doc, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM (SELECT paper_id, string_split(title, ' ') AS ws FROM papers)), m AS (SELECT *, lower(regexp_replace(word, '[^A-Za-z0-9]', '', 'g')) IN ('the', 'and', 'of', 'und', 'que') AS match FROM w), f AS (SELECT *, CASE WHEN match = lag(match) OVER (PARTITION BY doc ORDER BY i) THEN 0 ELSE 1 END AS new FROM m), r AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY i)::BIGINT AS run FROM f)", body="SELECT doc, run, match, string_agg(word, ' ' ORDER BY i) AS part FROM r GROUP BY doc, run, match"),
        ),
        "current_heading": (lambda x, d: L.current_heading(S.headings(b(x, d)), b(x, d)).fillna("", ["heading"]), with_tables("blocks", more=HEADS, body="SELECT b.version_id, b.p, coalesce(arg_max(h.title, h.p), '') AS heading FROM blocks b LEFT JOIN headings h ON h.version_id = b.version_id AND h.p <= b.p GROUP BY 1, 2")),
        "resolve_citations": (
            lambda x, d: N.resolve_citations(N.extract_citations(ans(x, d)), ans(x, d).select("answer_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("number")).withColumn("paragraphs", F.lit(2))).fillna(0, ["paragraph"]),
            with_tables("answers", more=CITES, body="SELECT answer_id, pos, number, CASE WHEN number <= 3 AND paragraph <= 2 THEN paragraph ELSE 0 END AS paragraph, number <= 3 AS resolved FROM c"),
        ),
        "selection_context": (
            lambda x, d: H.selection_context(_box_anchors(x, d), b(x, d), S.neighbours(b(x, d))).fillna(-1, ["before", "after"]),
            with_tables("blocks", "annotations", more=ANCHORS + f", u AS (SELECT anchor_id, version_id, min(p) AS p FROM ba JOIN blocks USING (version_id, page_index) WHERE greatest(0, least(x1, a1) - greatest(x0, a0)) * greatest(0, least(y1, b1) - greatest(y0, b0)) >= 0.5::DOUBLE * (a1 - a0) * (b1 - b0) GROUP BY 1, 2), n AS (SELECT version_id, p, CASE WHEN page_index - lag(page_index) OVER w <= 2 THEN lag(p) OVER w END AS before, CASE WHEN lead(page_index) OVER w - page_index <= 2 THEN lead(p) OVER w END AS after FROM blocks WHERE NOT {NOT_BODY_SQL} AND trim(text) <> '' WINDOW w AS (PARTITION BY version_id, font_size ORDER BY p))", body="SELECT anchor_id, version_id, p, coalesce(before, -1) AS before, coalesce(after, -1) AS after FROM u LEFT JOIN n USING (version_id, p)"),
        ),
        "region_context": (
            lambda x, d: H.region_context(_box_anchors(x, d).withColumns({"a0": F.lit(0.0), "a1": F.lit(1.0), "b1": F.col("b0") + 0.3}), b(x, d)).fillna(-1, ["caption_p"]).fillna("", ["text"]),
            with_tables("blocks", "annotations", more="ba AS (SELECT annotation_id AS anchor_id, version_id, page_index % 4 AS page_index, 0.0::DOUBLE AS a0, v * 0.9::DOUBLE AS b0, 1.0::DOUBLE AS a1, v * 0.9::DOUBLE + 0.3::DOUBLE AS b1 FROM annotations), j AS (SELECT *, greatest(greatest(0, x0 - a1, a0 - x1), greatest(0, y0 - b1, b0 - y1)) AS gap, greatest(0, least(x1, a1) - greatest(x0, a0)) * greatest(0, least(y1, b1) - greatest(y0, b0)) >= 0.5::DOUBLE * (x1 - x0) * (y1 - y0) AS inside FROM ba JOIN blocks USING (version_id, page_index)), c AS (SELECT anchor_id, arg_min(p, (gap, p)) AS caption_p FROM j WHERE " + CAPTION_SQL + " AND gap <= 0.08::DOUBLE GROUP BY 1), t AS (SELECT j.anchor_id, string_agg(text, chr(10) ORDER BY p) AS text FROM j LEFT JOIN c ON j.anchor_id = c.anchor_id WHERE inside AND p IS DISTINCT FROM caption_p GROUP BY 1)", body="SELECT anchor_id, coalesce(caption_p, -1) AS caption_p, coalesce(text, '') AS text FROM c FULL JOIN t USING (anchor_id)"),
        ),
        "export_marks": (lambda x, d: H.export_marks(an(x, d)), with_tables("annotations", more="a AS (SELECT *, CASE WHEN trim(coalesce(comment, '')) <> '' THEN trim(comment) END AS note FROM annotations)", body="SELECT version_id, row_number() OVER (PARTITION BY version_id ORDER BY page_index, v, u, annotation_id)::INT AS position, annotation_id, CASE WHEN color IS NOT NULL THEN 'highlight' ELSE 'note' END AS kind, CASE WHEN length(quote) > 200 THEN substr(quote, 1, 200) || '…' ELSE quote END AS quote, coalesce(note, '') AS note FROM a WHERE color IS NOT NULL OR note IS NOT NULL")),
        "screen_intake": (
            lambda x, d: SRC.screen_intake(A.table(x, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("%PDF-"), "text")).otherwise(F.col("text")).cast("binary").alias("content"), (F.col("doc_id") % 400 - 1).cast("int").alias("page_count"))).select("doc_id", "sha256", F.coalesce("reject_code", F.lit("")).alias("reject_code")),
            "SELECT doc_id, sha256(CASE WHEN doc_id % 4 = 0 THEN '%PDF-' || text ELSE text END) AS sha256, CASE WHEN doc_id % 4 > 0 THEN 'NOT_PDF' WHEN doc_id % 400 - 1 < 1 THEN 'MALFORMED_PDF' WHEN doc_id % 400 - 1 > 300 THEN 'RESOURCE_LIMIT' ELSE '' END AS reject_code FROM documents",
        ),
    }
