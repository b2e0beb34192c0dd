"""Queries over translation, packets and bundles, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bundles as E
from ..operators import packets as K
from ..operators import structure as S
from ..operators import translation as T
from ..sources import adapters as A
from ..sources.adapters_sql import with_tables
from .structure_queries import HEADS, KIND_BODY, NOT_BODY_SQL, PATHS, REFS, SECTION_BODY

ABBR = ", ".join(f"'{a}'" for a in T.ABBREVIATIONS)
BODY = f"trim(text) <> '' AND NOT {NOT_BODY_SQL}"
#: sent(version_id, p, sentence_no, sentence) of every block.
SENT = rf"""tok AS (
  SELECT version_id, p, t, i, lead(t) OVER (PARTITION BY version_id, p ORDER BY i) AS after FROM (
    SELECT version_id, p, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM (SELECT version_id, p, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ts FROM blocks))
), mk AS (
  SELECT *, regexp_replace(t, '[.!?。！？]["''”’)\]]*$', '') AS core, substr(regexp_extract(t, '[.!?。！？]["''”’)\]]*$'), 1, 1) AS mark FROM tok
), fl AS (
  SELECT *, mark <> '' AND after IS NOT NULL AND NOT regexp_matches(after, '^\p{{Ll}}') AND (mark <> '.' OR NOT (regexp_replace(lower(core), '^[(\["''“‘]+', '') IN ({ABBR}) OR regexp_matches(regexp_replace(lower(core), '^[(\["''“‘]+', ''), '^\p{{L}}$'))) AS ends FROM mk
), sn AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY version_id, p ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS sentence_no FROM fl
), sent AS (
  SELECT version_id, p, sentence_no, string_agg(t, ' ' ORDER BY i) AS sentence FROM sn GROUP BY ALL
), nsent AS (
  SELECT version_id, p, count(*) AS n FROM sent GROUP BY ALL
)"""


def _translated(spark, d):
    t = F.when((F.col("version_id") + F.col("p") + F.col("sentence_no")) % 3 > 0, F.concat(F.lit("t "), "sentence")).otherwise("")
    return T.sentences(A.blocks(spark, d)).withColumn("translation", t)


TRANSLATED = "tr AS (SELECT version_id, p, sentence_no, CASE WHEN (version_id + p + sentence_no) % 3 > 0 THEN 't ' || sentence ELSE '' END AS translation FROM sent)"


def _stored(spark, d):
    b = S.body_blocks(A.blocks(spark, d)).filter("version_id % 3 <> 0 or p % 4 <> 1")
    return b.select("version_id", "page_index", "p", F.col("text").alias("source"), F.size(T.sentence_array(F.col("text"))).alias("n"))


def _requests(spark, d):
    i = F.col("version_id")
    return A.papers(spark, d).select((i * 10).alias("request_id"), "version_id", F.when(i % 4 == 0, "page").when(i % 4 == 1, "paper").when(i % 4 == 2, "until_page").otherwise("around_page").alias("scope"), (i % 3).cast("int").alias("page"))


def _counts(spark, d):
    return A.blocks(spark, d).groupBy("version_id").agg((F.max("page_index") + 1).alias("page_count"))


def _items(spark, d):
    return A.blocks(spark, d).select(F.col("version_id").alias("packet_id"), F.col("p").alias("rank"), (F.col("p") % 6).alias("block_id"), "text")


def _role_items(spark, d):
    """Blocks as selections and context of their version, each with two of a few block ids."""
    roles = F.array(*map(F.lit, ("selection", *K.CONTEXT_ROLES)))
    p = F.col("p")
    return A.blocks(spark, d).select(F.col("version_id").alias("packet_id"), p.alias("rank"), F.get(roles, (p % 6).cast("int")).alias("role"), F.array(p % 5, p % 7).alias("block_ids"), "text")


def _anchors(spark, d):
    name = F.when(F.col("annotation_id") % 5 == 0, F.concat(F.lit("bad name "), F.col("annotation_id").cast("string"))).otherwise(F.concat(F.lit("a"), F.col("annotation_id").cast("string")))
    return A.annotations(spark, d).withColumns({"bundle_id": F.col("version_id") % 50, "name": name})


def _files(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("anchors/", "answers/", "texts/", "assets/"))), (F.col("p") % 4 + 1).cast("int"))
    return A.blocks(spark, d).select(F.col("version_id").alias("bundle_id"), F.concat(kind, F.col("p").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))


FILES = "files AS (SELECT version_id AS bundle_id, (['anchors/', 'answers/', 'texts/', 'assets/'])[p % 4 + 1] || p || '.md' AS path, text AS content, strlen(text)::BIGINT AS size_bytes FROM blocks)"


def text_queries() -> dict:
    b = A.blocks
    return {
        "sentences": (lambda x, d: T.sentences(b(x, d)), with_tables("blocks", more=SENT, body="SELECT * FROM sent")),
        "reuse_translations": (
            lambda x, d: T.reuse_translations(b(x, d), _stored(x, d)),
            with_tables("blocks", more=SENT + f", want AS (SELECT b.version_id, page_index, b.p, text AS source, n, row_number() OVER (PARTITION BY b.version_id, page_index, text ORDER BY b.p) AS k FROM blocks b JOIN nsent s ON b.version_id = s.version_id AND b.p = s.p WHERE {BODY}), have AS (SELECT version_id, page_index, source, n AS have, row_number() OVER (PARTITION BY version_id, page_index, source ORDER BY p) AS k FROM want WHERE version_id % 3 <> 0 OR p % 4 <> 1)", body="SELECT version_id, page_index, bool_and(coalesce(have = n, false)) AS reused FROM want LEFT JOIN have USING (version_id, page_index, source, k) GROUP BY ALL"),
        ),
        "validate_translations": (
            lambda x, d: T.validate_translations(b(x, d), _stored(x, d).select("version_id", (F.col("p") + F.when(F.col("p") % 9 == 0, 1000).otherwise(0)).alias("p"), (F.col("n") + F.when(F.col("p") % 7 == 1, 1).otherwise(0)).alias("n"))),
            with_tables("blocks", more=SENT + f", want AS (SELECT b.version_id, b.p, n AS want FROM blocks b JOIN nsent s ON b.version_id = s.version_id AND b.p = s.p WHERE {BODY}), have AS (SELECT version_id, p + CASE WHEN p % 9 = 0 THEN 1000 ELSE 0 END AS p, want + CASE WHEN p % 7 = 1 THEN 1 ELSE 0 END AS n FROM want WHERE version_id % 3 <> 0 OR p % 4 <> 1)", body="SELECT * FROM (SELECT version_id, p, CASE WHEN n IS NULL THEN 'missing' WHEN want IS NULL THEN 'unknown' WHEN n <> want THEN 'count' END AS problem FROM want FULL JOIN have USING (version_id, p)) WHERE problem IS NOT NULL"),
        ),
        "continued_blocks": (
            lambda x, d: T.continued_blocks(b(x, d).withColumn("text", F.when(F.col("p") % 2 == 1, F.lower("text")).otherwise(F.concat("text", F.lit(" and")))).withColumn("quality_flags", F.when(F.col("p") % 13 == 5, F.array(F.lit("math"))).otherwise(F.array().cast("array<string>")))),
            with_tables("blocks", more="cb AS (SELECT version_id, p, CASE WHEN p % 2 = 1 THEN lower(text) ELSE text || ' and' END AS text, CASE WHEN p % 13 = 5 THEN ['math'] ELSE []::VARCHAR[] END AS quality_flags FROM blocks), " + SENT.replace("FROM blocks", "FROM cb") + rf""",
              mp AS (SELECT *, max(CASE WHEN list_contains(quality_flags, 'math') THEN p END) OVER (PARTITION BY version_id ORDER BY p) AS math_p FROM cb), bb AS (SELECT *, lag(text) OVER w AS was, lag(p) OVER w AS was_p FROM mp WHERE trim(text) <> '' AND NOT {NOT_BODY_SQL} WINDOW w AS (PARTITION BY version_id ORDER BY p))""",
                        body=r"""SELECT b.version_id, b.p, was_p FROM bb b JOIN sent s ON s.version_id = b.version_id AND s.p = b.p AND s.sentence_no = 0 WHERE NOT regexp_matches(trim(was), '[.!?。！？]["''”’)\]]*$') AND NOT regexp_matches(was, '^(?:Fig\.|Figure|Table) +\d+') AND coalesce(math_p, -1) < was_p AND regexp_matches(b.text, '^\p{Ll}') AND 2 * length(sentence) <= length(was)"""),
        ),
        "sentence_groups": (
            lambda x, d: T.sentence_groups(_translated(x, d)),
            with_tables("blocks", more=SENT + ", " + TRANSLATED + ", g AS (SELECT *, sum(CASE WHEN translation <> '' OR k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY version_id, p ORDER BY sentence_no) AS grp FROM (SELECT *, row_number() OVER (PARTITION BY version_id, p ORDER BY sentence_no) AS k FROM tr))", body="SELECT version_id, p, grp::BIGINT AS grp, min(sentence_no) AS first_no, max(sentence_no) AS last_no, arg_min(translation, sentence_no) AS translation FROM g GROUP BY version_id, p, grp"),
        ),
        "translated_pages": (
            lambda x, d: T.translated_pages(b(x, d).withColumn("language", F.when(F.col("p") % 2 == 0, "en").otherwise("ko"))),
            with_tables("blocks", body="SELECT version_id, CASE WHEN p % 2 = 0 THEN 'en' ELSE 'ko' END AS language, count(DISTINCT page_index) AS n, string_agg(DISTINCT page_index::VARCHAR, ',' ORDER BY page_index) AS pages FROM blocks GROUP BY 1, 2").replace("string_agg(DISTINCT page_index::VARCHAR, ',' ORDER BY page_index)", "array_to_string(list_sort(list_distinct(list(page_index))), ',')"),
        ),
        "scope_pages": (
            lambda x, d: K.scope_pages(_requests(x, d), _counts(x, d), S.reference_pages(b(x, d))),
            with_tables("blocks", more=REFS + ", c AS (SELECT version_id, max(page_index) + 1 AS n FROM blocks GROUP BY 1), r AS (SELECT version_id, n, (version_id % 3)::INT AS page, version_id % 4 AS k FROM c), ok AS (SELECT * FROM r WHERE k IN (1, 2) OR page < n), pg AS (SELECT DISTINCT version_id, page_index FROM blocks UNION SELECT version_id, unnest(range(n)) FROM c)",
                        body="SELECT DISTINCT version_id * 10 AS request_id, version_id, page_index::INT AS page_index FROM ok JOIN pg USING (version_id) WHERE page_index < n AND (k = 1 OR (k = 0 AND page_index = page) OR (k = 2 AND page_index <= page) OR (k = 3 AND abs(page_index - page) <= 1)) UNION SELECT version_id * 10, version_id, unnest(range(a, b + 1))::INT FROM ok JOIN (SELECT version_id, min(page_index) AS a, max(page_index) AS b FROM refs GROUP BY 1) USING (version_id) WHERE k IN (2, 3)"),
        ),
        "page_text_evidence": (
            lambda x, d: K.page_text_evidence(b(x, d), 1500).fillna("", ["text"]),
            with_tables("blocks", more="g AS (SELECT version_id, page_index, string_agg(text, chr(10) || chr(10) ORDER BY p) AS text FROM blocks WHERE page_index = 0 OR NOT (y1 <= 0.1 OR y0 >= 0.9) GROUP BY ALL), u AS (SELECT *, 1500 - coalesce(sum(length(text)) OVER (PARTITION BY version_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM g), f AS (SELECT *, lag(room > 0) OVER (PARTITION BY version_id ORDER BY page_index) AS was FROM u)",
                        body="SELECT version_id, page_index, CASE WHEN room > 0 THEN substr(text, 1, room::INT) ELSE '' END AS text, room > 0 AND length(text) > room AS truncated, room <= 0 AS excluded, CASE WHEN room <= 0 THEN 0 ELSE len(string_split(substr(text, 1, room::INT), chr(10) || chr(10))) END::INT AS paragraphs FROM f WHERE room > 0 OR was"),
        ),
        "apply_budget": (
            lambda x, d: K.apply_budget(_items(x, d), 600).fillna("", ["reason"]),
            with_tables("blocks", more="""i AS (SELECT version_id, p, (p % 6)::BIGINT AS block_id, length(text) AS n FROM blocks), w AS (
              SELECT version_id, -1 AS p, 600::BIGINT AS room, []::BIGINT[] AS used, false AS kept, '' AS reason FROM (SELECT DISTINCT version_id FROM i)
              UNION ALL SELECT i.version_id, i.p, CASE WHEN list_contains(used, block_id) OR n > room THEN room ELSE room - n END, CASE WHEN list_contains(used, block_id) OR n > room THEN used ELSE list_append(used, block_id) END,
                NOT list_contains(used, block_id) AND n <= room, CASE WHEN list_contains(used, block_id) THEN 'repeated' WHEN n > room THEN 'text_budget' ELSE '' END FROM w JOIN i ON i.version_id = w.version_id AND i.p = w.p + 1)""", body="SELECT version_id AS packet_id, p AS rank, kept, reason FROM w WHERE p >= 0"),
        ),
        "apply_role_budget": (
            lambda x, d: K.apply_role_budget(_role_items(x, d), 900).fillna("", ["reason"]).select("packet_id", "rank", "chars", "kept", "reason"),
            with_tables("blocks", more="""i AS (SELECT version_id, p, (p % 6 + 1)::INT AS o, p % 5 AS a, p % 7 AS b, length(text) AS n FROM blocks), k AS (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY o, p) AS k FROM i), w AS (
              SELECT version_id, 0::BIGINT AS k, 900::BIGINT AS room, []::BIGINT[] AS used, -1 AS p, 0::BIGINT AS chars, false AS kept, '' AS reason FROM (SELECT DISTINCT version_id FROM i)
              UNION ALL SELECT k.version_id, k.k, CASE WHEN o = 1 THEN room - least(n, room) WHEN list_has_any(used, [a, b]) OR n > room THEN room ELSE room - n END, CASE WHEN o = 1 OR list_has_any(used, [a, b]) OR n > room THEN used ELSE list_concat(used, [a, b]) END, k.p,
                CASE WHEN o = 1 THEN least(n, room) WHEN list_has_any(used, [a, b]) OR n > room THEN 0 ELSE n END, o = 1 OR (NOT list_has_any(used, [a, b]) AND n <= room), CASE WHEN o > 1 AND NOT list_has_any(used, [a, b]) AND n > room THEN 'text_budget' ELSE '' END FROM w JOIN k ON k.version_id = w.version_id AND k.k = w.k + 1)""", body="SELECT version_id AS packet_id, p AS rank, chars::INT AS chars, kept, reason FROM w WHERE k > 0"),
        ),
        "math_like": (
            lambda x, d: A.annotations(x, d).filter(K.is_math_like(F.when(F.col("annotation_id") % 7 == 1, F.concat("quote", F.lit(" ∑α"))).otherwise(F.col("quote")), F.col("display_quote"))).select("annotation_id"),
            with_tables("annotations", body="SELECT annotation_id FROM annotations WHERE display_quote IS NOT NULL OR annotation_id % 7 = 1"),
        ),
        "image_candidates": (
            lambda x, d: K.image_quota(K.image_candidates(A.annotations(x, d).select(F.col("version_id").alias("packet_id"), F.col("annotation_id").alias("rank"), F.col("annotation_id").alias("anchor_id"), "kind", "quote", "display_quote"), A.annotations(x, d).select(F.col("annotation_id").alias("anchor_id"), (F.col("annotation_id") % 9 == 4).alias("unreadable")))),
            with_tables("annotations", body="SELECT version_id AS packet_id, annotation_id AS rank, row_number() OVER (PARTITION BY version_id ORDER BY annotation_id) <= 2 AS image FROM annotations WHERE kind = 'region' OR display_quote IS NOT NULL OR annotation_id % 9 = 4"),
        ),
        "image_quota": (
            lambda x, d: K.image_quota(_items(x, d).withColumn("eligible", F.col("rank") % 3 == 1)),
            with_tables("blocks", body="SELECT version_id AS packet_id, p AS rank, row_number() OVER (PARTITION BY version_id ORDER BY p) <= 2 AS image FROM blocks WHERE p % 3 = 1"),
        ),
        "number_evidence": (
            lambda x, d: K.number_evidence(b(x, d).select((F.col("version_id") % 100).alias("packet_id"), (F.col("version_id") * 1000 + F.col("p")).alias("rank"), "version_id")),
            with_tables("blocks", more="r AS (SELECT version_id % 100 AS packet_id, version_id * 1000 + p AS rank, version_id FROM blocks), f AS (SELECT *, min(rank) OVER (PARTITION BY packet_id, version_id) AS first FROM r)", body="SELECT packet_id, rank, 'e' || row_number() OVER (PARTITION BY packet_id ORDER BY rank) AS evidence_id, 'src_' || dense_rank() OVER (PARTITION BY packet_id ORDER BY first) AS source_ref FROM f"),
        ),
        "packet_markdown": (
            lambda x, d: K.packet_markdown(b(x, d).select(F.col("version_id").alias("packet_id"), F.col("p").alias("rank"), F.concat(F.lit("e"), (F.col("p") + 1).cast("string")).alias("evidence_id"), "page_index", "text")),
            with_tables("blocks", body="SELECT version_id AS packet_id, '# Packet ' || version_id || chr(10) || chr(10) || string_agg('## e' || (p + 1) || ' p.' || (page_index + 1) || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY p) AS markdown FROM blocks GROUP BY version_id"),
        ),
        "content_sha256": (lambda x, d: K.content_sha256(A.papers(x, d).select("paper_id", "owner_id", "doi"), ["paper_id", "owner_id", "doi"]).select("paper_id", "content_sha256"), with_tables("papers", body="""SELECT paper_id, sha256('{"doi":' || CASE WHEN doi IS NULL THEN 'null' ELSE '"' || doi || '"' END || ',"owner_id":"' || owner_id || '","paper_id":' || paper_id || '}') AS content_sha256 FROM papers""")),
        "validate_selection": (
            lambda x, d: E.validate_selection(A.annotations(x, d).select((F.col("annotation_id") % 200).alias("request_id"), (F.col("version_id") + F.when(F.col("annotation_id") % 11 == 0, 1).otherwise(0)).alias("version_id"), (F.col("annotation_id") + F.when(F.col("annotation_id") % 13 == 0, 10**9).otherwise(0)).alias("anchor_id")), A.papers(x, d), A.annotations(x, d)),
            with_tables("papers", "annotations", more="r AS (SELECT annotation_id % 200 AS request_id, version_id + CASE WHEN annotation_id % 11 = 0 THEN 1 ELSE 0 END AS version_id, annotation_id + CASE WHEN annotation_id % 13 = 0 THEN 1000000000 ELSE 0 END AS anchor_id FROM annotations), j AS (SELECT r.*, p.version_id IS NOT NULL AS known, a.version_id AS av, count(*) OVER (PARTITION BY request_id, r.version_id) > 1 AS twice FROM r LEFT JOIN papers p ON r.version_id = p.version_id LEFT JOIN annotations a ON r.anchor_id = a.annotation_id)", body="SELECT * FROM (SELECT request_id, version_id, anchor_id, CASE WHEN NOT known OR av IS NULL THEN 'NOT_FOUND' WHEN av <> version_id THEN 'anchor_other_version' WHEN twice THEN 'duplicate_version' END AS reason FROM j) WHERE reason IS NOT NULL"),
        ),
        "unselected_sources": (
            lambda x, d: E.unselected_sources(A.answers(x, d).select((F.col("answer_id") % 20).alias("request_id"), F.get(F.array(*map(F.lit, ("answer", "artifact", "proposal"))), (F.col("answer_id") % 3).cast("int")).alias("kind"), F.col("answer_id").alias("position"), F.array("session", F.col("session") + 7, F.col("session") + 13).alias("versions")), A.papers(x, d).select((F.col("version_id") % 20).alias("request_id"), "version_id").filter("version_id % 3 > 0")),
            with_tables("answers", body="SELECT request_id, kind, position, kind || '_version_not_selected' AS reason FROM (SELECT answer_id % 20 AS request_id, (['answer', 'artifact', 'proposal'])[answer_id % 3 + 1] AS kind, answer_id AS position, session FROM answers) WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id % 3 > 0 AND doc_id % 20 = request_id AND doc_id IN (session, session + 7, session + 13))"),
        ),
        "invalid_ranges": (
            lambda x, d: E.invalid_ranges(A.papers(x, d).select((F.col("version_id") % 20).alias("request_id"), "version_id", F.lit(0).alias("position"), (F.col("version_id") % 4 - 1).alias("first"), (F.col("version_id") % 7).alias("last")), _counts(x, d)),
            with_tables("blocks", more="c AS (SELECT version_id, max(page_index) + 1 AS n FROM blocks GROUP BY 1)", body="SELECT version_id % 20 AS request_id, version_id, 0 AS position, 'invalid_range' AS reason FROM c WHERE NOT (version_id % 4 - 1 >= 0 AND version_id % 4 - 1 <= version_id % 7 AND version_id % 7 < n)"),
        ),
        "auto_anchors": (
            lambda x, d: E.auto_anchors(A.annotations(x, d).select((F.col("annotation_id") % 100).alias("bundle_id"), (F.col("annotation_id") % 700).alias("anchor_id"), F.when(F.col("annotation_id") % 3 == 0, "linked_by_proposal").otherwise("cited_by_answer").alias("reason")), A.annotations(x, d).filter("annotation_id % 17 = 0").select((F.col("annotation_id") % 100).alias("bundle_id"), (F.col("annotation_id") % 700).alias("anchor_id")).distinct()),
            with_tables("annotations", body="SELECT annotation_id % 100 AS bundle_id, annotation_id % 700 AS anchor_id, CASE WHEN bool_or(annotation_id % 3 = 0) THEN 'linked_by_proposal' ELSE 'cited_by_answer' END AS reason FROM annotations GROUP BY 1, 2 HAVING NOT bool_or(annotation_id % 17 = 0)"),
        ),
        "bundle_text_pages": (
            lambda x, d: E.bundle_text_pages(_counts(x, d).select(F.col("version_id").alias("bundle_id"), F.get(F.array(*map(F.lit, ("all", "anchor_pages", "none", "ranges"))), (F.col("version_id") % 4).cast("int")).alias("mode"), "page_count", F.lit(0).alias("anchor_page"), F.array(F.struct(F.lit(0).alias("first"), F.lit(1).alias("last")), F.struct(F.lit(1).alias("first"), (F.col("version_id") % 5).cast("int").alias("last"))).alias("ranges"))),
            with_tables("blocks", more="c AS (SELECT version_id, max(page_index) + 1 AS n FROM blocks GROUP BY 1)", body="SELECT version_id AS bundle_id, unnest(range(n))::INT AS page_index FROM c WHERE version_id % 4 = 0 UNION ALL SELECT version_id, 0 FROM c WHERE version_id % 4 = 1 UNION ALL SELECT DISTINCT version_id, unnest(list_concat(range(0, least(1, n - 1) + 1), range(1, least(version_id % 5, n - 1) + 1)))::INT FROM c WHERE version_id % 4 = 3"),
        ),
        "bundle_refs": (
            lambda x, d: E.bundle_refs(_anchors(x, d)),
            with_tables("annotations", more="a AS (SELECT *, version_id % 50 AS bundle_id, annotation_id % 5 = 0 AS bad FROM annotations)", body="SELECT bundle_id, annotation_id, 'src_' || dense_rank() OVER (PARTITION BY bundle_id ORDER BY version_id) AS source_ref, 'anc_' || row_number() OVER w AS anchor_ref, CASE WHEN bad THEN 'n' || substr(lpad(sum(bad::INT) OVER w::VARCHAR, 3, '0'), 1, 3) ELSE 'a' || annotation_id END AS file_name FROM a WINDOW w AS (PARTITION BY bundle_id ORDER BY version_id, page_index, v, u, annotation_id)"),
        ),
        "bundle_totals": (
            lambda x, d: E.bundle_totals(_files(x, d).withColumn("size_bytes", F.octet_length("content"))),
            with_tables("blocks", more=FILES, body="SELECT bundle_id, count(*) AS files, sum(size_bytes)::BIGINT AS bytes, arg_max(path, (size_bytes, path)) AS largest, " + ", ".join(f"count(*) FILTER (starts_with(path, '{k}/')) AS {k}" for k in ("anchors", "proposals", "answers", "assets", "texts", "artifacts")) + " FROM files GROUP BY 1"),
        ),
        "bundle_manifest": (
            lambda x, d: E.bundle_manifest(_files(x, d)),
            with_tables("blocks", more=FILES + ", t AS (SELECT bundle_id, count(*) AS n, max(size_bytes) AS most, sum(size_bytes) AS total FROM files GROUP BY 1)", body="SELECT bundle_id, path, sha256(content) AS sha256, size_bytes, CASE WHEN n > 64 OR most > 8388608 OR total > 33554432 THEN 'over_limit' WHEN n > 51.2 OR total > 26843545.6 THEN 'near_limit' ELSE 'ok' END AS state FROM files JOIN t USING (bundle_id)"),
        ),
        "bundle_texts": (
            lambda x, d: E.bundle_texts(b(x, d), S.block_kind(b(x, d), S.headings(b(x, d))), S.section_paths(b(x, d), S.headings(b(x, d)))),
            with_tables("blocks", more=HEADS + ", " + REFS + ", " + PATHS + f", kk AS ({KIND_BODY}), ss AS ({SECTION_BODY}), dd AS (SELECT version_id, page_index, string_agg(p || '|' || kind || '|' || coalesce(section, '') || '|' || text, chr(10) ORDER BY p) AS document FROM blocks JOIN kk USING (version_id, p) JOIN ss USING (version_id, p) GROUP BY ALL)", body="SELECT *, sha256(document) AS sha256 FROM dd"),
        ),
        "bundle_documents": (lambda x, d: E.bundle_documents(A.answers(x, d)), with_tables("answers", body="SELECT answer_id, '# Answer ' || answer_id || chr(10) || substr(coalesce(prompt, ''), 1, 200) || chr(10) || '````' || chr(10) || markdown || chr(10) || '````' AS document FROM answers")),
        "list_bundles": (lambda x, d: E.list_bundles(A.annotations(x, d).select(F.col("annotation_id").alias("bundle_id"), "created_at"), 50).select("bundle_id", F.unix_timestamp("created_at").alias("created_s")), with_tables("annotations", body="SELECT annotation_id AS bundle_id, floor(epoch(created_at))::BIGINT AS created_s FROM annotations ORDER BY created_at DESC, annotation_id LIMIT 50")),
    }
