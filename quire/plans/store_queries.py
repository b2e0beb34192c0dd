"""Queries over what is stored and replaced: bundles, snapshots, extractions, deletion, whole packets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scratch import scratch_dir
from ..operators import cascade as C
from ..operators import packets as K
from ..sources import adapters as A
from ..sources import bundle_store as P
from ..sources import snapshots as SN
from ..sources.adapters_sql import with_tables


def _place(spark, name):
    return f"{scratch_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"


def published_bundles(spark, d):
    """All texts as files of fifty bundles, published in two batches, the first one twice."""
    i = F.col("doc_id")
    files = A.table(spark, d, "documents").select((i % 50).alias("bundle_id"), F.concat(F.lit("texts/"), i.cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    root = _place(spark, "bundles")
    for _ in range(2):
        P.publish_bundles(files.filter("bundle_id % 2 = 0"), root, "first")
    P.publish_bundles(files, root, "second")
    return P.read_manifests(spark, root).select(F.col("bundle_id").cast("long").alias("bundle_id"), "path", "sha256", "size_bytes", "batch")


def merged_snapshot(spark, d):
    """The latest event of each user, from two batches of which the first comes again."""
    e = A.table(spark, d, "events").select("user_id", "event_id", "event_type")
    path = _place(spark, "snapshot")
    first = e.filter("event_id % 3 > 0")
    for batch in (first, e.filter("event_id % 3 = 0"), first):
        SN.merge_snapshot(path, batch, ["user_id"], "event_id")
    return SN.read_snapshot(spark, path).select("user_id", "event_id", "event_type")


def _extraction(spark, d):
    b = A.blocks(spark, d).select("version_id", "page_index", "p", "text")
    current = b.filter("p % 4 <> 3").withColumn("block_id", F.concat_ws("-", "version_id", "p"))
    runs = b.select("version_id").distinct().withColumn("status", F.when(F.col("version_id") % 7 == 0, "FAILED").otherwise("SUCCEEDED"))
    return SN.replace_extraction(current, b.filter("version_id % 3 = 0"), runs).select("version_id", "p", "block_id")


def _tables(spark, d):
    papers = A.papers(spark, d).select("paper_id", "version_id", "title")
    answers = A.answers(spark, d).select("answer_id", "packet_id", "session")
    marks = A.annotations(spark, d).select("annotation_id", F.col("annotation_id").alias("anchor_id"), "version_id")
    tags = A.paper_tags(spark, d)
    version = papers.select("version_id", "paper_id")
    return {
        "papers": papers, "source_versions": version, "paper_tags": tags, "anchors": marks.select("anchor_id", "version_id"), "annotations": marks.select("annotation_id", "anchor_id"),
        "parse_runs": version.select("version_id", F.when(F.col("version_id") % 15 == 0, "RUNNING").otherwise("SUCCEEDED").alias("status")),
        "context_packets": papers.select(F.col("paper_id").alias("packet_id"), F.array(F.struct("paper_id"), F.struct((F.col("paper_id") + 1).alias("paper_id"))).alias("sources")),
        "answers": answers, "chat_threads": answers.select("session").distinct(), "chat_titles": answers.select("session", F.lit("t").alias("title")).distinct(),
        "text_blocks": A.blocks(spark, d).select("version_id", "p"), "tags": tags.select(F.lower("tag").alias("name")).distinct(),
    }


#: A number of each row of a table for its checksum.
CHECKED = {"papers": "paper_id", "source_versions": "version_id", "paper_tags": "paper_id", "anchors": "anchor_id", "annotations": "annotation_id", "parse_runs": "version_id", "context_packets": "packet_id", "answers": "answer_id", "chat_threads": "session", "chat_titles": "session", "text_blocks": "version_id * 1000 + p", "tags": "length(name)", "refused": "paper_id"}


def deleted_papers(spark, d):
    """Rows and checksum of each table after each fifth paper is deleted."""
    tables = _tables(spark, d)
    left, refused = C.delete_papers(tables, tables["papers"].filter("paper_id % 5 = 0"))
    out = None
    for name, df in (left | {"refused": refused}).items():
        row = df.select(F.expr(CHECKED[name]).alias("k")).agg(F.count("*").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("checksum")).select(F.lit(name).alias("name"), "n", "checksum")
        out = row if out is None else out.unionByName(row)
    return out


DELETED_SQL = """busy AS (SELECT paper_id FROM papers WHERE version_id % 15 = 0), gone AS (SELECT paper_id FROM papers WHERE paper_id % 5 = 0 AND paper_id NOT IN (SELECT paper_id FROM busy)),
  gv AS (SELECT version_id FROM papers WHERE paper_id IN (SELECT paper_id FROM gone)), gp AS (SELECT paper_id AS packet_id FROM papers WHERE paper_id IN (SELECT paper_id FROM gone) OR paper_id + 1 IN (SELECT paper_id FROM gone)),
  ga AS (SELECT answer_id, session FROM answers WHERE packet_id IN (SELECT packet_id FROM gp)), pt AS (SELECT * FROM paper_tags WHERE paper_id NOT IN (SELECT paper_id FROM gone)),
  k AS (SELECT 'papers' AS name, paper_id AS k FROM papers WHERE paper_id NOT IN (SELECT paper_id FROM gone) UNION ALL SELECT 'source_versions', version_id FROM papers WHERE version_id NOT IN (SELECT version_id FROM gv)
    UNION ALL SELECT 'paper_tags', paper_id FROM pt UNION ALL SELECT 'anchors', annotation_id FROM annotations WHERE version_id IS NULL OR version_id NOT IN (SELECT version_id FROM gv)
    UNION ALL SELECT 'annotations', annotation_id FROM annotations WHERE version_id IS NULL OR version_id NOT IN (SELECT version_id FROM gv) UNION ALL SELECT 'parse_runs', version_id FROM papers WHERE version_id NOT IN (SELECT version_id FROM gv)
    UNION ALL SELECT 'context_packets', paper_id FROM papers WHERE paper_id NOT IN (SELECT packet_id FROM gp) UNION ALL SELECT 'answers', answer_id FROM answers WHERE answer_id NOT IN (SELECT answer_id FROM ga)
    UNION ALL SELECT DISTINCT 'chat_threads', session FROM answers WHERE session NOT IN (SELECT session FROM ga) UNION ALL SELECT DISTINCT 'chat_titles', session FROM answers WHERE session NOT IN (SELECT session FROM ga)
    UNION ALL SELECT 'text_blocks', version_id * 1000 + p FROM blocks WHERE version_id NOT IN (SELECT version_id FROM gv)
    UNION ALL SELECT 'tags', length(name) FROM (SELECT DISTINCT lower(tag) AS name FROM paper_tags) WHERE name IN (SELECT lower(tag) FROM pt)
    UNION ALL SELECT 'refused', paper_id FROM busy WHERE paper_id % 5 = 0)"""


def _parts(spark, d):
    p = F.col("p")
    role = F.when(p % 3 == 0, "selection").when(p % 3 == 1, "previous_paragraph").otherwise("page_text")
    return A.blocks(spark, d).select(
        F.col("version_id").alias("packet_id"), p.alias("rank"), (F.col("version_id") + p % 2).alias("version_id"), role.alias("role"), "page_index", F.when(p % 4 > 0, F.concat(F.lit("S › "), (p % 4).cast("string"))).alias("section"),
        F.when(p % 8 == 2, F.concat("text", F.lit("\n\nsecond"))).otherwise(F.col("text")).alias("text"), F.col("quality_flags").alias("flags"), (p % 10 == 3).alias("truncated"), F.when(p % 9 == 7, "text_budget").alias("reason"),
    )


PACKET_SQL = """pp AS (SELECT version_id AS packet_id, p AS rank, version_id + p % 2 AS source, CASE p % 3 WHEN 0 THEN 'selection' WHEN 1 THEN 'previous_paragraph' ELSE 'page_text' END AS role, page_index, CASE WHEN p % 4 > 0 THEN 'S › ' || (p % 4) END AS section, CASE WHEN p % 8 = 2 THEN text || chr(10) || chr(10) || 'second' ELSE text END AS text, quality_flags AS flags, p % 10 = 3 AS truncated, p % 9 = 7 AS out FROM blocks),
  ps AS (SELECT packet_id, source, row_number() OVER (PARTITION BY packet_id ORDER BY min(rank)) AS s FROM pp WHERE NOT out GROUP BY packet_id, source),
  pe AS (SELECT pp.*, 'src_' || s AS ref, 'e' || row_number() OVER (PARTITION BY packet_id ORDER BY rank) AS id FROM pp JOIN ps USING (packet_id, source) WHERE NOT out),
  ev AS (SELECT packet_id, count(*) AS n, count(*) FILTER (truncated) AS cut, string_agg('{"evidence_id":"' || id || '","page_index":' || page_index || ',"role":"' || role || '","section":' || coalesce('"' || section || '"', 'null') || ',"source_ref":"' || ref || '","text":' || to_json(text)::VARCHAR || ',"truncated":' || truncated::VARCHAR || '}', ',' ORDER BY rank) AS json,
    string_agg('## ' || id || ' · ' || role || ', p. ' || (page_index + 1) || ' · ' || ref || coalesce(chr(10) || '_' || section || '_', '') || chr(10) || chr(10) || '¶1 ' || replace(text, chr(10) || chr(10) || 'second', chr(10) || chr(10) || '¶2 second') || CASE WHEN truncated THEN chr(10) || chr(10) || '[truncated]' ELSE '' END, chr(10) || chr(10) ORDER BY rank) AS md FROM pe GROUP BY packet_id),
  fl AS (SELECT packet_id, coalesce(list_sort(list_distinct(flatten(list(flags)))), []) AS flags FROM pe GROUP BY packet_id),
  so AS (SELECT packet_id, string_agg('{"source_ref":"src_' || s || '","version_id":' || source || '}', ',' ORDER BY s) AS json, string_agg('- src_' || s || ': ' || source, chr(10) ORDER BY s) AS md FROM ps GROUP BY packet_id),
  ex AS (SELECT packet_id, count(*) AS n, string_agg('{"page_index":' || page_index || ',"reason":"text_budget","role":"' || role || '"}', ',' ORDER BY rank) AS json, string_agg('- ' || role || ', p. ' || (page_index + 1) || ': text_budget', chr(10) ORDER BY rank) AS md FROM pp WHERE out GROUP BY packet_id),
  pk AS (SELECT packet_id, ev.n AS n_evidence, cut AS truncated, coalesce(ex.n, 0) AS excluded, array_to_string(flags, ',') AS flags, ev.md AS evidence_md, so.md AS sources_md, ex.md AS excluded_md,
    sha256('{"evidence":[' || ev.json || '],"flags":[' || array_to_string(list_transform(flags, lambda f: '"' || f || '"'), ',') || '],"limits":{"excluded":' || coalesce(ex.n, 0) || ',"exclusions":[' || coalesce(ex.json, '') || '],"truncated":' || cut || '},"sources":[' || so.json || ']}') AS content_sha256
    FROM ev JOIN fl USING (packet_id) JOIN so USING (packet_id) LEFT JOIN ex USING (packet_id))"""


def store_queries() -> dict:
    return {
        "published_bundles": (published_bundles, "SELECT doc_id % 50 AS bundle_id, 'texts/' || doc_id || '.md' AS path, sha256(text) AS sha256, strlen(text)::BIGINT AS size_bytes, CASE WHEN doc_id % 50 % 2 = 0 THEN 'first' ELSE 'second' END AS batch FROM documents"),
        "merged_snapshot": (merged_snapshot, "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id"),
        "replace_extraction": (
            _extraction,
            with_tables("blocks", more="o AS (SELECT version_id, page_index, text, p, version_id || '-' || p AS block_id, row_number() OVER (PARTITION BY version_id, page_index, text ORDER BY p) AS k FROM blocks WHERE p % 4 <> 3), n AS (SELECT version_id, page_index, text, p, row_number() OVER (PARTITION BY version_id, page_index, text ORDER BY p) AS k FROM blocks WHERE version_id % 3 = 0 AND version_id % 7 <> 0)",
                        body="SELECT version_id, p, block_id FROM o WHERE version_id % 3 <> 0 AND version_id % 7 <> 0 UNION ALL SELECT n.version_id, n.p, coalesce(block_id, 'new-' || n.version_id || '-' || n.p) FROM n LEFT JOIN o USING (version_id, page_index, text, k)"),
        ),
        "delete_papers": (deleted_papers, with_tables("blocks", "papers", "annotations", "answers", "paper_tags", more=DELETED_SQL, body="SELECT n.name, count(k) AS n, coalesce(sum(k), 0)::BIGINT AS checksum FROM (SELECT unnest(" + repr(list(CHECKED)) + ") AS name) n LEFT JOIN k USING (name) GROUP BY n.name")),
        "build_packets": (
            lambda x, d: K.build_packets(_parts(x, d)).select("packet_id", F.size("evidence").cast("long").alias("n_evidence"), F.array_join("flags", ",").alias("flags"), F.col("limits.truncated").cast("long").alias("truncated"), F.col("limits.excluded").cast("long").alias("excluded"), "content_sha256"),
            with_tables("blocks", more=PACKET_SQL, body="SELECT packet_id, n_evidence, flags, truncated, excluded, content_sha256 FROM pk"),
        ),
        "packet_document": (
            lambda x, d: K.packet_document(K.build_packets(_parts(x, d))),
            with_tables("blocks", more=PACKET_SQL, body="SELECT packet_id, concat_ws(chr(10) || chr(10), '# Packet ' || packet_id, evidence_md, '## Limits', 'truncated: ' || truncated || ', excluded: ' || excluded, excluded_md, '## Sources', sources_md, 'sha256: ' || content_sha256) AS markdown FROM pk"),
        ),
    }
