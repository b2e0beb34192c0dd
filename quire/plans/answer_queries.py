"""Queries over artifacts, answers by filter, contexts, spans, batches and warnings, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers as N
from ..operators import artifacts as AR
from ..operators import bundles as E
from ..operators import structure as S
from ..operators import threads as H
from ..operators import translation as T
from ..sources import adapters as A
from ..sources.adapters_sql import with_tables
from .more_queries import _box_anchors
from .structure_queries import NOT_BODY_SQL
from .text_queries import SENT
from .thread_queries import _expected


def _with_artifacts(x, d):
    """Answers that hold a block of one of five shapes, by session."""
    k = F.col("session").cast("string")
    text = (
        F.when(F.col("session") % 5 == 0, F.concat(F.lit('x\n```artifact type="html" title=" T '), k, F.lit('"\n<p>\n  '), k, F.lit("</p>\n```\nend")))
        .when(F.col("session") % 5 == 1, F.concat(F.lit("  ~~~svg\n   <svg >"), k, F.lit("</svg>\n```\n~~~~")))
        .when(F.col("session") % 5 == 2, F.concat(F.lit('````artifact language="python" type="code"\n```\n'), k, F.lit("\n```")))
        .when(F.col("session") % 5 == 3, F.concat(F.lit("```HTML\n<!DOCTYPE html><Title> N "), k, F.lit(" </title>\n```\n```artifact type=\"x\"\n```")))
        .otherwise(F.concat(F.lit("```python\n"), k, F.lit("\n```\n    ```svg\n<svg>")))
    )
    return A.answers(x, d).withColumn("markdown", text)


ARTIFACT_SQL = """(SELECT answer_id, session % 5 AS m, session::VARCHAR AS k FROM answers)"""


def _packets(x, d):
    return A.papers(x, d).select(F.col("paper_id").alias("packet_id"), F.array(F.struct((F.col("paper_id") % 7).alias("paper_id")), F.struct((F.col("paper_id") % 5).alias("paper_id"))).alias("sources"))


def _found_answers(x, d):
    answers = A.answers(x, d).withColumn("connection_id", F.col("session") % 4)
    images = answers.filter("turn % 3 = 1").select("answer_id", F.explode(F.sequence(F.lit(0), (F.col("session") % 3).cast("int"))).alias("position"))
    connections = answers.select("connection_id").distinct().filter("connection_id > 0").withColumn("name", F.concat(F.lit("c"), F.col("connection_id").cast("string")))
    return N.find_answers(answers, images, connections, origin="chat", paper=3, packets=_packets(x, d)).select("answer_id", "packet_id", "session", "created_s", F.coalesce("connection", F.lit("")).alias("connection"), "images", "position")


def _selections(x, d):
    return _box_anchors(x, d).withColumn("quote", F.repeat(F.lit("x"), (F.col("anchor_id") % 900).cast("int")))


def _half(x, d):
    """Blocks of two thirds of the versions."""
    return A.blocks(x, d).filter("version_id % 3 < 2")


SELECTED = f"""ba AS (SELECT annotation_id AS anchor_id, version_id, page_index % 4 AS page_index, 0.2::DOUBLE AS a0, v * 0.9::DOUBLE AS b0, 0.6::DOUBLE AS a1, v * 0.9::DOUBLE + 0.04::DOUBLE AS b1, annotation_id % 900 AS quoted FROM annotations), hb AS (SELECT * FROM blocks WHERE version_id % 3 < 2),
  u AS (SELECT anchor_id, version_id, p, length(text) AS n, quoted FROM ba JOIN hb USING (version_id, page_index) WHERE greatest(0, least(x1, a1) - greatest(x0, a0)) * greatest(0, least(y1, b1) - greatest(y0, b0)) >= 0.5::DOUBLE * ((a1 - a0) * (b1 - b0))),
  sp AS (SELECT anchor_id, version_id, min(p) AS first, max(p) AS last, sum(n) AS n, any_value(quoted) AS quoted FROM u GROUP BY 1, 2),
  nb AS (SELECT version_id, p, CASE WHEN page_index - lag(page_index) OVER w <= 2 THEN lag(p) OVER w END AS before, CASE WHEN lead(page_index) OVER w - page_index <= 2 THEN lead(p) OVER w END AS after FROM hb WHERE NOT {NOT_BODY_SQL} AND trim(text) <> '' WINDOW w AS (PARTITION BY version_id, font_size ORDER BY p))"""


def _warnings(x, d):
    b = A.blocks(x, d)
    pages = b.select((F.col("version_id") % 20).alias("bundle_id"), "version_id", "page_index", ((F.col("version_id") % 9 > 0) & (F.col("page_index") % 4 < 3)).alias("extracted")).distinct()
    marks = A.annotations(x, d).select((F.col("version_id") % 20).alias("bundle_id"), "version_id", "kind", F.when(F.col("annotation_id") % 10 > 0, F.col("quote")).alias("quote"), (F.col("annotation_id") % 2 == 0).alias("has_image"))
    cites = N.extract_citations(A.answers(x, d)).select((F.col("answer_id") % 20).alias("bundle_id"), "answer_id", "number", "pos", (F.col("number") < 4).alias("resolved"))
    files = b.groupBy((F.col("version_id") % 20).alias("bundle_id"), "page_index").agg(F.sum(F.length("text")).alias("size_bytes"))
    files = files.withColumn("state", F.when(F.col("bundle_id") % 3 == 0, "over_limit").when(F.col("bundle_id") % 3 == 1, "near_limit").otherwise("ok"))
    return E.bundle_warnings(pages, marks, cites, files).select("bundle_id", "code", F.coalesce("subject", F.lit("")).alias("subject"), "detail")


WARNING_SQL = r"""pg AS (SELECT DISTINCT version_id % 20 AS bundle_id, version_id, page_index, version_id % 9 > 0 AND page_index % 4 < 3 AS extracted FROM blocks),
  pm AS (SELECT bundle_id, version_id, string_agg((page_index + 1)::VARCHAR, ', ' ORDER BY page_index) FILTER (NOT extracted) AS gone, count(*) FILTER (NOT extracted) AS n, bool_and(NOT extracted) AS every FROM pg GROUP BY 1, 2),
  am AS (SELECT version_id % 20 AS bundle_id, version_id, count(*) FILTER (kind <> 'text' AND annotation_id % 2 <> 0) AS regions, count(*) FILTER (kind = 'text' AND (annotation_id % 10 = 0 OR quote = '')) AS empty FROM annotations GROUP BY 1, 2),
  cl AS (SELECT answer_id, unnest(list_transform(flatten(list_transform(regexp_extract_all(markdown, '\[cite ([^\[\]]*)\]', 1), lambda g: regexp_split_to_array(g, ', *'))), lambda i, k: {'k': k, 'n': try_cast(regexp_extract(i, '^(?:\w+ )?(\d+)', 1) AS INT)})) AS c FROM answers),
  cf AS (SELECT answer_id, c.n AS number, min(c.k) AS pos FROM cl WHERE c.n IS NOT NULL AND c.n >= 4 GROUP BY 1, 2),
  fm AS (SELECT version_id % 20 AS bundle_id, page_index, sum(length(text)) AS size_bytes FROM blocks GROUP BY 1, 2)"""
WARNING_BODY = """SELECT bundle_id, 'pages_not_extracted' AS code, version_id::VARCHAR AS subject, gone AS detail FROM pm WHERE n > 0 UNION ALL SELECT bundle_id, 'TEXT_NOT_READY', version_id::VARCHAR, n::VARCHAR FROM pm WHERE every
  UNION ALL SELECT bundle_id, 'region_without_image', version_id::VARCHAR, regions::VARCHAR FROM am WHERE regions > 0 UNION ALL SELECT bundle_id, 'empty_quote', version_id::VARCHAR, empty::VARCHAR FROM am WHERE empty > 0
  UNION ALL SELECT answer_id % 20, 'unresolved_answer_citation', answer_id::VARCHAR, string_agg(number::VARCHAR, ', ' ORDER BY pos) FROM cf GROUP BY answer_id
  UNION ALL SELECT bundle_id, CASE bundle_id % 3 WHEN 0 THEN 'over_limit' ELSE 'near_limit' END, '', count(*) || ' files, ' || sum(size_bytes)::BIGINT || ' bytes' FROM fm WHERE bundle_id % 3 < 2 GROUP BY bundle_id"""

#: All cuts of each page's blocks into its number of batches; the least largest batch, then the earliest cuts, win.
BATCH_SQL = f"""pb AS (SELECT version_id, page_index, list(length(text) ORDER BY p) AS ns, list(p ORDER BY p) AS ps FROM blocks WHERE trim(text) <> '' AND NOT {NOT_BODY_SQL} GROUP BY 1, 2),
  pk AS (SELECT *, len(ns) AS n, greatest(1, least(4, list_sum(ns)::BIGINT // 600, len(ns))) AS k FROM pb), c AS (SELECT unnest([1, 2, 3, 4, 99]) AS c),
  cc AS (SELECT pk.*, x.c AS c1, y.c AS c2, z.c AS c3 FROM pk, c x, c y, c z WHERE CASE WHEN k > 1 THEN x.c < n ELSE x.c = 99 END AND CASE WHEN k > 2 THEN y.c > x.c AND y.c < n ELSE y.c = 99 END AND CASE WHEN k > 3 THEN z.c > y.c AND z.c < n ELSE z.c = 99 END),
  cw AS (SELECT *, greatest(list_sum(ns[1:c1]), coalesce(list_sum(ns[c1 + 1:c2]), 0), coalesce(list_sum(ns[c2 + 1:c3]), 0), coalesce(list_sum(ns[c3 + 1:]), 0))::BIGINT AS worst FROM cc),
  cb AS (SELECT version_id, page_index, any_value(ps) AS ps, arg_min({{'w': worst, 'c1': c1, 'c2': c2, 'c3': c3}}, (worst, c1, c2, c3)) AS b FROM cw GROUP BY 1, 2),
  ch AS (SELECT version_id, page_index, b, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM cb), was AS (SELECT version_id, p, lag(text) OVER (PARTITION BY version_id ORDER BY p) AS was FROM blocks WHERE trim(text) <> '' AND NOT {NOT_BODY_SQL})"""


def answer_queries() -> dict:
    return {
        "artifacts": (
            lambda x, d: AR.artifacts(_with_artifacts(x, d)).select("answer_id", "number", "kind", "title", F.coalesce("language", F.lit("")).alias("language"), "content", "first", "last"),
            with_tables("answers", body=f"""SELECT answer_id, 0 AS number, (['html', 'svg', 'code', 'html'])[m + 1] AS kind, CASE m WHEN 0 THEN 'T ' || k WHEN 1 THEN '그림' WHEN 2 THEN '코드' ELSE 'N ' || k END AS title, CASE m WHEN 2 THEN 'python' ELSE '' END AS language,
              CASE m WHEN 0 THEN '<p>' || chr(10) || '  ' || k || '</p>' WHEN 1 THEN ' <svg >' || k || '</svg>' || chr(10) || '```' WHEN 2 THEN '```' || chr(10) || k || chr(10) || '```' ELSE '<!DOCTYPE html><Title> N ' || k || ' </title>' END AS content, CASE m WHEN 0 THEN 1 ELSE 0 END AS first, CASE m WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 2 END AS last FROM {ARTIFACT_SQL} WHERE m < 4"""),
        ),
        "without_artifacts": (
            lambda x, d: AR.without_artifacts(_with_artifacts(x, d)),
            with_tables("answers", body=f"""SELECT answer_id, CASE m WHEN 0 THEN 'x' || chr(10) || '[artifact: T ' || k || ']' || chr(10) || 'end' WHEN 1 THEN '[artifact: 그림]' WHEN 2 THEN '[artifact: 코드]' WHEN 3 THEN '[artifact: N ' || k || ']' || chr(10) || '```artifact type="x"' || chr(10) || '```' ELSE '```python' || chr(10) || k || chr(10) || '```' || chr(10) || '    ```svg' || chr(10) || '<svg>' END AS markdown FROM {ARTIFACT_SQL}"""),
        ),
        "find_answers": (
            _found_answers,
            with_tables("answers", "papers", body="SELECT answer_id, packet_id, session, epoch(created_at)::BIGINT AS created_s, CASE WHEN session % 4 > 0 THEN 'c' || session % 4 ELSE '' END AS connection, CASE WHEN turn % 3 = 1 THEN session % 3 + 1 ELSE 0 END AS images, row_number() OVER (PARTITION BY session ORDER BY created_at DESC, answer_id)::INT AS position FROM answers WHERE discarded_at IS NULL AND origin = 'chat' AND packet_id IN (SELECT paper_id FROM papers WHERE paper_id % 7 = 3 OR paper_id % 5 = 3)"),
        ),
        "text_selection_context": (
            lambda x, d: H.text_selection_context(_selections(x, d), _half(x, d), S.neighbours(_half(x, d))).select("anchor_id", "role", F.coalesce("p", F.lit(-1)).alias("p"), F.coalesce("reason", F.lit("")).alias("reason")),
            with_tables("blocks", "annotations", more=SELECTED, body="SELECT u.anchor_id, 'containing_paragraph' AS role, u.p, '' AS reason FROM u JOIN sp USING (anchor_id) WHERE sp.quoted < 0.9::DOUBLE * sp.n UNION ALL SELECT anchor_id, 'previous_paragraph', before, '' FROM sp JOIN nb ON sp.version_id = nb.version_id AND first = p WHERE before IS NOT NULL UNION ALL SELECT anchor_id, 'following_paragraph', after, '' FROM sp JOIN nb ON sp.version_id = nb.version_id AND last = p WHERE after IS NOT NULL UNION ALL SELECT anchor_id, 'context', -1, CASE WHEN version_id IN (SELECT version_id FROM hb) THEN 'no_extracted_text' ELSE 'text_not_extracted' END FROM ba WHERE anchor_id NOT IN (SELECT anchor_id FROM sp)"),
        ),
        "sentence_spans": (
            lambda x, d: T.sentence_spans(A.blocks(x, d).withColumn("text", F.concat(F.lit(" "), F.regexp_replace("text", " ", "  ")))),
            with_tables("blocks", more=SENT + ", ln AS (SELECT version_id, p, sentence_no, sentence, coalesce(sum(len(string_split(sentence, ' ')) + length(sentence) + 1) OVER (PARTITION BY version_id, p ORDER BY sentence_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM sent)", body='SELECT version_id, p, sentence_no, (1 + used)::INT AS start, (used + length(sentence) + len(string_split(sentence, \' \')))::INT AS "end", sentence FROM ln'),
        ),
        "translation_batches": (
            lambda x, d: T.translation_batches(A.blocks(x, d)).withColumn("context", F.coalesce("context", F.lit(""))),
            with_tables("blocks", more=BATCH_SQL, body="SELECT version_id, page_index, p, ((i > b.c1)::INT + (i > b.c2)::INT + (i > b.c3)::INT) AS batch, b.w AS largest, CASE WHEN i = 1 OR i - 1 IN (b.c1, b.c2, b.c3) THEN coalesce(right(was, 400), '') ELSE '' END AS context FROM ch JOIN was USING (version_id, p)"),
        ),
        "audit_responses": (
            lambda x, d: H.audit_responses(_expected(x, d), _expected(x, d).filter("(p + n) % 4 <> 1").select("version_id", "p", "n", F.when(F.col("p") % 5 == 0, "").otherwise(F.col("sentence")).alias("text")), A.blocks(x, d).filter("p % 10 = 0").select("version_id", "p")),
            with_tables("blocks", more=SENT + ", bad AS (SELECT version_id, p, sentence_no AS n, CASE WHEN (p + sentence_no) % 4 = 1 THEN 'missing ' || sentence_no WHEN sentence_no = 0 AND p % 10 = 5 THEN 'empty 0' END AS bad FROM sent)", body="SELECT version_id, p, string_agg(bad, ', ' ORDER BY n) AS problems FROM bad WHERE bad IS NOT NULL GROUP BY 1, 2"),
        ),
        "bundle_warnings": (_warnings, with_tables("blocks", "answers", "annotations", more=WARNING_SQL, body=WARNING_BODY)),
    }
