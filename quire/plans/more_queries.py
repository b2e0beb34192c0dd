"""More queries over structure and evidence, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import structure as S
from ..sources import adapters as A
from ..sources.adapters_sql import with_tables
from .structure_queries import NOT_BODY_SQL, TITLE_SQL

NAMES = ", ".join(f"'{n}'" for n in S.OPERATOR_NAMES)
SIGN = S.MATH_SIGN
CAPTION_SQL = r"regexp_matches(text, '^(?:Fig\.|Figure|Table) +(\d+)[.:]')"


def _math_blocks(x, d):
    """Every fifth block as a formula or a formula-like line."""
    k = (F.col("p") + F.col("version_id")) % 5
    t = F.when(k == 1, F.concat(F.lit("x = y + "), F.col("p").cast("string"))).when(k == 2, F.concat(F.lit("where speed = 3 so (2.1)"))).when(k == 3, F.lit("max log")).when((k == 4) & (F.col("p") % 2 == 0), F.lit("under a brace")).otherwise(F.col("text"))
    return A.blocks(x, d).withColumns({"text": t, "y1": F.col("y0") + 0.19, "font_size": F.when((k == 4) & (F.col("p") % 2 == 0), 8.0).otherwise(F.col("font_size"))})


MATH_TEXT = "mb AS (SELECT version_id, p, page_index, x0, x1, quality_flags, y0, y0 + 0.19::DOUBLE AS y1, CASE WHEN (p + version_id) % 5 = 4 AND p % 2 = 0 THEN 8.0 ELSE font_size END::DOUBLE AS font_size, CASE WHEN (p + version_id) % 5 = 1 THEN 'x = y + ' || p WHEN (p + version_id) % 5 = 2 THEN 'where speed = 3 so (2.1)' WHEN (p + version_id) % 5 = 3 THEN 'max log' WHEN (p + version_id) % 5 = 4 AND p % 2 = 0 THEN 'under a brace' ELSE text END AS text FROM blocks)"
MATH_FLAG = rf"""mw AS (SELECT *, len(list_distinct(list_filter(regexp_extract_all(lower(text), '([a-z]{{3,}})', 1), lambda w: w NOT IN ({NAMES})))) AS words, len(list_filter(regexp_extract_all(lower(text), '([a-z]{{2,}})', 1), lambda w: w IN ({NAMES}))) > 0 AS named, regexp_matches(text, '{SIGN}') AS sign, regexp_matches(text, '\(\d+(?:\.\d+)*[a-z]?\)$') AS label FROM mb),
  mf AS (SELECT *, NOT {CAPTION_SQL} AND ((label AND sign) OR (words <= 1 AND (sign OR (words = 0 AND named)))) AS math FROM mw)"""


def _glyph_lines(x, d):
    n = F.length("text")
    return A.blocks(x, d).select("version_id", F.floor(F.col("p") / 3).alias("block"), n.alias("glyphs"), F.when(F.col("p") % 4 == 0, n).otherwise(0).alias("math_glyphs"), F.when(F.col("p") % 5 < 2, n).otherwise(0).alias("turned"), (F.col("p") % 7 == 3).alias("unmapped"), (F.col("font_size") + (F.col("p") % 3) / 7).alias("size"))


def _arxiv_blocks(x, d):
    t = F.when((F.col("version_id") % 4 == 1) & (F.col("p") == 1), F.concat(F.lit("arXiv:2401."), F.lpad((F.col("version_id") % 100000).cast("string"), 5, "0"), F.lit("v2"))).otherwise(F.col("text"))
    return A.blocks(x, d).withColumn("text", t)


def _arxiv_papers(x, d):
    return A.papers(x, d).withColumn("doi", F.when(F.col("paper_id") % 7 == 2, F.lit("10.48550/arXiv.2312.00001")).otherwise(F.col("doi")))


def _glyphs(x, d):
    """One line a block, of eight glyphs of which some are small and raised."""
    b = A.blocks(x, d).select("version_id", "p", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("seq"))
    small = (F.col("seq") + F.col("p")) % 4 == 3
    low = F.when(small & (F.col("seq") % 2 == 0), 16.0).when(small, 10.0).otherwise(10.0)
    return b.withColumns({"b": low, "t": low + F.when(small, 6.0).otherwise(10.0)})


def _font_glyphs(x, d):
    return A.blocks(x, d).select((F.col("version_id") % 40).alias("font"), (F.col("p") % 20).alias("code"), "version_id", "p", F.lit("?").alias("text"))


def _dictionary(x, d):
    letters = F.lit("aeioubcdefxzqqqqrstv")
    return A.table(x, d, "documents").select((F.col("doc_id") % 20).alias("code")).distinct().withColumn("mapped", F.substring(letters, F.col("code").cast("int") + 1, F.lit(1)))


def _box_anchors(x, d):
    v = F.col("v")
    return A.annotations(x, d).select(F.col("annotation_id").alias("anchor_id"), "version_id", (F.col("page_index") % 4).alias("page_index"), F.lit(0.2).alias("a0"), (v * 0.9).alias("b0"), F.lit(0.6).alias("a1"), (v * 0.9 + 0.04).alias("b1"))


ANCHORS = "ba AS (SELECT annotation_id AS anchor_id, version_id, page_index % 4 AS page_index, 0.2::DOUBLE AS a0, v * 0.9::DOUBLE AS b0, 0.6::DOUBLE AS a1, v * 0.9::DOUBLE + 0.04::DOUBLE AS b1 FROM annotations)"


def _quad_anchors(x, d):
    i = F.col("annotation_id")
    q = lambda w: F.array(*[F.lit(z) for z in (0.1, 0.1)], F.lit(0.1) + w, F.lit(0.1), F.lit(0.1) + w, F.lit(0.2), F.lit(0.1), F.lit(0.2))
    quads = F.when(i % 7 == 0, F.array(q(F.lit(0.0)))).when(i % 5 == 0, F.array(q(F.lit(0.3)), q(F.lit(0.2)))).when(i % 11 == 0, F.array(F.array(F.lit(0.1)))).otherwise(F.array(q(F.lit(0.3))))
    return A.annotations(x, d).select(i.alias("anchor_id"), "version_id", (F.col("page_index") % 6).alias("page_index"), "kind", F.when(i % 4 == 0, "").otherwise(F.col("quote")).alias("quote"), quads.alias("quads"))


def more_queries() -> dict:
    b = A.blocks
    return {
        "flag_math": (lambda x, d: S.flag_math(_math_blocks(x, d)), with_tables("blocks", more=MATH_TEXT + ", " + MATH_FLAG, body="SELECT version_id, p, math FROM mf")),
        "flag_equation_labels": (
            lambda x, d: S.flag_equation_labels(_math_blocks(x, d), _math_blocks(x, d).join(S.flag_math(_math_blocks(x, d)).filter("math"), ["version_id", "p"])),
            with_tables("blocks", more=MATH_TEXT + ", " + MATH_FLAG + f""", lb AS (SELECT * FROM mf WHERE NOT math AND trim(text) <> '' AND NOT {NOT_BODY_SQL}), lh AS (SELECT version_id, page_index, font_size, sum(length(text)) AS w FROM lb GROUP BY ALL), lr AS (SELECT *, sum(w) OVER (PARTITION BY version_id, page_index ORDER BY font_size) AS run, sum(w) OVER (PARTITION BY version_id, page_index) AS total FROM lh), lm AS (SELECT version_id, page_index, min(font_size) AS median FROM lr WHERE 2 * run >= total GROUP BY ALL)""",
                        body=f"SELECT DISTINCT s.version_id, s.p FROM lb s JOIN lm USING (version_id, page_index) JOIN mf m ON s.version_id = m.version_id AND s.page_index = m.page_index AND m.math WHERE len(regexp_split_to_array(trim(s.text), '\\s+')) <= 6 AND NOT {CAPTION_SQL.replace('text', 's.text')} AND s.font_size < 0.85::DOUBLE * median AND m.x0 < s.x1 AND s.x0 < m.x1 AND (abs(s.y0 - m.y1) <= s.y1 - s.y0 OR abs(m.y0 - s.y1) <= s.y1 - s.y0)"),
        ),
        "block_quality": (
            lambda x, d: S.block_quality(_glyph_lines(x, d)),
            with_tables("blocks", more="g AS (SELECT version_id, p // 3 AS block, length(text) AS n, p, font_size + (p % 3) / 7.0::DOUBLE AS size FROM blocks)", body="SELECT version_id, block, bool_or(p % 7 = 3) AS unmapped_chars, sum(CASE WHEN p % 4 = 0 THEN n ELSE 0 END) >= 0.5 * sum(n) AS math, sum(CASE WHEN p % 5 < 2 THEN n ELSE 0 END) > 0.5 * sum(n) AS side_text, round(median(size), 2) AS font_size FROM g GROUP BY version_id, block"),
        ),
        "repair_titles": (
            lambda x, d: S.repair_titles(A.papers(x, d).withColumn("title", F.when(F.col("paper_id") % 3 == 0, F.lit("paper_final.pdf")).otherwise(F.col("title"))), S.title_from_blocks(b(x, d))).select("paper_id", "title"),
            with_tables("blocks", "papers", more=TITLE_SQL.format(src="blocks") + ", found AS (SELECT version_id, title AS found FROM titled), pp AS (SELECT paper_id, version_id, CASE WHEN paper_id % 3 = 0 THEN 'paper_final.pdf' ELSE title END AS title FROM papers)",
                        body="SELECT paper_id, CASE WHEN title IS NULL OR NOT regexp_matches(trim(title), '\\s') OR regexp_matches(title, '(?i)\\.(?:pdf|docx?|tex|ps|dvi|indd)$') THEN coalesce(found, title) ELSE title END AS title FROM pp LEFT JOIN found USING (version_id)"),
        ),
        "paper_identifiers": (
            lambda x, d: S.paper_identifiers(_arxiv_papers(x, d), _arxiv_blocks(x, d)),
            with_tables("papers", "blocks", more="n AS (SELECT version_id, count(*) AS n FROM blocks GROUP BY 1), i AS (SELECT paper_id, CASE WHEN paper_id % 7 = 2 THEN 'arxiv:2312.00001' WHEN coalesce(doi, '') <> '' THEN 'doi:' || doi END AS a, CASE WHEN paper_id % 4 = 1 AND n > 1 THEN 'arxiv:2401.' || lpad((paper_id % 100000)::VARCHAR, 5, '0') END AS b FROM papers LEFT JOIN n USING (version_id)), u AS (SELECT paper_id, list_filter([a, b], lambda x: x IS NOT NULL) AS ids FROM i)", body="SELECT paper_id, unnest(range(len(ids)))::INT AS ordinal, unnest(ids) AS identifier FROM u"),
        ),
        "script_marks": (
            lambda x, d: S.script_marks(_glyphs(x, d), ["version_id", "p"]).fillna("", ["mark"]).select("version_id", "p", "seq", "mark"),
            with_tables("blocks", body="SELECT version_id, p, seq::INT AS seq, CASE WHEN (seq + p) % 4 <> 3 THEN '' WHEN seq % 2 = 0 THEN '^' ELSE '_' END AS mark FROM (SELECT version_id, p, unnest(range(8)) AS seq FROM blocks)"),
        ),
        "remap_glyphs": (
            lambda x, d: S.remap_glyphs(_font_glyphs(x, d), _dictionary(x, d)).select("version_id", "p", "text"),
            with_tables("blocks", more="j AS (SELECT version_id, p, version_id % 40 AS font, substr('aeioubcdefxzqqqqrstv', (p % 20)::INT + 1, 1) AS mapped FROM blocks), ok AS (SELECT font FROM j GROUP BY font HAVING count(*) >= 8 AND count(*) FILTER (mapped IN ('a', 'e', 'i', 'o', 'u')) >= 0.3 * count(*))", body="SELECT version_id, p, CASE WHEN font IN (SELECT font FROM ok) THEN mapped ELSE '?' END AS text FROM j"),
        ),
        "paragraph_chains": (
            lambda x, d: S.paragraph_chains(b(x, d).withColumn("text", F.when(F.col("p") % 5 == 0, F.lower("text")).otherwise(F.col("text")))),
            with_tables("blocks", more=f"l AS (SELECT version_id, p, page_index, font_size, CASE WHEN p % 5 = 0 THEN lower(text) ELSE text END AS text FROM blocks WHERE NOT {NOT_BODY_SQL} AND trim(text) <> ''), j AS (SELECT *, coalesce(lag(page_index) OVER w = page_index - 1 AND regexp_matches(text, '^\\p{{Ll}}') AND lag(font_size) OVER w = font_size, false) AS joins FROM l WINDOW w AS (PARTITION BY version_id ORDER BY p))", body="SELECT version_id, p, max(CASE WHEN NOT joins THEN p END) OVER (PARTITION BY version_id ORDER BY p) AS chain, joins FROM j"),
        ),
        "blocks_under": (
            lambda x, d: S.blocks_under(_box_anchors(x, d), b(x, d)),
            with_tables("blocks", "annotations", more=ANCHORS, body="SELECT anchor_id, version_id, p FROM ba JOIN blocks USING (version_id, page_index) WHERE greatest(0, least(x1, a1) - greatest(x0, a0)) * greatest(0, least(y1, b1) - greatest(y0, b0)) >= 0.5::DOUBLE * (a1 - a0) * (b1 - b0)"),
        ),
        "nearest_caption": (
            lambda x, d: S.nearest_caption(_box_anchors(x, d), b(x, d)),
            with_tables("blocks", "annotations", more=ANCHORS + f", c AS (SELECT anchor_id, p, greatest(greatest(0, x0 - a1, a0 - x1), greatest(0, y0 - b1, b0 - y1)) AS gap FROM ba JOIN blocks USING (version_id, page_index) WHERE {CAPTION_SQL})", body="SELECT anchor_id, arg_min(p, (gap, p)) AS caption_p FROM c WHERE gap <= 0.08::DOUBLE GROUP BY 1"),
        ),
        "validate_anchors": (
            lambda x, d: S.validate_anchors(_quad_anchors(x, d), b(x, d).groupBy("version_id").agg((F.max("page_index") + 1).alias("page_count"))).fillna("", ["reason"]),
            with_tables("blocks", "annotations", more="c AS (SELECT version_id, max(page_index) + 1 AS n FROM blocks GROUP BY 1)", body="SELECT annotation_id AS anchor_id, CASE WHEN n IS NULL OR page_index % 6 >= n THEN 'page' WHEN annotation_id % 7 <> 0 AND annotation_id % 5 <> 0 AND annotation_id % 11 = 0 THEN 'quad' WHEN annotation_id % 7 = 0 THEN 'area' WHEN kind = 'text' AND (annotation_id % 4 = 0 OR trim(quote) = '') THEN 'quote' WHEN kind = 'region' AND annotation_id % 5 = 0 THEN 'quads' ELSE '' END AS reason FROM annotations LEFT JOIN c USING (version_id)"),
        ),
        "block_line_height": (
            lambda x, d: S.block_line_height(b(x, d).select("version_id", "page_index", F.col("reading_order").alias("block_id"), F.explode(F.array(F.array("x0", "y0", "x1", "y1"), F.array("x0", "y0", "x1", F.col("y1") + F.col("p") % 3))).alias("box")), b(x, d).select("version_id", "page_index").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(800.0)})).withColumn("line_height", F.round("line_height", 6)),
            with_tables("blocks", more="l AS (SELECT version_id, page_index, reading_order AS block_id, least((x1 - x0) * 600, (unnest([y1, y1 + p % 3]) - y0) * 800) AS h FROM blocks)", body="SELECT version_id, page_index, block_id, round(median(h), 6) AS line_height FROM l GROUP BY ALL"),
        ),
    }
