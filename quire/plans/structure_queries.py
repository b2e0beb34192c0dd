"""Queries over document structure, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import structure as S
from ..operators.outline import NAMES, ROMANS, outline
from ..sources import adapters as A
from ..sources.adapters_sql import with_tables

NOT_BODY_SQL = "list_has_any(quality_flags, ['in_figure','in_table','math','page_header','page_footer','reference','side_text'])"
HEADS = r"""heads AS (
  SELECT version_id, p, page_index, text, list_transform(string_split(regexp_extract(text, '^(\d{1,2}(?:\.\d{1,2})*)\.? +(\p{Lu}[^.!?]{1,100})$', 1), '.'), lambda x: x::INT) AS number
  FROM blocks WHERE regexp_matches(text, '^(\d{1,2}(?:\.\d{1,2})*)\.? +(\p{Lu}[^.!?]{1,100})$')
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY p) AS k FROM heads
), walk AS (
  SELECT version_id, k, CASE WHEN number > [0] AND number[1] <= 2 THEN number ELSE [0] END AS last, number > [0] AND number[1] <= 2 AS kept FROM ordered WHERE k = 1
  UNION ALL
  SELECT o.version_id, o.k, CASE WHEN o.number > w.last AND o.number[1] - w.last[1] <= 2 THEN o.number ELSE w.last END, o.number > w.last AND o.number[1] - w.last[1] <= 2
  FROM walk w JOIN ordered o ON o.version_id = w.version_id AND o.k = w.k + 1
), headings AS (
  SELECT o.version_id, o.p, o.page_index, o.text AS title, len(o.number)::INT AS level FROM ordered o JOIN walk w USING (version_id, k) WHERE w.kept
)"""
#: A word for a figure with its number, and a mark or no small letter behind them.
FIGURE_HEAD = r"^([Ff]ig(ure)?\.?|FIG(URE)?\.?|그림) *(\d{1,4})( *\p{P}| +[^\p{Ll}\s]|$)"
REFS = r"""starts AS (
  SELECT version_id, max(p) AS start, arg_max(font_size, p) AS head_size FROM blocks WHERE regexp_matches(text, '(?i)^(?:\d+\.? +)?(?:references|bibliography|literature cited|works cited|참고 ?문헌)$') GROUP BY version_id
), ends AS (
  SELECT b.version_id, min(b.p) AS stop FROM blocks b JOIN starts s USING (version_id) WHERE b.p > s.start AND (regexp_matches(b.text, '(?i)^(?:appendix|appendices|supplementary|부록)\b') OR (regexp_matches(b.text, '^[A-Z]\.?\s+\p{Lu}') AND len(regexp_split_to_array(trim(b.text), '\s+')) <= 9 AND NOT contains(b.text, ',') AND NOT ends_with(trim(b.text), '.') AND b.font_size >= 0.95::DOUBLE * head_size)) GROUP BY b.version_id
), refs AS (
  SELECT b.version_id, b.p, b.page_index, s.start FROM blocks b JOIN starts s USING (version_id) LEFT JOIN ends e USING (version_id) WHERE b.p >= s.start AND (e.stop IS NULL OR b.p < e.stop)
)"""


def status_sql(rows: str) -> str:
    return f"""CASE WHEN chars < 10 AND coverage >= 0.5 THEN 'image_only' WHEN chars < 10 THEN 'unknown' WHEN unmapped / {rows} > 0.5 THEN 'unreadable'
      WHEN unmapped / {rows} > 0.02 THEN 'partial' WHEN coverage >= 0.8 AND chars < 200 THEN 'partial' ELSE 'usable' END"""


STATUS = f"classified AS (SELECT *, {status_sql('chars')} AS text_status FROM page_stats)"


def figure_regions(b):
    """A model region over every third block of a page."""
    return b.filter("p % 3 = 0").select("version_id", "page_index", F.when(F.col("p") % 2 == 0, "image").otherwise("table").alias("label"), ((F.col("p") % 10) / 10.0).alias("score"), F.lit(0.05).alias("x0"), (F.col("y0") - 0.01).alias("y0"), F.when(F.col("p") % 4 == 0, 0.4).otherwise(0.95).alias("x1"), (F.col("y1") + 0.2).alias("y1"))


def two_column(b):
    """Blocks dealt to two columns on every other page."""
    left, right = (F.col("p") % 5).isin(1, 3), (F.col("p") % 5).isin(2, 4)
    odd = F.col("page_index") % 2 == 1
    return b.withColumns({"x0": F.when(odd & right, 0.52).otherwise(F.col("x0")), "x1": F.when(odd & left, 0.48).otherwise(F.col("x1"))})


TITLE_SQL = rf"""f AS (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY p) AS i, trim(text) <> '' AND NOT {NOT_BODY_SQL} AS body FROM {{src}} WHERE page_index = 0),
  h AS (SELECT version_id, font_size, sum(length(text)) AS w FROM f WHERE body GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY version_id ORDER BY font_size) AS run, sum(w) OVER (PARTITION BY version_id) AS total FROM h), m AS (SELECT version_id, min(font_size) AS median FROM r WHERE 2 * run >= total GROUP BY ALL),
  cn AS (SELECT *, body AND y0 < 0.5 AND x1 - x0 >= 0.2 AND len(regexp_extract_all(text, '\p{{{{L}}}}{{{{2,}}}}')) >= 2 AS can FROM f), bt AS (SELECT version_id, arg_min(i, (-font_size, i)) AS best_i, max(font_size) AS size FROM cn WHERE can GROUP BY 1),
  ok AS (SELECT cn.version_id, i - best_i AS o, text, size FROM cn JOIN bt USING (version_id) WHERE can AND abs(font_size - size) <= 0.5 AND abs(i - best_i) <= 2),
  sp AS (SELECT version_id, any_value(size) AS size, CASE WHEN bool_or(o = -1) THEN 1 + bool_or(o = -2)::INT ELSE 0 END AS before, CASE WHEN bool_or(o = 1) THEN 1 + bool_or(o = 2)::INT ELSE 0 END AS behind FROM ok GROUP BY 1),
  tt AS (SELECT version_id, trim(regexp_replace(string_agg(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ' ORDER BY o), '[*∗†‡§¶]+$', '')) AS title FROM ok JOIN sp USING (version_id) JOIN m USING (version_id) WHERE o BETWEEN -before AND least(behind, 2 - before) AND sp.size >= 1.15::DOUBLE * median GROUP BY 1),
  titled AS (SELECT version_id, title FROM tt WHERE length(title) BETWEEN 1 AND 300)"""
#: Blocks of which the second and third have the size of a title in some versions.
SIZED = "sb AS (SELECT * REPLACE (CASE WHEN p = 1 AND version_id % 3 = 0 THEN 14.3 WHEN p = 2 AND version_id % 6 = 0 THEN 13.8 ELSE font_size END::DOUBLE AS font_size) FROM blocks)"


def _sized(blocks):
    p, v = F.col("p"), F.col("version_id")
    return blocks.withColumn("font_size", F.when((p == 1) & (v % 3 == 0), 14.3).when((p == 2) & (v % 6 == 0), 13.8).otherwise(F.col("font_size")))


def outlined(blocks):
    """Blocks of which some are headings of each kind, some of two lines."""
    k, n = (F.col("p") + F.col("version_id")) % 11, F.floor(F.col("p") / 11)
    roman = F.element_at(F.array(*map(F.lit, ("I", "II", "III", "IV", "VI", "IX"))), (n % 6 + 1).cast("int"))
    letter = F.element_at(F.array(*map(F.lit, "ABDC")), (n % 4 + 1).cast("int"))
    text = (
        F.when(k == 0, F.concat(roman, F.lit(". MAIN RESULTS"))).when(k == 2, F.concat(letter, F.lit(". Some Methods"))).when(k == 4, F.lit("Conclusion:"))
        .when(k == 6, F.lit("B.1 More Proofs")).when(k == 8, F.concat((n + 1).cast("string"), F.lit(".1 Long Title. It runs into the text here"))).otherwise(F.col("text"))
    )
    return blocks.withColumns({"text": text, "lines": F.when(k == 8, 3).otherwise(1)})


HEADS_SQL = r"(length({0}) <= 120 AND len(regexp_split_to_array({0}, '\s+')) <= 12 AND regexp_matches({0}, '^\p{{L}}') AND NOT regexp_matches({0}, '^\p{{Ll}}') AND length(regexp_replace({0}, '\P{{L}}', '', 'g')) > 1 AND NOT ends_with({0}, '.'))"
CAPITALISED = r"(len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: length(w) > 3 AND regexp_matches(w, '^\p{{L}}') AND NOT regexp_matches(w, '^\p{{Lu}}'))) = 0)"
OUTLINE = rf"""ob AS (SELECT version_id, p, page_index, trim(CASE (p + version_id) % 11 WHEN 0 THEN (['I', 'II', 'III', 'IV', 'VI', 'IX'])[p // 11 % 6 + 1] || '. MAIN RESULTS' WHEN 2 THEN (['A', 'B', 'D', 'C'])[p // 11 % 4 + 1] || '. Some Methods' WHEN 4 THEN 'Conclusion:' WHEN 6 THEN 'B.1 More Proofs' WHEN 8 THEN (p // 11 + 1) || '.1 Long Title. It runs into the text here' ELSE text END) AS text, (p + version_id) % 11 <> 8 AS one_line FROM blocks),
  o1 AS (SELECT *, string_split(text, ' ')[1] AS first, ltrim(substr(text, length(string_split(text, ' ')[1]) + 1)) AS rest FROM ob),
  o2 AS (SELECT *, ends_with(first, '.') AS dotted, string_split(CASE WHEN ends_with(first, '.') THEN left(first, -1) ELSE first END, '.') AS pieces, instr(replace(rest, ': ', '. '), '. ') AS cut FROM o1),
  o3 AS (SELECT *, rest <> '' AND len(pieces) <= 4 AND list_bool_and(list_transform(pieces, lambda x: regexp_matches(x, '^[0-9]{{1,2}}$'))) AS num, regexp_matches(pieces[1], '^[A-Z]$') AS lettered, length(text) <= 120 AND len(string_split(text, ' ')) <= 12 AS short, list_position({ROMANS}, pieces[1]) AS roman, lower(rtrim(text, ': ')) AS bare,
    CASE WHEN one_line OR (length(text) <= 120 AND len(string_split(text, ' ')) <= 12 AND {HEADS_SQL.format("rest")} AND {CAPITALISED.format("rest")}) THEN rest WHEN cut > 0 AND {CAPITALISED.format("left(rest, cut - 1)")} THEN left(rest, cut - 1) END AS head FROM o2),
  o3b AS (SELECT *, NOT num AND one_line AND short AS alone, lettered AND rest <> '' AND len(pieces) BETWEEN 2 AND 4 AND list_bool_and(list_transform(pieces[2:], lambda x: regexp_matches(x, '^[0-9]{{1,2}}$'))) AS appended, list_contains({list(NAMES)}, bare) OR regexp_matches(bare, '^([a-z][.]? )?(appendix|appendices)([^a-z0-9_]|$)') AS named FROM o3),
  o4 AS (SELECT version_id, p, page_index, rtrim(CASE WHEN num THEN left(text, length(text) - length(rest)) || head ELSE text END, ': ') AS title,
    CASE WHEN num AND head <> '' AND {HEADS_SQL.format("head")} THEN list_transform(pieces, lambda x: x::INT) END AS number,
    CASE WHEN alone AND dotted AND len(pieces) = 1 AND roman > 0 AND {HEADS_SQL.format("rest")} AND rest = upper(rest) THEN roman END AS section,
    CASE WHEN alone AND appended THEN CASE WHEN {HEADS_SQL.format("rest")} THEN length(first) - length(replace(first, '.', '')) + 1 END WHEN alone AND named THEN 1 END AS fixed,
    CASE WHEN alone AND NOT appended AND NOT named AND lettered AND len(pieces) = 1 AND dotted AND {HEADS_SQL.format("rest")} THEN ascii(first) - 64 END AS letter FROM o3b),
  o5 AS (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY p) AS k FROM o4 WHERE number IS NOT NULL OR section IS NOT NULL OR fixed IS NOT NULL OR letter IS NOT NULL),
  ow AS (SELECT version_id, 0::BIGINT AS k, [0] AS last, 0 AS sec, 0 AS let, 0 AS level FROM (SELECT DISTINCT version_id FROM o5)
    UNION ALL SELECT version_id, k, CASE WHEN how = 1 THEN number ELSE last END, CASE WHEN how = 2 THEN section ELSE sec END::INT, CASE WHEN how = 2 THEN 0 WHEN how = 4 THEN letter ELSE let END::INT, CASE how WHEN 1 THEN len(number) WHEN 2 THEN 1 WHEN 3 THEN fixed WHEN 4 THEN 2 ELSE 0 END::INT FROM (
      SELECT o.version_id, o.k, last, sec, let, number, section, fixed, letter, CASE WHEN number IS NOT NULL THEN CASE WHEN number > last AND number[1] <= last[1] + 2 THEN 1 ELSE 0 END WHEN section > sec AND section <= sec + 2 THEN 2 WHEN fixed IS NOT NULL THEN 3 WHEN sec > 0 AND letter > let AND letter <= let + 2 THEN 4 ELSE 0 END AS how FROM ow JOIN o5 o ON o.version_id = ow.version_id AND o.k = ow.k + 1))"""


PATHS = """hk AS (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY p) AS i FROM headings), paths AS (
              SELECT version_id, i, p, [title] AS path FROM hk WHERE i = 1 UNION ALL
              SELECT h.version_id, h.i, h.p, list_concat(w.path[1:h.level - 1], [h.title]) FROM paths w JOIN hk h ON h.version_id = w.version_id AND h.i = w.i + 1)"""
SECTION_BODY = "SELECT b.version_id, b.p, last_value(array_to_string(path, ' › ') IGNORE NULLS) OVER (PARTITION BY b.version_id ORDER BY b.p ROWS UNBOUNDED PRECEDING) AS section FROM blocks b LEFT JOIN paths x ON b.version_id = x.version_id AND b.p = x.p"
KIND_BODY = "SELECT b.version_id, b.p, CASE WHEN r.p IS NOT NULL THEN 'reference' WHEN list_contains(quality_flags, 'in_table') THEN 'in_table' WHEN list_contains(quality_flags, 'math') THEN 'math' WHEN h.p IS NOT NULL THEN 'heading' WHEN regexp_matches(b.text, '^(?:Fig\\.|Figure|Table) +(\\d+)[.:]') THEN 'caption' ELSE 'body' END AS kind FROM blocks b LEFT JOIN refs r ON b.version_id = r.version_id AND b.p = r.p LEFT JOIN headings h ON b.version_id = h.version_id AND b.p = h.p"

def _cited(blocks):
    """Blocks with ranges and lists of citations, and joined reference entries."""
    ranged = F.replace("text", F.lit("[1, 2] see"), F.lit("[1–3; 5] and [7]"))
    return blocks.withColumn("text", F.when(F.col("p") % 14 == 8, ranged).when(F.col("p") % 21 == 19, F.concat("text", F.lit(" [77] joined"))).otherwise(F.col("text")))


def structure_queries() -> dict:
    b = A.blocks
    heads = lambda s, d: S.headings(b(s, d))
    return {
        "body_blocks": (lambda s, d: S.body_blocks(b(s, d)).groupBy("version_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")), with_tables("blocks", body=f"SELECT version_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM blocks WHERE trim(text) <> '' AND NOT {NOT_BODY_SQL} GROUP BY version_id")),
        "running_lines": (
            lambda s, d: S.running_lines(b(s, d)),
            with_tables("blocks", more="banded AS (SELECT *, CASE WHEN y1 <= 0.1 THEN 'header' WHEN y0 >= 0.9 THEN 'footer' END AS band, trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), ' +', ' ', 'g')) AS key FROM blocks), total AS (SELECT version_id, count(DISTINCT page_index) AS pages FROM blocks GROUP BY version_id), often AS (SELECT version_id, band, key, count(DISTINCT page_index) AS n FROM banded WHERE band IS NOT NULL GROUP BY version_id, band, key)",
                        body="SELECT version_id, p, band, key, n FROM banded JOIN often USING (version_id, band, key) JOIN total USING (version_id) WHERE n >= greatest(2, ceil(pages * 0.2::DOUBLE)) OR regexp_matches(text, '^\\W*[0-9]{1,4}\\W*$')"),
        ),
        "reference_blocks": (lambda s, d: S.reference_blocks(b(s, d)), with_tables("blocks", more=REFS, body="SELECT * FROM refs")),
        "reference_pages": (lambda s, d: S.reference_pages(b(s, d)), with_tables("blocks", more=REFS, body="SELECT version_id, unnest(range(min(page_index), max(page_index) + 1))::INT AS page_index FROM refs GROUP BY version_id")),
        "outline": (lambda s, d: outline(outlined(b(s, d))), with_tables("blocks", more=OUTLINE, body="SELECT o5.version_id, p, page_index, title, level FROM o5 JOIN ow USING (version_id, k) WHERE level > 0")),
        "headings": (lambda s, d: heads(s, d).drop("number"), with_tables("blocks", more=HEADS, body="SELECT * FROM headings")),
        "section_paths": (
            lambda s, d: S.section_paths(b(s, d), heads(s, d)),
            with_tables("blocks", more=HEADS + ", " + PATHS,
                        body="SELECT b.version_id, b.p, last_value(array_to_string(path, ' › ') IGNORE NULLS) OVER (PARTITION BY b.version_id ORDER BY b.p ROWS UNBOUNDED PRECEDING) AS section FROM blocks b LEFT JOIN paths x ON b.version_id = x.version_id AND b.p = x.p"),
        ),
        "find_dois": (lambda s, d: S.find_dois(b(s, d)), with_tables("blocks", body=r"SELECT version_id, arg_min(regexp_replace(regexp_extract(text, '10\.\d{4,9}/\S+'), '[.,;:]+$', ''), p) AS doi FROM blocks WHERE page_index <= 1 AND regexp_matches(text, '10\.\d{4,9}/\S+') GROUP BY version_id")),
        "fill_doi": (
            lambda s, d: S.fill_doi(A.papers(s, d), S.find_dois(b(s, d))).select("paper_id", "doi"),
            with_tables("blocks", "papers", more=r"found AS (SELECT version_id, arg_min(regexp_replace(regexp_extract(text, '10\.\d{4,9}/\S+'), '[.,;:]+$', ''), p) AS f FROM blocks WHERE page_index <= 1 AND regexp_matches(text, '10\.\d{4,9}/\S+') GROUP BY version_id)", body="SELECT paper_id, coalesce(doi, f) AS doi FROM papers LEFT JOIN found USING (version_id)"),
        ),
        "classify_pages": (lambda s, d: S.classify_pages(A.pages(s, d)), with_tables("page_stats", more=STATUS, body="SELECT * FROM classified")),
        "page_summary": (lambda s, d: S.page_summary(S.classify_pages(A.pages(s, d))), with_tables("page_stats", more=STATUS, body="SELECT version_id, count(*) AS pages, " + ", ".join(f"count(*) FILTER (text_status = '{x}') AS {x}" for x in ("usable", "partial", "unreadable", "image_only", "unknown")) + " FROM classified GROUP BY version_id")),
        "document_status": (
            lambda s, d: S.document_status(S.classify_pages(A.pages(s, d))),
            with_tables("page_stats", more=STATUS + ", g AS (SELECT version_id, bool_or(text_status = 'usable') AS u, bool_or(text_status = 'partial') AS p, bool_or(text_status = 'unreadable') AS r, bool_and(text_status = 'usable') AS a, bool_and(text_status = 'usable' OR unmapped / chars > 0.02) AS m FROM classified GROUP BY version_id)",
                        body="SELECT version_id, CASE WHEN NOT u AND NOT p THEN 'FAILED' WHEN a THEN 'INDEXED' ELSE 'PARTIAL' END AS status, CASE WHEN NOT u AND NOT p AND r THEN 'UNREADABLE_TEXT' WHEN NOT u AND NOT p THEN 'NO_TEXT_LAYER' WHEN NOT a AND m THEN 'UNMAPPED_CHARS' END AS reason FROM g"),
        ),
        "flag_no_body": (lambda s, d: S.flag_no_body(b(s, d)), with_tables("blocks", body=f"SELECT version_id, page_index, bool_and({NOT_BODY_SQL}) AS no_body_text FROM blocks GROUP BY version_id, page_index")),
        "block_kind": (
            lambda s, d: S.block_kind(b(s, d), heads(s, d)),
            with_tables("blocks", more=HEADS + ", " + REFS, body=KIND_BODY),
        ),
        "numbered_figures": (
            lambda s, d: S.numbered_figures(b(s, d)),
            with_tables("blocks", more=f"c AS (SELECT *, regexp_extract(text, '{FIGURE_HEAD}', 4)::INT AS label FROM blocks WHERE trim(text) <> '' AND NOT {NOT_BODY_SQL} AND regexp_matches(text, '{FIGURE_HEAD}') AND NOT regexp_matches(text, '\\.{{4}}')), f AS (SELECT *, row_number() OVER (PARTITION BY version_id, label ORDER BY p) AS k FROM c)", body="SELECT version_id, label, p, page_index, CASE WHEN length(text) > 300 THEN substr(text, 1, 299) || '…' ELSE text END AS caption FROM f WHERE k = 1"),
        ),
        "carry_block_ids": (
            lambda s, d: S.carry_block_ids(b(s, d).filter("p % 4 <> 3").withColumn("block_id", F.concat_ws("-", "version_id", "p")), b(s, d)),
            with_tables("blocks", more="o AS (SELECT version_id, page_index, text, version_id || '-' || p AS block_id, row_number() OVER (PARTITION BY version_id, page_index, text ORDER BY p) AS k FROM blocks WHERE p % 4 <> 3), n AS (SELECT *, row_number() OVER (PARTITION BY version_id, page_index, text ORDER BY p) AS k FROM blocks)", body="SELECT n.version_id, n.p, coalesce(block_id, 'new-' || n.version_id || '-' || n.p) AS block_id, block_id IS NOT NULL AS carried FROM n LEFT JOIN o USING (version_id, page_index, text, k)"),
        ),
        "block_text": (
            lambda s, d: S.block_text(b(s, d).select("version_id", "page_index", "p", F.when(F.col("p") % 3 == 1, F.concat("text", F.lit("a-"))).otherwise(F.concat(F.lower("text"), F.lit("\u0007 \ue000"))).alias("text")), ["version_id", "page_index"], "p"),
            with_tables("blocks", more="l AS (SELECT version_id, page_index, p, CASE WHEN p % 3 = 1 THEN text || 'a-' ELSE lower(text) || chr(7) || ' ' || chr(57344) END AS text FROM blocks), n AS (SELECT *, lead(text) OVER (PARTITION BY version_id, page_index ORDER BY p) AS after FROM l)",
                        body="SELECT version_id, page_index, trim(regexp_replace(replace(replace(string_agg(CASE WHEN regexp_matches(text, '\\p{L}[-‐]$') AND coalesce(regexp_matches(after, '^\\p{Ll}'), false) THEN substr(text, 1, length(text) - 1) WHEN after IS NULL THEN text ELSE text || ' ' END, '' ORDER BY p), chr(7), ''), chr(57344), ''), ' +', ' ', 'g')) AS text FROM n GROUP BY version_id, page_index"),
        ),
        "weighted_median": (
            lambda s, d: S.weighted_median(b(s, d).withColumn("chars", F.length("text")), ["version_id", "page_index"], "font_size", "chars"),
            with_tables("blocks", more="h AS (SELECT version_id, page_index, font_size, sum(length(text)) AS w FROM blocks GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY version_id, page_index ORDER BY font_size) AS run, sum(w) OVER (PARTITION BY version_id, page_index) AS total FROM h)", body="SELECT version_id, page_index, min(font_size) AS median FROM r WHERE 2 * run >= total GROUP BY ALL"),
        ),
        "link_citations": (
            lambda s, d: S.link_citations(_cited(b(s, d)).withColumn("regions", F.transform(F.sequence(F.lit(0), F.lit(1) + F.col("version_id").cast("int") % 2), lambda k: F.array("x0", F.col("y0") + k / 100, "x1", F.col("y1") + k / 100)))).select("version_id", "n", "p", F.coalesce("entry_p", F.lit(-1)).alias("entry_p"), F.round(F.coalesce(F.get("line", F.lit(1)), F.lit(-1.0)), 6).alias("line_y0")),
            with_tables("blocks", more=rf"""cb AS (SELECT version_id, p, y0, quality_flags, CASE WHEN p % 14 = 8 THEN replace(text, '[1, 2] see', '[1–3; 5] and [7]') WHEN p % 21 = 19 THEN text || ' [77] joined' ELSE text END AS text FROM blocks),
              c0 AS (SELECT version_id, p, unnest(regexp_extract_all(text, '\[(\s*\d+(?:\s*[,;–—-]\s*\d+)*\s*)\]', 1)) AS l FROM cb WHERE NOT {NOT_BODY_SQL} AND trim(text) <> '' AND NOT regexp_matches(text, '^\s*\[\d+\]')), c AS (SELECT DISTINCT version_id, p, unnest(regexp_extract_all(l, '\d+'))::INT AS n FROM c0 WHERE length(l) <= 80),
              e0 AS (SELECT version_id, p, y0, CASE WHEN regexp_matches(text, '^\s*\[\d+\]') THEN regexp_extract_all(trim(text), '(?:^|\s)\[(\d+)\]', 1) ELSE regexp_extract_all(trim(text), '^(\d+)\.\s', 1) END AS ns FROM cb), e1 AS (SELECT version_id, p, y0, len(ns) AS many, unnest(ns) AS n, generate_subscripts(ns, 1) AS nth FROM e0),
              e AS (SELECT version_id, try_cast(n AS INT) AS n, arg_min({{'p': p, 'y': CASE WHEN many = 2 + version_id % 2 THEN y0 + (nth - 1) / 100.0::DOUBLE ELSE -1.0 END}}, (nth > 1, p, nth)) AS b FROM e1 GROUP BY ALL)""", body="SELECT version_id, n, p, coalesce(b.p, -1) AS entry_p, round(coalesce(b.y, -1.0), 6) AS line_y0 FROM c LEFT JOIN e USING (version_id, n)"),
        ),
        "neighbours": (lambda s, d: S.neighbours(b(s, d), None).fillna(-1, ["before", "after"]), with_tables("blocks", body=f"SELECT version_id, p, coalesce(lag(p) OVER w, -1) AS before, coalesce(lead(p) OVER w, -1) AS after FROM blocks WHERE NOT {NOT_BODY_SQL} AND trim(text) <> '' WINDOW w AS (PARTITION BY version_id, font_size ORDER BY p)")),
        "title_from_blocks": (
            lambda s, d: S.title_from_blocks(_sized(b(s, d))),
            with_tables("blocks", more=SIZED + ", " + TITLE_SQL.format(src="sb"), body="SELECT version_id, title FROM titled"),
        ),
        "reading_order": (
            lambda s, d: S.reading_order(two_column(b(s, d))),
            with_tables("blocks", more="""c AS (SELECT version_id, p, page_index, y0, length(text) AS chars, CASE WHEN page_index % 2 = 1 AND p % 5 IN (1, 3) THEN 'left' WHEN page_index % 2 = 1 AND p % 5 IN (2, 4) THEN 'right' ELSE 'full' END AS side FROM blocks),
              s AS (SELECT *, coalesce(sum(chars) FILTER (side = 'left') OVER w, 0) >= 0.25::DOUBLE * sum(chars) OVER w AND coalesce(sum(chars) FILTER (side = 'right') OVER w, 0) >= 0.25::DOUBLE * sum(chars) OVER w AS two_columns, count(*) FILTER (side = 'full') OVER (PARTITION BY version_id, page_index ORDER BY y0, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM c WINDOW w AS (PARTITION BY version_id, page_index))""",
                        body="""SELECT version_id, p, page_index, two_columns, (row_number() OVER (PARTITION BY version_id, page_index ORDER BY CASE WHEN two_columns THEN above ELSE 0 END, CASE WHEN NOT two_columns THEN 0 WHEN side = 'left' THEN 0 WHEN side = 'right' THEN 1 ELSE 2 END, CASE WHEN two_columns THEN y0 ELSE 0 END, p) - 1)::INT AS "order" FROM s"""),
        ),
        "style_runs": (
            lambda s, d: S.style_runs(b(s, d).select("version_id", F.col("p").alias("position"), F.when(F.col("p") % 4 == 1, " ").otherwise("x").alias("char"), F.when(F.col("p") % 4 == 1, None).when(F.col("p") % 5 < 2, "bold").when(F.col("p") % 5 == 2, "italic").alias("mark")), ["version_id"]),
            with_tables("blocks", more="c0 AS (SELECT version_id, p AS position, p % 4 = 1 AS blank, CASE WHEN p % 5 < 2 THEN 'bold' WHEN p % 5 = 2 THEN 'italic' END AS own FROM blocks), c AS (SELECT a.version_id, a.position, CASE WHEN NOT a.blank THEN a.own WHEN b.own = z.own THEN b.own END AS mark FROM c0 a LEFT JOIN c0 b ON b.version_id = a.version_id AND b.position = a.position - 1 LEFT JOIN c0 z ON z.version_id = a.version_id AND z.position = a.position + 1), n AS (SELECT *, CASE WHEN mark IS NOT DISTINCT FROM lag(mark) OVER w AND position = lag(position) OVER w + 1 THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY version_id ORDER BY position)), r AS (SELECT *, sum(new) OVER (PARTITION BY version_id ORDER BY position) AS run FROM n)", body='SELECT version_id, mark, min(position) AS start, max(position) + 1 AS "end" FROM r WHERE mark IS NOT NULL GROUP BY version_id, run, mark'),
        ),
        "flag_covered": (
            lambda s, d: S.flag_covered(b(s, d), figure_regions(b(s, d))),
            with_tables("blocks", more="g AS (SELECT version_id, page_index, CASE WHEN p % 2 = 0 THEN 'image' ELSE 'table' END AS label, (p % 10) / 10.0::DOUBLE AS score, 0.05::DOUBLE AS a0, y0 - 0.01::DOUBLE AS b0, CASE WHEN p % 4 = 0 THEN 0.4 ELSE 0.95 END::DOUBLE AS a1, y1 + 0.2::DOUBLE AS b1 FROM blocks WHERE p % 3 = 0), h AS (SELECT version_id, p, label, row_number() OVER (PARTITION BY version_id, p ORDER BY score DESC, label DESC) AS k FROM blocks JOIN g USING (version_id, page_index) WHERE greatest(0, least(x1, a1) - greatest(x0, a0)) * greatest(0, least(y1, b1) - greatest(y0, b0)) >= 0.5::DOUBLE * ((x1 - x0) * (y1 - y0)))", body="SELECT version_id, p, label FROM h WHERE k = 1"),
        ),
    }
