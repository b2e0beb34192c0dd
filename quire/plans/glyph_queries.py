"""Queries over glyphs and graphics, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import glyphs as G
from ..operators import structure as S
from ..sources import adapters as A
from ..sources.adapters_sql import with_tables
from .more_queries import _arxiv_papers

#: Characters of the dictionaries by glyph number, by place.
MAPPED = "aeioubcdefxzqqqqrstv"


def _glyphs(x, d):
    """A glyph for each block: fonts of glyph numbers, of names, and some private characters."""
    v, p = F.col("version_id"), F.col("p")
    name = F.when(v % 3 == 1, F.concat(F.lit("n"), (p % 10).cast("string"))).when(v % 3 == 2, F.concat(F.when(v % 2 == 0, "n").otherwise("odd"), (p % 10).cast("string")))
    return A.blocks(x, d).select("version_id", "p", (v % 40).alias("font"), (p % 20).alias("code"), name.alias("name"), F.when(p % 11 == 3, F.element_at(F.array(*[F.lit(chr(0xE000 + k)) for k in range(4)]), (p % 4 + 1).cast("int"))).otherwise(F.lit("?")).alias("text"))


def _recovered(x, d):
    docs = A.table(x, d, "documents").select(F.col("doc_id").alias("i"))
    place = lambda n: F.substring(F.lit(MAPPED), (F.col("i") % n + 1).cast("int"), F.lit(1))
    numbers = docs.select((F.col("i") % 20).alias("code"), place(20).alias("mapped")).distinct()
    names = docs.select(F.concat(F.lit("n"), (F.col("i") % 9).cast("string")).alias("name"), place(9).alias("mapped")).distinct()
    private = docs.select((F.col("i") % 3 + 0xE000).alias("code"), F.concat(F.lit("p"), (F.col("i") % 3).cast("string")).alias("mapped")).distinct()
    return G.recover_glyphs(_glyphs(x, d), numbers, names, private).select("version_id", "p", "text", F.coalesce("source", F.lit("")).alias("source"))


RECOVER_SQL = f"""g AS (SELECT version_id, p, version_id % 40 AS font, p % 20 AS code, CASE version_id % 3 WHEN 1 THEN 'n' || p % 10 WHEN 2 THEN CASE WHEN version_id % 2 = 0 THEN 'n' ELSE 'odd' END || p % 10 END AS name, CASE WHEN p % 11 = 3 THEN chr((57344 + p % 4)::INT) ELSE '?' END AS text FROM blocks),
  m AS (SELECT *, CASE WHEN name IS NULL THEN substr('{MAPPED}', (code + 1)::INT, 1) END AS by_number, CASE WHEN regexp_matches(name, '^n[0-8]$') THEN substr('{MAPPED}', substr(name, 2)::INT + 1, 1) END AS by_name, CASE WHEN text <> '?' AND unicode(text) < 57347 THEN 'p' || (unicode(text) - 57344) END AS by_private FROM g),
  f AS (SELECT font, count(by_number) >= 8 AND count(*) FILTER (by_number IN ('a', 'e', 'i', 'o', 'u')) >= 0.3 * count(by_number) AS reads, count(DISTINCT name) > 0 AND count(DISTINCT CASE WHEN by_name IS NOT NULL THEN name END) >= 0.8 * count(DISTINCT name) AS standard FROM m GROUP BY font)"""


def _turned(x, d):
    """A page's blocks as glyphs; those of two thirds of the versions have an arXiv id up or down their margin."""
    b = A.blocks(x, d).select("version_id", "page_index", "p", "y0")
    text = F.concat(F.lit("arXiv:2405."), F.lpad((F.col("version_id") % 100000).cast("string"), 5, "0"))
    plain = b.select("version_id", "page_index", (F.col("p") + 1000).cast("int").alias("seq"), F.lit("x").alias("text"), F.lit(0).alias("rotation"), (1 - F.col("y0")).alias("b"))
    plain = plain.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(30)))).drop("k")
    side = b.filter("p = 0").select("version_id", "page_index", F.posexplode(F.split(text, "")).alias("seq", "text")).filter("text <> '' and version_id % 3 < 2")
    side = side.select("version_id", "page_index", "seq", "text", F.lit(90).alias("rotation"), F.when(F.col("version_id") % 3 == 0, F.col("seq")).otherwise(-F.col("seq")).cast("double").alias("b"))
    return plain.unionByName(side)


def _clipped(x, d):
    """Boxes of whole numbers with two or three clips."""
    v, p = F.col("version_id"), F.col("p")
    box = lambda l, b, r, t: F.struct(*[c.cast("double").alias(n) for c, n in zip((l, b, r, t), "lbrt", strict=True)])
    zero = F.lit(0)
    clips = F.array(box(p % 5, zero, p % 5 + 4, 6 + p % 3), box(zero, v % 4, 9 + zero, v % 4 + 3), box(p % 3 + 2, p % 7, p % 3 + 20, p % 7 + 2))
    return A.blocks(x, d).select("version_id", "p", *[(F.lit(k)).cast("double").alias(n) for k, n in zip((1, 1, 11, 9), "lbrt", strict=True)], F.when(p % 9 > 0, clips).alias("clips"))


def glyph_queries() -> dict:
    return {
        "recover_glyphs": (
            _recovered,
            with_tables("blocks", more=RECOVER_SQL, body="SELECT version_id, p, CASE WHEN by_private IS NOT NULL THEN by_private WHEN reads AND by_number IS NOT NULL THEN by_number WHEN standard AND by_name IS NOT NULL THEN by_name ELSE text END AS text, CASE WHEN by_private IS NOT NULL THEN 'private' WHEN reads AND by_number IS NOT NULL THEN 'number' WHEN standard AND by_name IS NOT NULL THEN 'name' ELSE '' END AS source FROM m JOIN f USING (font)"),
        ),
        "page_direction": (lambda x, d: G.page_direction(A.blocks(x, d).withColumn("rotation", F.element_at(F.array(*map(F.lit, (0, 90, 270))), (F.length("text") % 3 + 1).cast("int")))), with_tables("blocks", more="n AS (SELECT version_id, page_index, ([0, 90, 270])[length(text) % 3 + 1] AS rotation, count(*) AS n FROM blocks GROUP BY ALL)", body="SELECT version_id, page_index, arg_max(rotation, (n, -rotation)) AS direction FROM n GROUP BY ALL")),
        "margin_identifiers": (
            lambda x, d: S.paper_identifiers(_arxiv_papers(x, d), A.blocks(x, d).limit(0), G.margin_arxiv(G.turned_text(_turned(x, d)))),
            with_tables("papers", "blocks", more="n AS (SELECT DISTINCT version_id FROM blocks), i AS (SELECT paper_id, CASE WHEN paper_id % 7 = 2 THEN 'arxiv:2312.00001' WHEN coalesce(doi, '') <> '' THEN 'doi:' || doi END AS a, CASE WHEN paper_id % 3 < 2 AND n.version_id IS NOT NULL THEN 'arxiv:2405.' || lpad((paper_id % 100000)::VARCHAR, 5, '0') END AS b FROM papers LEFT JOIN n USING (version_id)), u AS (SELECT paper_id, list_filter([a, b], lambda x: x IS NOT NULL) AS ids FROM i)", body="SELECT paper_id, unnest(range(len(ids)))::INT AS ordinal, unnest(ids) AS identifier FROM u"),
        ),
        "visible_share": (
            lambda x, d: G.visible_share(_clipped(x, d)).select("version_id", "p", F.round("visible", 6).alias("visible")),
            with_tables("blocks", more="cell AS (SELECT x, y FROM range(1, 11) a(x), range(1, 9) b(y))", body="SELECT version_id, p, CASE WHEN p % 9 = 0 THEN 1.0 ELSE round(count(*) FILTER ((x >= p % 5 AND x < p % 5 + 4 AND y >= 0 AND y < 6 + p % 3) OR (x < 9 AND y >= version_id % 4 AND y < version_id % 4 + 3) OR (x >= p % 3 + 2 AND x < p % 3 + 20 AND y >= p % 7 AND y < p % 7 + 2)) / 80.0::DOUBLE, 6) END::DOUBLE AS visible FROM blocks, cell GROUP BY version_id, p"),
        ),
    }
