"""Glyphs of a page: recovery of their characters, turned text, and how much of a graphic is seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters that a font's text must have, and their share of vowels, for a table by glyph number to be believed.
LETTERS, VOWELS = 8, 0.3
#: Share of a font's glyph names that must be standard for its names to be believed.
STANDARD = 0.8
# fixed values: the private use area of the basic plane
PRIVATE = (0xE000, 0xF8FF)
ARXIV = r"arXiv:\s*(\d{4}\.\d{4,5})"


def recover_glyphs(glyphs: DataFrame, numbers: DataFrame, names: DataFrame, private: DataFrame) -> DataFrame:
    """``glyphs`` (font, code, name, text) with ``text`` put right, and ``source``: number, name, private, or null where it is as it was.

    A glyph without a name is looked up by its code in ``numbers`` (code, mapped) if the text that its font would
    have reads like one: eight letters, three tenths of them vowels. A named glyph is looked up in ``names`` (name,
    mapped) if four fifths of the distinct names of its font are in there. A text of one private character is looked
    up in ``private`` (code, mapped), whatever its font. Counts by font gate the first two; the tables
    are dictionaries, of one row a key.
    """
    of = lambda df, key, new: df.select(F.col(key).alias(f"_{new}"), F.col("mapped").alias(new))
    spot = F.when((F.length("text") == 1) & F.ascii("text").between(*PRIVATE), F.ascii("text"))
    g = glyphs.withColumn("_spot", spot)
    g = g.join(of(numbers, "code", "by_number"), F.col("name").isNull() & (F.col("code") == F.col("_by_number")), "left")
    g = g.join(of(names, "name", "by_name"), F.col("name") == F.col("_by_name"), "left").join(of(private, "code", "by_private"), F.col("_spot") == F.col("_by_private"), "left")
    letters = lambda pattern: F.sum(F.length(F.regexp_replace(F.coalesce("by_number", F.lit("")), pattern, "")))
    named = F.when(F.col("name").isNotNull(), F.col("name"))
    fonts = g.groupBy("font").agg(letters("[^A-Za-z]").alias("l"), letters("[^AEIOUaeiou]").alias("v"), F.count_distinct(named).alias("names"), F.count_distinct(F.when(F.col("by_name").isNotNull(), named)).alias("known"))
    fonts = fonts.select("font", ((F.col("l") >= LETTERS) & (F.col("v") >= VOWELS * F.col("l"))).alias("_reads"), ((F.col("names") > 0) & (F.col("known") >= STANDARD * F.col("names"))).alias("_standard"))
    j = g.join(fonts, "font", "left")
    pick = F.when(F.col("by_private").isNotNull(), F.struct(F.lit("private").alias("s"), F.col("by_private").alias("t")))
    pick = pick.when(F.col("_reads") & F.col("by_number").isNotNull(), F.struct(F.lit("number").alias("s"), F.col("by_number").alias("t"))).when(F.col("_standard") & F.col("by_name").isNotNull(), F.struct(F.lit("name").alias("s"), F.col("by_name").alias("t")))
    return j.withColumn("_p", pick).select(*[F.coalesce("_p.t", "text").alias("text") if c == "text" else F.col(c) for c in glyphs.columns], F.col("_p.s").alias("source"))


def page_direction(glyphs: DataFrame) -> DataFrame:
    """The most frequent rotation of the glyphs of each page, of ties the least."""
    n = glyphs.groupBy("version_id", "page_index", "rotation").agg(F.count("*").alias("n"))
    return n.groupBy("version_id", "page_index").agg(F.max_by("rotation", F.struct("n", -F.col("rotation"))).alias("direction"))


def turned_text(glyphs: DataFrame) -> DataFrame:
    """(version_id, page_index, up, down) of the pages with glyphs (version_id, page_index, seq, text, rotation, b) that are turned
    against their page: read from the bottom to the top, and from the top to the bottom; ``b`` grows upwards."""
    turned = glyphs.join(page_direction(glyphs), ["version_id", "page_index"]).filter(F.col("rotation") != F.col("direction"))
    read = lambda order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "seq", "text"))), lambda x: x["text"]), "")
    return turned.groupBy("version_id", "page_index").agg(read(F.col("b")).alias("up"), read(-F.col("b")).alias("down"))


def margin_arxiv(turned: DataFrame) -> DataFrame:
    """(version_id, arxiv): the arXiv id in the turned text of first pages, read upwards, else downwards."""
    found = lambda c: F.nullif(F.regexp_extract(c, ARXIV, 1), F.lit(""))
    return turned.filter("page_index = 0").select("version_id", F.coalesce(found("up"), found("down")).alias("arxiv")).filter("arxiv is not null")


def union_area(rects: Column) -> Column:
    """The area that an array of rectangles (l, b, r, t) covers together: a sweep over their left and right edges, and in
    each slab over the intervals from bottom to top."""
    xs = F.array_sort(F.array_distinct(F.flatten(F.transform(rects, lambda q: F.array(q["l"], q["r"])))))

    def slab(x: Column, i: Column) -> Column:
        right = F.get(xs, i + 1)
        inside = F.filter(rects, lambda q: (q["l"] <= x) & (q["r"] >= right))
        spans = F.array_sort(F.transform(inside, lambda q: F.struct(q["b"].alias("b"), q["t"].alias("t"))))
        zero = F.struct(F.lit(float("-inf")).alias("reach"), F.lit(0.0).alias("sum"))
        step = lambda a, s: F.struct(F.greatest(a["reach"], s["t"]).alias("reach"), (a["sum"] + F.greatest(F.lit(0.0), s["t"] - F.greatest(a["reach"], s["b"]))).alias("sum"))
        return F.coalesce((right - x) * F.aggregate(spans, zero, step, lambda a: a["sum"]), F.lit(0.0))

    return F.aggregate(F.transform(xs, slab), F.lit(0.0), lambda a, x: a + x)


def visible_share(graphics: DataFrame) -> DataFrame:
    """``graphics`` (l, b, r, t, clips) with ``visible``, the share of a box that its clips leave, together: 1 without
    clips (null), 0 for a box without area. Clips are an array of rectangles (l, b, r, t)."""
    cut = F.transform("clips", lambda q: F.struct(F.greatest(q["l"], F.col("l")).alias("l"), F.greatest(q["b"], F.col("b")).alias("b"), F.least(q["r"], F.col("r")).alias("r"), F.least(q["t"], F.col("t")).alias("t")))
    seen = F.filter(cut, lambda q: (q["l"] < q["r"]) & (q["b"] < q["t"]))
    area = (F.col("r") - F.col("l")) * (F.col("t") - F.col("b"))
    return graphics.withColumn("visible", F.when(F.col("clips").isNull(), F.lit(1.0)).when(area > 0, union_area(seen) / area).otherwise(0.0))
