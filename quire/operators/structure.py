"""Document structure over blocks: (version_id, p, page_index, reading_order, text, box, font_size, quality_flags)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nfkc, not_body

HEADING = r"^(\d{1,2}(?:\.\d{1,2})*)\.? +(\p{Lu}[^.!?]{1,100})$"
REFERENCES = r"(?i)^(?:\d+\.? +)?(?:references|bibliography|literature cited|works cited|참고 ?문헌)$"
APPENDIX = r"(?i)^(?:appendix|appendices|supplementary|부록)\b"
#: A lettered appendix head has at most so many words, and is at least this share of the reference heading's size.
APPENDIX_WORDS, APPENDIX_SIZE = 9, 0.95
CAPTION = r"^(?:Fig\.|Figure|Table) +(\d+)[.:]"
FIGURE_HEAD = r"^(?:[Ff]ig(?:ure)?\.?|FIG(?:URE)?\.?|그림) *(\d{1,4})(?: *\p{P}| +[^\p{Ll}\s]|$)"
DOI = r"10\.\d{4,9}/\S+"


def body_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with text and without a flag that marks other than body text."""
    return blocks.filter((F.trim("text") != "") & ~F.coalesce(not_body(F.col("quality_flags")), F.lit(False)))


def running_lines(blocks: DataFrame) -> DataFrame:
    """Blocks of two lines at most, wholly in the top or bottom tenth of the page, whose text, digits as one
    sign, is on at least a fifth of the pages of the version and on two, or that are only a page number.
    A column ``lines`` tells the lines of a block; without it all are taken as short enough."""
    band = F.when(F.col("y1") <= 0.1, "header").when(F.col("y0") >= 0.9, "footer")
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), "[0-9]+", "#"), " +", " "))
    short = F.coalesce(F.col("lines"), F.lit(1)) <= 2 if "lines" in blocks.columns else F.lit(True)
    b = blocks.filter(short).withColumns({"band": band, "key": key})
    total = blocks.groupBy("version_id").agg(F.count_distinct("page_index").alias("pages"))
    often = b.filter("band is not null").groupBy("version_id", "band", "key").agg(F.count_distinct("page_index").alias("n"))
    # by p, as a hot text joins by version and key and not by page
    out = b.filter("band is not null").join(often, ["version_id", "band", "key"]).join(total, "version_id")
    return out.filter((F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * 0.2))) | F.col("text").rlike(r"^\W*[0-9]{1,4}\W*$")).select("version_id", "p", "band", "key", "n")


def reference_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks from the last reference heading to the first later appendix head or the end.

    An appendix head begins with a word for it, or is a lettered title: one line of at most nine words without
    a comma or a full stop at its end, in a font of nearly the heading's size or more, or of unknown size.
    """
    w = Window.partitionBy("version_id")
    start = F.max(F.when(F.col("text").rlike(REFERENCES), F.struct("p", "font_size"))).over(w)
    b = blocks.withColumn("_start", start).withColumn("start", F.col("_start.p")).filter(F.col("p") >= F.col("start"))
    one_line = F.coalesce(F.col("lines"), F.lit(1)) == 1 if "lines" in blocks.columns else ~F.col("text").contains("\n")
    large = F.coalesce(F.col("font_size") >= APPENDIX_SIZE * F.col("_start.font_size"), F.lit(True))
    lettered = F.col("text").rlike(r"^[A-Z]\.?\s+\p{Lu}") & one_line & (F.size(F.split(F.trim("text"), r"\s+")) <= APPENDIX_WORDS) & ~F.col("text").contains(",") & ~F.trim("text").endswith(".") & large
    end = F.min(F.when((F.col("p") > F.col("start")) & (F.col("text").rlike(APPENDIX) | lettered), F.col("p"))).over(w)
    return b.withColumn("end", end).filter(F.col("end").isNull() | (F.col("p") < F.col("end"))).select("version_id", "p", "page_index", "start")


def reference_pages(blocks: DataFrame) -> DataFrame:
    """Every page from the first to the last of the reference section."""
    span = reference_blocks(blocks).groupBy("version_id").agg(F.min("page_index").alias("a"), F.max("page_index").alias("b"))
    return span.select("version_id", F.explode(F.sequence("a", "b")).alias("page_index"))


def headings(blocks: DataFrame) -> DataFrame:
    """Numbered headings in order, each accepted against the last accepted one: its number is
    greater and its first part at most two more. The fold runs over the candidates of a version."""
    number = F.transform(F.split(F.regexp_extract("text", HEADING, 1), r"\."), lambda x: x.cast("int"))
    found = blocks.filter(F.col("text").rlike(HEADING)).select("version_id", F.struct("p", number.alias("number"), "text", "page_index").alias("h"))
    zero = F.struct(F.array(F.lit(0)).alias("last"), F.array().cast("array<struct<p:int,number:array<int>,text:string,page_index:int>>").alias("kept"))

    def step(a, h):
        ok = (h["number"] > a["last"]) & (h["number"][0] - a["last"][0] <= 2)
        return F.when(ok, F.struct(h["number"].alias("last"), F.concat(a["kept"], F.array(h)).alias("kept"))).otherwise(a)

    folded = found.groupBy("version_id").agg(F.array_sort(F.collect_list("h")).alias("hs")).select("version_id", F.explode(F.aggregate("hs", zero, step, lambda a: a["kept"])).alias("h"))
    return folded.select("version_id", F.col("h.p").alias("p"), F.col("h.page_index").alias("page_index"), F.col("h.text").alias("title"), F.size("h.number").alias("level"), F.col("h.number").alias("number"))


def section_paths(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """The section path of each block: at a heading of level L the path is cut to L - 1 titles and
    its own is added; it holds until the next heading."""
    zero = F.struct(F.array().cast("array<string>").alias("path"), F.array().cast("array<struct<p:int,path:string>>").alias("rows"))

    def step(a, h):
        path = F.concat(F.slice(a["path"], F.lit(1), F.greatest(h["level"] - 1, F.lit(0))), F.array(h["title"]))
        return F.struct(path.alias("path"), F.concat(a["rows"], F.array(F.struct(h["p"].alias("p"), F.array_join(path, " › ").alias("path")))).alias("rows"))

    rows = found.groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct("p", "level", "title"))).alias("hs")).select("version_id", F.explode(F.aggregate("hs", zero, step, lambda a: a["rows"])).alias("r")).select("version_id", "r.p", "r.path")
    w = Window.partitionBy("version_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.join(rows, ["version_id", "p"], "left").select("version_id", "p", F.last("path", True).over(w).alias("section"))


def find_dois(blocks: DataFrame) -> DataFrame:
    """The first identifier on the first two pages of each version, end marks trimmed."""
    doi = F.regexp_replace(F.regexp_extract("text", DOI, 0), r"[.,;:]+$", "")
    open_, close = F.length(doi) - F.length(F.replace(doi, F.lit("("), F.lit(""))), F.length(doi) - F.length(F.replace(doi, F.lit(")"), F.lit("")))
    trimmed = F.when((close > open_) & doi.endswith(")"), F.substring(doi, F.lit(1), F.length(doi) - 1)).otherwise(doi)
    return blocks.filter((F.col("page_index") <= 1) & F.col("text").rlike(DOI)).groupBy("version_id").agg(F.min_by(trimmed, "p").alias("doi"))


def fill_doi(papers: DataFrame, found: DataFrame) -> DataFrame:
    """Papers whose DOI is unknown (null; not the cleared empty one) take the found one."""
    f = found.select("version_id", F.col("doi").alias("found"))
    return papers.join(f, "version_id", "left").withColumn("doi", F.coalesce("doi", "found")).drop("found")


def classify_pages(pages: DataFrame) -> DataFrame:
    """text_status of each page from its glyph counts and image coverage."""
    share = F.col("unmapped") / F.col("chars")
    status = (
        F.when((F.col("chars") < 10) & (F.col("coverage") >= 0.5), "image_only").when(F.col("chars") < 10, "unknown")
        .when(share > 0.5, "unreadable").when(share > 0.02, "partial").when((F.col("coverage") >= 0.8) & (F.col("chars") < 200), "partial").otherwise("usable")
    )
    return pages.withColumn("text_status", status)


def document_status(pages: DataFrame) -> DataFrame:
    """Status and reason of each version from its classified pages."""
    s = F.col("text_status")
    g = pages.groupBy("version_id").agg(
        F.bool_or(s == "usable").alias("usable"), F.bool_or(s == "partial").alias("partial"), F.bool_or(s == "unreadable").alias("unreadable"),
        F.every(s == "usable").alias("all_usable"), F.every((s == "usable") | (F.col("unmapped") / F.col("chars") > 0.02)).alias("unmapped_only"),
    )
    none = ~F.col("usable") & ~F.col("partial")
    status = F.when(none, "FAILED").when(F.col("all_usable"), "INDEXED").otherwise("PARTIAL")
    reason = F.when(none & F.col("unreadable"), "UNREADABLE_TEXT").when(none, "NO_TEXT_LAYER").when(~F.col("all_usable") & F.col("unmapped_only"), "UNMAPPED_CHARS")
    return g.select("version_id", status.alias("status"), reason.alias("reason"))


def flag_no_body(blocks: DataFrame) -> DataFrame:
    """Pages that have blocks, all of them flagged as no body text."""
    return blocks.groupBy("version_id", "page_index").agg(F.every(F.coalesce(not_body(F.col("quality_flags")), F.lit(False))).alias("no_body_text"))


def block_kind(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """reference, in_table, in_figure, math, page_header or page_footer by flag, else heading, caption or body."""
    refs = reference_blocks(blocks).select("version_id", "p", F.lit(True).alias("is_ref"))
    heads = found.select("version_id", "p", F.lit(True).alias("is_head"))
    has = lambda x: F.array_contains("quality_flags", x)
    kind = F.when(F.col("is_ref"), "reference")
    for flag in ("in_table", "in_figure", "math", "page_header", "page_footer"):
        kind = kind.when(has(flag), flag)
    kind = kind.when(F.col("is_head"), "heading").when(F.col("text").rlike(CAPTION), "caption").otherwise("body")
    return blocks.join(refs, ["version_id", "p"], "left").join(heads, ["version_id", "p"], "left").select("version_id", "p", kind.alias("kind"))


def numbered_figures(blocks: DataFrame) -> DataFrame:
    """The first caption of each figure number of each version, 300 characters at most.

    A caption begins with a word for a figure and its number, with a mark behind it or a word that does not
    begin in lower case; lines of dots are entries of a list of figures.
    """
    label = F.regexp_extract("text", FIGURE_HEAD, 1)
    c = body_blocks(blocks).filter(F.col("text").rlike(FIGURE_HEAD) & ~F.col("text").rlike(r"\.{4}")).withColumn("label", label.cast("int"))
    caption = F.when(F.length("text") > 300, F.concat(F.substring("text", 1, 299), F.lit("…"))).otherwise(F.col("text"))
    first = c.withColumn("caption", caption).groupBy("version_id", "label").agg(F.min_by(F.struct("p", "page_index", "caption"), "p").alias("f"))
    return first.select("version_id", "label", "f.*")


def carry_block_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """New blocks take the id of the old block with the same version, page and text; the k-th of
    equal texts that of the k-th. Others get a new id from their place."""
    w = Window.partitionBy("version_id", "page_index", "text").orderBy("p")
    o = old.select("version_id", "page_index", "text", F.row_number().over(w).alias("k"), F.col("block_id"))
    n = new.withColumn("k", F.row_number().over(w))
    return n.join(o, ["version_id", "page_index", "text", "k"], "left").select("version_id", "p", F.coalesce("block_id", F.concat_ws("-", F.lit("new"), "version_id", "p")).alias("block_id"), F.col("block_id").isNotNull().alias("carried"))


def page_summary(pages: DataFrame) -> DataFrame:
    """Pages of each version by status."""
    return pages.groupBy("version_id").agg(F.count("*").alias("pages"), *[F.count_if(F.col("text_status") == s).alias(s) for s in ("usable", "partial", "unreadable", "image_only", "unknown")])


def block_text(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Lines of a block as its text: joined by a space; a hyphen after a letter goes when the next
    line starts in lower case, as do soft hyphens; then NFKC, no control or private characters, and
    white space collapses. Lines are pre-grouped by block, which a page bounds."""
    w = Window.partitionBy(*keys).orderBy(order)
    after = F.lead("text").over(w)
    soft = F.col("text").rlike(r"\p{L}[-‐]$") & F.coalesce(after.rlike(r"^\p{Ll}"), F.lit(False))
    part = F.when(soft, F.expr("substr(text, 1, length(text) - 1)")).when(after.isNull(), F.col("text")).otherwise(F.concat("text", F.lit(" ")))
    joined = lines.withColumn("part", part).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "part"))), lambda x: x["part"]), "").alias("text"))
    plain = nfkc(joined.withColumn("text", F.regexp_replace("text", "­", "")), "text")
    return plain.withColumn("text", F.trim(F.regexp_replace(F.regexp_replace("text", r"[\p{Cc}\p{Co}]", ""), " +", " ")))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The first value whose running weight reaches half of the group's. Rows are pre-aggregated by value."""
    h = df.groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    run = F.sum("w").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("w").over(Window.partitionBy(*keys))
    return h.withColumns({"run": run, "total": total}).filter(2 * F.col("run") >= F.col("total")).groupBy(*keys).agg(F.min(value).alias("median"))


#: A numeric citation: "3", "3, 7", "12–15", "1,2;5-7" in square brackets of 80 characters at most.
CITED = r"\[(\s*\d+(?:\s*[,;–—-]\s*\d+)*\s*)\]"


def link_citations(blocks: DataFrame) -> DataFrame:
    """The numbers that numeric citations of body text name, each with the reference entry of that
    number, if there is one: the first block that begins with ``[n]`` or ``n.``, else the first of joined entries that
    holds ``[n]`` among them. Blocks that begin with ``[n]`` are entries and cite nothing.

    With a column ``regions``, a box for each line, ``line`` is the box of the line of the entry where its block has
    as many lines as entries, else null.
    """
    is_entry = F.col("text").rlike(r"^\s*\[\d+\]")
    groups = F.filter(F.regexp_extract_all("text", F.lit(CITED), F.lit(1)), lambda g: F.length(g) <= 80)
    numbers = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"(\d+)"), F.lit(1))))
    cited = body_blocks(blocks).filter(~is_entry).select("version_id", "p", F.explode(numbers).alias("n")).select("version_id", "p", F.col("n").cast("int").alias("n")).filter("n is not null").distinct()
    joined = F.regexp_extract_all(F.trim("text"), F.lit(r"(?:^|\s)\[(\d+)\]"), F.lit(1))
    dotted = F.regexp_extract_all(F.trim("text"), F.lit(r"^(\d+)\.\s"), F.lit(1))
    found = F.when(is_entry, joined).otherwise(dotted)
    lines = ["regions"] if "regions" in blocks.columns else []
    each = blocks.select("version_id", "p", *lines, F.size(found).alias("many"), F.posexplode(found).alias("at", "n"))
    line = [F.when(F.size("regions") == F.col("many"), F.get("regions", F.col("at"))).alias("line")] if lines else []
    entries = each.select("version_id", F.col("n").cast("int").alias("n"), F.struct((F.col("at") > 0).alias("later"), "p", "at", *line).alias("entry")).filter("n is not null")
    first = entries.groupBy("version_id", "n").agg(F.min_by("entry", F.struct("entry.later", "entry.p", "entry.at")).alias("e"))
    return cited.join(first.select("version_id", "n", F.col("e.p").alias("entry_p"), *([F.col("e.line").alias("line")] if lines else [])), ["version_id", "n"], "left")


def neighbours(blocks: DataFrame, reach: int | None = 2) -> DataFrame:
    """The nearest body block of equal font size before and after each body block, at most ``reach`` pages away, or on any page."""
    b = body_blocks(blocks)
    w = Window.partitionBy("version_id", "font_size").orderBy("p")
    near = lambda x: x["p"] if reach is None else F.when(F.abs(x["page_index"] - F.col("page_index")) <= reach, x["p"])
    at = F.struct("p", "page_index")
    return b.select("version_id", "p", near(F.lag(at).over(w)).alias("before"), near(F.lead(at).over(w)).alias("after"))


def title_from_blocks(blocks: DataFrame) -> DataFrame:
    """The title of each version from its first page: the largest candidate, the first of equals, if it is
    1.15 times the weighted median size, with neighbours of its size (within 0.5), those before it
    first, three blocks in all. Candidates begin in the top half, are a fifth of the page wide and have two
    words. Footnote marks behind it go; a title above 300 characters is none."""
    first = blocks.filter("page_index = 0")
    median = weighted_median(body_blocks(first).withColumn("chars", F.length("text")), ["version_id"], "font_size", "chars")
    body = (F.trim("text") != "") & ~F.coalesce(not_body(F.col("quality_flags")), F.lit(False))
    words = F.size(F.regexp_extract_all("text", F.lit(r"(\p{L}{2,})"), F.lit(1)))
    can = F.coalesce(body & (F.col("y0") < 0.5) & (F.col("x1") - F.col("x0") >= 0.2) & (words >= 2) & F.col("font_size").isNotNull(), F.lit(False))
    page = first.groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct("p", "text", "font_size", can.alias("can")))).alias("bs"))
    page = page.withColumn("best", F.array_max(F.transform(F.filter(F.transform("bs", lambda x, i: F.struct(x["font_size"].alias("size"), (-i).alias("at"), x["can"].alias("can"))), lambda x: x["can"]), lambda x: F.struct(x["size"].alias("size"), x["at"].alias("at")))))
    at, size = -F.col("best.at"), F.col("best.size")

    def same(offset: int) -> Column:
        x = F.get("bs", at + offset)
        return F.coalesce((at + offset >= 0) & x["can"] & (F.abs(x["font_size"] - size) <= 0.5), F.lit(False))

    before = F.when(same(-1) & same(-2), 2).when(same(-1), 1).otherwise(0)
    behind = F.when(same(1) & same(2), 2).when(same(1), 1).otherwise(0)
    page = page.filter("best is not null").withColumns({"before": before, "behind": F.least(behind, 2 - before)})
    parts = F.transform(F.slice("bs", at + 1 - F.col("before"), F.col("before") + 1 + F.col("behind")), lambda x: F.trim(F.regexp_replace(x["text"], r"\s+", " ")))
    title = F.trim(F.regexp_replace(F.array_join(parts, " "), r"[*∗†‡§¶]+$", ""))
    found = page.join(median, "version_id").filter(size >= 1.15 * F.col("median")).select("version_id", title.alias("title"))
    return found.filter(F.length("title").between(1, 300))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Reading order of a page: full-width blocks split it into bands; in a band the left column
    comes before the right one. A page without both columns keeps its order."""
    mid = (F.col("x0") + F.col("x1")) / 2
    side = F.when((F.col("x1") <= 0.52), "left").when(F.col("x0") >= 0.48, "right").otherwise("full")
    b = blocks.withColumns({"side": side, "mid": mid, "chars": F.length("text")})
    page = Window.partitionBy("version_id", "page_index")
    share = lambda s: F.sum(F.when(F.col("side") == s, F.col("chars")).otherwise(0)).over(page) / F.sum("chars").over(page)
    b = b.withColumn("two_columns", (share("left") >= 0.25) & (share("right") >= 0.25))
    above = F.count_if(F.col("side") == "full").over(page.orderBy("y0", "p").rowsBetween(Window.unboundedPreceding, -1))
    b = b.withColumn("band", F.when(F.col("two_columns"), above).otherwise(0))
    rank = F.when(F.col("side") == "left", 0).when(F.col("side") == "right", 1).otherwise(2)
    order = F.when(F.col("two_columns"), F.struct("band", rank.alias("k"), "y0", "p")).otherwise(F.struct(F.lit(0).cast("long").alias("band"), F.lit(0).alias("k"), F.lit(0.0).alias("y0"), "p"))
    return b.withColumn("_o", order).select("version_id", "p", "page_index", "two_columns", (F.row_number().over(page.orderBy("_o")) - 1).alias("order"))


def style_runs(chars: DataFrame, keys: list[str]) -> DataFrame:
    """Runs [start, end) of equal marks over (position, mark); unmarked characters make none. With a column
    ``char``, spaces between two equal marks belong to their run, and other spaces to none."""
    w = Window.partitionBy(*keys).orderBy("position")
    if "char" in chars.columns:
        blank = F.col("char").rlike(r"^\s$")
        own = F.when(~blank, F.coalesce("mark", F.lit("")))
        before = F.last(own, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        behind = F.first(own, True).over(w.rowsBetween(1, Window.unboundedFollowing))
        chars = chars.withColumn("mark", F.when(blank, F.when((before == behind) & (before != ""), before)).otherwise(F.col("mark")))
    new = F.when(F.col("mark").eqNullSafe(F.lag("mark").over(w)) & (F.col("position") == F.lag("position").over(w) + 1), 0).otherwise(1)
    runs = chars.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.filter("mark is not null").groupBy(*keys, "run", "mark").agg(F.min("position").alias("start"), (F.max("position") + 1).alias("end")).drop("run")


def flag_covered(blocks: DataFrame, regions: DataFrame, share: float = 0.5) -> DataFrame:
    """The best region label that covers a share of a block's box, by page and overlap."""
    r = regions.select("version_id", "page_index", "label", "score", F.col("x0").alias("a0"), F.col("y0").alias("b0"), F.col("x1").alias("a1"), F.col("y1").alias("b1"))
    wide = F.greatest(F.lit(0.0), F.least("x1", "a1") - F.greatest("x0", "a0"))
    high = F.greatest(F.lit(0.0), F.least("y1", "b1") - F.greatest("y0", "b0"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    hit = blocks.join(r, ["version_id", "page_index"]).filter(wide * high >= share * area)
    return hit.groupBy("version_id", "p").agg(F.max_by("label", F.struct("score", "label")).alias("label"))


# fixed values: names of operators that stand in formulas
OPERATOR_NAMES = ("sin", "cos", "tan", "log", "ln", "exp", "max", "min", "arg", "lim", "sup", "inf", "mod", "det", "dim", "ker", "deg", "gcd", "lcm")
MATH_SIGN = r"[=<>+∑∏∫√∂∇≤≥≠≈∈∉⊂⊆∪∩∀∃±×÷·∞]"


def flag_math(blocks: DataFrame) -> DataFrame:
    """Display math: no caption, and an equation label at the end with a sign, or at most one distinct
    prose word beside a sign or operator names only."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1)), lambda w: ~w.isin(*OPERATOR_NAMES)))
    sign = F.col("text").rlike(MATH_SIGN)
    named = F.size(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{2,})"), F.lit(1)), lambda w: w.isin(*OPERATOR_NAMES))) > 0
    label = F.col("text").rlike(r"\(\d+(?:\.\d+)*[a-z]?\)$")
    math = ~F.col("text").rlike(CAPTION) & ((label & sign) | ((F.size(words) <= 1) & (sign | ((F.size(words) == 0) & named))))
    return blocks.select("version_id", "p", math.alias("math"))


def block_quality(lines: DataFrame) -> DataFrame:
    """Flags of each block from its lines (version_id, block, glyphs, math_glyphs, turned, unmapped, size):
    unmapped if any line is, math from half of the glyphs, side text above half, and the median size."""
    g = lines.groupBy("version_id", "block").agg(F.bool_or("unmapped").alias("unmapped_chars"), (F.sum("math_glyphs") >= 0.5 * F.sum("glyphs")).alias("math"), (F.sum("turned") > 0.5 * F.sum("glyphs")).alias("side_text"), F.round(F.median("size"), 2).alias("font_size"))
    return g


#: Share of the body size of the page below which a block is small.
LABEL_SIZE, LABEL_WORDS = 0.85, 6


def flag_equation_labels(blocks: DataFrame, math: DataFrame) -> DataFrame:
    """Short small body blocks right above or below display math: they overlap it from left to right and the
    gap is at most their own height. Small is below 0.85 of the weighted median size of the page's
    body text; math is no body text, and captions are no labels."""
    body = body_blocks(blocks).join(math.select("version_id", "p"), ["version_id", "p"], "left_anti")
    size = weighted_median(body.withColumn("chars", F.length("text")), ["version_id", "page_index"], "font_size", "chars")
    small = body.filter((F.size(F.split(F.trim("text"), r"\s+")) <= LABEL_WORDS) & ~F.col("text").rlike(CAPTION)).join(size, ["version_id", "page_index"]).filter(F.col("font_size") < LABEL_SIZE * F.col("median"))
    m = math.select("version_id", "page_index", *[F.col(x).alias(f"m_{x}") for x in ("x0", "y0", "x1", "y1")])
    high = F.col("y1") - F.col("y0")
    near = (F.col("m_x0") < F.col("x1")) & (F.col("x0") < F.col("m_x1")) & ((F.abs(F.col("y0") - F.col("m_y1")) <= high) | (F.abs(F.col("m_y0") - F.col("y1")) <= high))
    return small.join(m, ["version_id", "page_index"]).filter(near).select("version_id", "p").distinct()


def repair_titles(papers: DataFrame, found: DataFrame) -> DataFrame:
    """Titles that look like file names (no white space, or a document extension) give way to the found one."""
    like_file = F.col("title").isNull() | ~F.trim("title").rlike(r"\s") | F.col("title").rlike(r"(?i)\.(?:pdf|docx?|tex|ps|dvi|indd)$")
    f = found.select("version_id", F.col("title").alias("found"))
    return papers.join(f, "version_id", "left").withColumn("title", F.when(like_file, F.coalesce("found", "title")).otherwise(F.col("title"))).drop("found")


def paper_identifiers(papers: DataFrame, blocks: DataFrame, margins: DataFrame | None = None) -> DataFrame:
    """Identifiers of each paper in the order to ask for: an arXiv id in its DOI, else the DOI, then that in
    the turned text of the first page (``margins``: version_id, arxiv), else the first one in its blocks."""
    arxiv = F.regexp_extract("text", r"arXiv:(\d{4}\.\d{4,5})", 1)
    found = blocks.filter("page_index = 0").filter(F.col("text").rlike(r"arXiv:\d{4}\.\d{4,5}")).groupBy("version_id").agg(F.min_by(arxiv, "p").alias("arxiv"))
    if margins is not None:
        turned = margins.select("version_id", F.col("arxiv").alias("turned"))
        found = found.join(turned, "version_id", "full").select("version_id", F.coalesce("turned", "arxiv").alias("arxiv"))
    own = F.regexp_extract("doi", r"(?i)^10\.48550/arxiv\.(\d{4}\.\d{4,5})$", 1)
    first = F.when(own != "", F.concat(F.lit("arxiv:"), own)).when(F.coalesce("doi", F.lit("")) != "", F.concat(F.lit("doi:"), F.col("doi")))
    ids = F.array_distinct(F.array_compact(F.array(first, F.concat(F.lit("arxiv:"), F.col("arxiv")))))
    return papers.join(found, "version_id", "left").select("paper_id", F.posexplode(ids).alias("ordinal", "identifier"))


def script_marks(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """Superscripts and subscripts: glyphs of at most 0.85 of the line's median size whose centre is
    more than 0.15 of the line's height off; a line is the window."""
    w = Window.partitionBy(*keys)
    size, mid = F.col("t") - F.col("b"), (F.col("t") + F.col("b")) / 2
    g = glyphs.withColumns({"size": size, "mid": mid}).withColumn("usual", F.median("size").over(w))
    g = g.withColumn("base", F.median(F.when(F.col("size") > 0.85 * F.col("usual"), F.col("mid"))).over(w))
    off = F.col("mid") - F.col("base")
    mark = F.when((F.col("size") <= 0.85 * F.col("usual")) & (F.abs(off) > 0.15 * F.col("usual")), F.when(off > 0, "^").otherwise("_"))
    return g.withColumn("mark", mark).drop("size", "mid", "usual", "base")


def remap_glyphs(glyphs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Glyphs (font, code, text) by a dictionary (code, mapped), for fonts whose mapped text has eight
    letters and three tenths vowels. Counts by font gate the replacement."""
    j = glyphs.join(dictionary, "code", "left")
    letters = F.length(F.regexp_replace(F.coalesce("mapped", F.lit("")), "[^A-Za-z]", ""))
    vowels = F.length(F.regexp_replace(F.coalesce("mapped", F.lit("")), "[^AEIOUaeiou]", ""))
    ok = j.groupBy("font").agg(F.sum(letters).alias("l"), F.sum(vowels).alias("v")).filter("l >= 8 and v >= 0.3 * l").select("font", F.lit(True).alias("ok"))
    return j.join(ok, "font", "left").withColumn("text", F.when(F.col("ok"), F.coalesce("mapped", "text")).otherwise(F.col("text"))).drop("mapped", "ok")


def paragraph_chains(blocks: DataFrame) -> DataFrame:
    """Paragraphs split over pages: the first body block of a page that starts in lower case goes on
    with the last one of the page before, if their sizes agree. chain is the p of the first part."""
    b = body_blocks(blocks)
    w = Window.partitionBy("version_id").orderBy("p")
    first = F.lag("page_index").over(w) == F.col("page_index") - 1
    joins = first & F.col("text").rlike(r"^\p{Ll}") & (F.lag("font_size").over(w) == F.col("font_size"))
    return b.withColumn("joins", F.coalesce(joins, F.lit(False))).withColumn("chain", F.max(F.when(~F.col("joins"), F.col("p"))).over(w.rowsBetween(Window.unboundedPreceding, 0))).select("version_id", "p", "chain", "joins")


def blocks_under(anchors: DataFrame, blocks: DataFrame, share: float = 0.5) -> DataFrame:
    """Blocks that cover a share of an anchor's box (anchor_id, version_id, page_index, a0, b0, a1, b1)."""
    wide = F.greatest(F.lit(0.0), F.least("x1", "a1") - F.greatest("x0", "a0"))
    high = F.greatest(F.lit(0.0), F.least("y1", "b1") - F.greatest("y0", "b0"))
    return anchors.join(blocks, ["version_id", "page_index"]).filter(wide * high >= share * (F.col("a1") - F.col("a0")) * (F.col("b1") - F.col("b0"))).select("anchor_id", "version_id", "p")


def nearest_caption(anchors: DataFrame, blocks: DataFrame, reach: float = 0.08) -> DataFrame:
    """The caption with the smallest gap to each anchor's box on its page, within reach; the first of ties."""
    c = blocks.filter(F.col("text").rlike(CAPTION))
    gap_x = F.greatest(F.lit(0.0), F.col("x0") - F.col("a1"), F.col("a0") - F.col("x1"))
    gap_y = F.greatest(F.lit(0.0), F.col("y0") - F.col("b1"), F.col("b0") - F.col("y1"))
    near = anchors.join(c, ["version_id", "page_index"]).withColumn("gap", F.greatest(gap_x, gap_y)).filter(F.col("gap") <= reach)
    return near.groupBy("anchor_id").agg(F.min_by("p", F.struct("gap", "p")).alias("caption_p"))


def validate_anchors(anchors: DataFrame, counts: DataFrame) -> DataFrame:
    """The first rule that each anchor (version_id, page_index, kind, quote, quads) breaks: its page, a
    quad of eight numbers with an area whose sides do not cross, a quote for text, one quad for a region."""
    side = lambda q, i, j, k: (q[2 * j] - q[2 * i]) * (q[2 * k + 1] - q[2 * i + 1]) - (q[2 * k] - q[2 * i]) * (q[2 * j + 1] - q[2 * i + 1])  # noqa: E731  which side of the line i-j corner k is on
    apart = lambda q, i, j, k, m: side(q, i, j, k) * side(q, i, j, m) < 0
    cross = lambda q, i, j, k, m: apart(q, i, j, k, m) & apart(q, k, m, i, j)
    crossing = lambda q: cross(q, 0, 1, 2, 3) | cross(q, 1, 2, 3, 0)
    area = lambda q: F.abs((q[4] - q[0]) * (q[7] - q[3]) - (q[6] - q[2]) * (q[5] - q[1])) / 2  # noqa: E731  half the cross product of the diagonals (TL-BR, TR-BL)
    a = anchors.join(counts.select("version_id", "page_count"), "version_id", "left")
    reason = (
        F.when(F.col("page_count").isNull() | (F.col("page_index") < 0) | (F.col("page_index") >= F.col("page_count")), "page").when(F.exists("quads", lambda q: (F.size(q) != 8)), "quad")
        .when(F.exists("quads", crossing), "crossing").when(F.exists("quads", lambda q: area(q) < 1e-9), "area").when((F.col("kind") == "text") & (F.coalesce(F.trim("quote"), F.lit("")) == ""), "quote").when((F.col("kind") == "region") & (F.size("quads") != 1), "quads")
    )
    return a.select("anchor_id", reason.alias("reason"))


def block_line_height(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """Median over the lines (version_id, page_index, block_id, box of four) of a block of the lesser of
    width and height in points."""
    b = regions.join(pages.select("version_id", "page_index", "width", "height"), ["version_id", "page_index"])
    least = F.least((F.get("box", F.lit(2)) - F.get("box", F.lit(0))) * F.col("width"), (F.get("box", F.lit(3)) - F.get("box", F.lit(1))) * F.col("height"))
    return b.groupBy("version_id", "page_index", "block_id").agg(F.median(least).alias("line_height"))
