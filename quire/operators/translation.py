"""Sentences and their alignment with translations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed
from .structure import body_blocks

# fixed values: abbreviations that end no sentence
ABBREVIATIONS = (
    "e.g", "i.e", "al", "etc", "vs", "cf", "fig", "figs", "eq", "eqs", "sec", "secs", "ref", "refs", "no", "nos",
    "vol", "pp", "p", "resp", "approx", "ch", "def", "thm", "lem", "prop", "alg", "tab", "dr", "prof", "mr", "ms",
)
ENDS = r"""[.!?。！？]["'”’)\]]*$"""
GROUP_CHARS, MOST_GROUPS, CONTEXT_CHARS = 600, 4, 400


def _cut(text: Column) -> Column:
    """A text whose white space is spaces, with a line break for the first space behind each sentence. A sentence ends with
    an end mark, no lower-case start behind it, and for a full stop neither an abbreviation nor a single letter before it."""
    marked = F.regexp_replace(text, r"""([.!?。！？]["'”’)\]]*) (?= *+[^ \p{Ll}])""", "$1\n")
    held = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    # the look ahead is cheap and leaves few words for the list
    return F.regexp_replace(marked, rf"""(?<![^ \n])(?=[(\["'“‘]*+[^ \n]{{1,{max(map(len, ABBREVIATIONS))}}}\.["'”’)\]]*+\n)([(\["'“‘]*(?:(?i:{held})|[\p{{L}}&&[^İ]])\.["'”’)\]]*)\n""", "$1 ")


def sentence_array(text: Column) -> Column:
    """The sentences of a text as an array, white space inside them as one space. Two passes of a pattern over each
    row: no shuffle, no Python, and time linear in the text."""
    return F.filter(F.split(_cut(collapsed(text)), "\n"), lambda x: x != "")


def sentences(blocks: DataFrame) -> DataFrame:
    return blocks.select("version_id", "p", F.posexplode(sentence_array(F.col("text"))).alias("sentence_no", "sentence"))


def sentence_spans(blocks: DataFrame) -> DataFrame:
    """(version_id, p, sentence_no, start, end, sentence): the sentences of each block with the offsets of their first
    character and behind their last one in the text as it is. Each character of white space counts as one space."""
    parts = F.split(_cut(F.regexp_replace("text", r"(?U)\s", " ")), "\n")
    ends = lambda ps: F.aggregate(ps, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x) + 1)))
    placed = F.get(F.transform(F.array(parts), lambda ps: F.zip_with(ps, F.slice(ends(ps), F.lit(1), F.size(ps)), lambda x, at: F.struct(x.alias("part"), at.alias("at")))), F.lit(0))
    b = blocks.select("version_id", "p", F.posexplode(placed).alias("sentence_no", "x")).select("version_id", "p", "sentence_no", "x.part", "x.at").filter(F.trim("part") != "")
    start = F.col("at") + F.length("part") - F.length(F.ltrim("part"))
    return b.select("version_id", "p", "sentence_no", start.alias("start"), (F.col("at") + F.length(F.rtrim("part"))).alias("end"), F.regexp_replace(F.trim("part"), " +", " ").alias("sentence"))


def reuse_translations(blocks: DataFrame, stored: DataFrame) -> DataFrame:
    """Pages of which every body block has an unused stored block (source, sentences) with its text and
    number of sentences; the k-th of equal ones takes the k-th."""
    w = Window.partitionBy("version_id", "page_index", "source").orderBy("p")
    n = body_blocks(blocks).select("version_id", "page_index", "p", F.col("text").alias("source"), F.size(sentence_array(F.col("text"))).alias("n"))
    have = stored.select("version_id", "page_index", "source", F.col("n").alias("have"), F.row_number().over(w).alias("k"))
    j = n.withColumn("k", F.row_number().over(w)).join(have, ["version_id", "page_index", "source", "k"], "left")
    return j.groupBy("version_id", "page_index").agg(F.every(F.coalesce(F.col("have") == F.col("n"), F.lit(False))).alias("reused"))


def validate_translations(blocks: DataFrame, incoming: DataFrame) -> DataFrame:
    """Problems of incoming translations (version_id, p, n sentences): missing, unknown or of another count."""
    want = body_blocks(blocks).select("version_id", "p", F.size(sentence_array(F.col("text"))).alias("want"))
    j = want.join(incoming.select("version_id", "p", "n"), ["version_id", "p"], "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("want").isNull(), "unknown").when(F.col("n") != F.col("want"), "count")
    return j.select("version_id", "p", problem.alias("problem")).filter("problem is not null")


def continued_blocks(blocks: DataFrame) -> DataFrame:
    """Body blocks that go on with the sentence of the body block before them: that one has no end
    mark, no math stands between, and this one starts in lower case with a first sentence of at
    most half of its length."""
    w = Window.partitionBy("version_id").orderBy("p")
    math = F.max(F.when(F.array_contains("quality_flags", "math"), F.col("p"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = body_blocks(blocks.withColumn("math_p", math)).withColumns({"was": F.lag("text").over(w), "was_p": F.lag("p").over(w)})
    open_ = ~F.trim("was").rlike(ENDS) & ~F.col("was").rlike(r"^(?:Fig\.|Figure|Table) +\d+")
    first = F.get(sentence_array(F.col("text")), F.lit(0))
    return b.filter(open_ & (F.coalesce("math_p", F.lit(-1)) < F.col("was_p")) & F.col("text").rlike(r"^\p{Ll}") & (2 * F.length(first) <= F.length("was"))).select("version_id", "p", "was_p")


def _fits(rest: Column) -> Callable[[Column], Column]:
    """Cuts up to which the batch, and behind which the ``rest``, stays within ``worst``."""
    return lambda m: (F.get("sums", m) - F.get("sums", F.col("at")) <= F.col("worst")) & (F.get(rest, m) <= F.col("worst"))


def translation_batches(blocks: DataFrame) -> DataFrame:
    """Body blocks of each page in at most four batches whose largest is as small as it can be; of
    equal choices the one with the earliest cuts. ``context`` of the first block of a batch is the end of the block before
    it, 400 characters at most, or null; later blocks have none. ``f_j`` holds, for each place, the least largest batch
    of what follows in j batches, so a page of n blocks takes n * n steps."""
    b = body_blocks(blocks).groupBy("version_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("p", F.length("text").alias("n")))).alias("bs"))
    sizes = F.transform("bs", lambda x: x["n"].cast("long"))
    count = F.size("bs")
    zero = F.array(F.lit(0).cast("long"))
    b = b.withColumn("sums", F.aggregate(sizes, zero, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))))
    total = F.element_at("sums", -1)
    b = b.withColumn("k", F.greatest(F.lit(1), F.least(F.lit(MOST_GROUPS), F.floor(total / GROUP_CHARS), count)).cast("int"))
    between = lambda i, m: F.get("sums", m) - F.get("sums", i)
    b = b.withColumn("f1", F.transform(F.sequence(F.lit(0), count), lambda i: total - F.get("sums", i)))
    for j in range(2, MOST_GROUPS + 1):
        # no place is left for j batches within the last j - 1 blocks
        rest = lambda i, f=f"f{j - 1}": F.array_min(F.transform(F.sequence(i + 1, F.greatest(i + 1, count - 1)), lambda m: F.when((m < count) & F.get(f, m).isNotNull(), F.greatest(between(i, m), F.get(f, m)))))  # noqa: E731  greatest passes over nulls
        b = b.withColumn(f"f{j}", F.transform(F.sequence(F.lit(0), count), lambda i: F.when(i < count, rest(i))))
    b = b.withColumns({"worst": F.get(F.get(F.array(*[F.col(f"f{j}") for j in range(1, MOST_GROUPS + 1)]), F.col("k") - 1), F.lit(0)), "at": F.lit(0)})
    for c in range(1, MOST_GROUPS):
        left = F.col("k") - c  # batches behind this cut
        f = F.get(F.array(*[F.col(f"f{j}") for j in range(1, MOST_GROUPS + 1)]), left - 1)
        cut = F.array_min(F.filter(F.sequence(F.col("at") + 1, F.greatest(F.col("at") + 1, count - 1)), _fits(f)))
        b = b.withColumn(f"cut{c}", F.when(left > 0, cut)).withColumn("at", F.coalesce(F.col(f"cut{c}"), F.col("at")))
    chosen = b.select("version_id", "page_index", "worst", *[f"cut{c}" for c in range(1, MOST_GROUPS)], F.posexplode("bs").alias("i", "x"))
    batch = sum((F.when(F.col("i") >= F.col(f"cut{c}"), 1).otherwise(0) for c in range(1, MOST_GROUPS)), F.lit(0))
    out = chosen.select("version_id", "page_index", "x.p", batch.cast("int").alias("batch"), F.col("worst").alias("largest"))
    was = F.lag("text").over(Window.partitionBy("version_id").orderBy("p"))
    before = body_blocks(blocks).select("version_id", "p", F.substring(was, -CONTEXT_CHARS, CONTEXT_CHARS).alias("before"))
    starts = F.coalesce(F.lag("batch").over(Window.partitionBy("version_id", "page_index").orderBy("p")), F.lit(-1)) != F.col("batch")
    return out.withColumn("starts", starts).join(before, ["version_id", "p"]).withColumn("context", F.when(F.col("starts"), F.col("before"))).drop("starts", "before")


def sentence_groups(translated: DataFrame) -> DataFrame:
    """Translated sentences (version_id, p, sentence_no, translation): an empty translation joins the group before it."""
    w = Window.partitionBy("version_id", "p").orderBy("sentence_no").rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy("version_id", "p").orderBy("sentence_no")) == 1
    t = translated.withColumn("starts", F.when((F.coalesce("translation", F.lit("")) != "") | first, 1).otherwise(0)).withColumn("grp", F.sum("starts").over(w))
    return t.groupBy("version_id", "p", "grp").agg(F.min("sentence_no").alias("first_no"), F.max("sentence_no").alias("last_no"), F.min_by("translation", "sentence_no").alias("translation"))


def translated_pages(translations: DataFrame) -> DataFrame:
    """Pages of each version and language that have a translation."""
    return translations.groupBy("version_id", "language").agg(F.count_distinct("page_index").alias("n"), F.array_join(F.array_sort(F.collect_set("page_index")).cast("array<string>"), ",").alias("pages"))
