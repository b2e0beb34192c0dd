"""Evidence packets under character budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.canonical import canonical_json

MAX_CHARS = 12_000


def scope_pages(requests: DataFrame, counts: DataFrame, reference_pages: DataFrame) -> DataFrame:
    """Wanted pages of each request (request_id, version_id, scope, page): the page, all pages, those
    up to it, or those around it, the last two with the reference pages. A page past the end is
    clamped for ``until_page`` and empties the others."""
    r = requests.join(counts.select("version_id", "page_count"), "version_id")
    last = F.col("page_count") - 1
    inside = F.col("page") <= last
    span = (
        F.when(F.col("scope") == "paper", F.sequence(F.lit(0), last)).when(F.col("scope") == "until_page", F.sequence(F.lit(0), F.least("page", last)))
        .when((F.col("scope") == "page") & inside, F.array("page")).when((F.col("scope") == "around_page") & inside, F.sequence(F.greatest(F.col("page") - 1, F.lit(0)), F.least(F.col("page") + 1, last)))
    )
    own = r.withColumn("span", span).filter("span is not null")
    refs = own.filter(F.col("scope").isin("until_page", "around_page")).join(reference_pages, "version_id").select("request_id", "version_id", "page_index")
    return own.select("request_id", "version_id", F.explode("span").alias("page_index")).unionByName(refs).distinct()


def page_text_evidence(blocks: DataFrame, budget: int = MAX_CHARS) -> DataFrame:
    """Body text of each page, a blank line between blocks, margins dropped but on the first page,
    taken in order until the budget ends: the page that crosses it is cut, the next is named as
    excluded, later ones are not."""
    margin = (F.col("y1") <= 0.1) | (F.col("y0") >= 0.9)
    kept = blocks.filter((F.col("page_index") == 0) | ~margin)
    pages = kept.groupBy("version_id", "page_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    w = Window.partitionBy("version_id").orderBy("page_index")
    used = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = pages.withColumn("left", F.lit(budget) - used)
    # the first page that finds nothing left follows one that did
    out = left.withColumn("found", F.col("left") > 0).withColumn("was", F.lag("found").over(w)).filter("found or was")
    text = F.when(F.col("found"), F.expr("substr(text, 1, cast(left as int))"))
    return out.select("version_id", "page_index", text.alias("text"), (F.col("found") & (F.length("text") > F.col("left"))).alias("truncated"), (~F.col("found")).alias("excluded")).withColumn("paragraphs", F.when(F.col("excluded"), 0).otherwise(F.size(F.split("text", "\n\n"))))


def apply_budget(items: DataFrame, budget: int = MAX_CHARS) -> DataFrame:
    """Items of each packet (packet_id, rank, block_id, text) in order of rank, each whole or not at
    all, no block twice; a later, smaller one may still fit. A fold, as skips change what is left."""
    zero = F.struct(F.lit(budget).alias("left"), F.array().cast("array<long>").alias("used"), F.array().cast("array<struct<rank:int,kept:boolean,reason:string>>").alias("out"))

    def step(a, x):
        row = lambda kept, reason: F.array(F.struct(x["rank"].alias("rank"), F.lit(kept).alias("kept"), F.lit(reason).cast("string").alias("reason")))
        return (
            F.when(F.array_contains(a["used"], x["block_id"]), F.struct(a["left"].alias("left"), a["used"].alias("used"), F.concat(a["out"], row(False, "repeated")).alias("out")))
            .when(x["n"] > a["left"], F.struct(a["left"].alias("left"), a["used"].alias("used"), F.concat(a["out"], row(False, "text_budget")).alias("out")))
            .otherwise(F.struct((a["left"] - x["n"]).alias("left"), F.concat(a["used"], F.array(x["block_id"])).alias("used"), F.concat(a["out"], row(True, None)).alias("out")))
        )

    g = items.groupBy("packet_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("block_id").cast("long").alias("block_id"), F.length("text").alias("n")))).alias("xs"))
    return g.select("packet_id", F.explode(F.aggregate("xs", zero, step, lambda a: a["out"])).alias("r")).select("packet_id", "r.*")


#: Roles of context in the order in which they take from the budget, behind the selections.
CONTEXT_ROLES = ("caption", "region_text", "containing_paragraph", "previous_paragraph", "following_paragraph")


def apply_role_budget(items: DataFrame, budget: int = MAX_CHARS) -> DataFrame:
    """Items of each packet (packet_id, rank, role, block_ids, text) within its budget: selections first in
    order of rank, each cut to what is left; then the context, role by role, whole or not at all
    and without blocks that context already holds. ``chars`` is what is kept of the text. Context
    that does not fit is excluded as ``text_budget``; repeated blocks leave without a reason."""
    order = F.array_position(F.array(*map(F.lit, ("selection", *CONTEXT_ROLES))), F.col("role"))
    one = F.struct(order.alias("o"), "rank", "role", F.col("block_ids").cast("array<long>").alias("ids"), F.length("text").alias("n"))
    zero = F.struct(F.lit(budget).alias("left"), F.array().cast("array<long>").alias("used"), F.array().cast("array<struct<rank:int,role:string,chars:int,kept:boolean,reason:string>>").alias("out"))

    def step(a, x):
        row = lambda chars, kept, reason: F.concat(a["out"], F.array(F.struct(x["rank"].alias("rank"), x["role"].alias("role"), chars.alias("chars"), F.lit(kept).alias("kept"), F.lit(reason).cast("string").alias("reason"))))
        state = lambda left, used, out: F.struct(left.alias("left"), used.alias("used"), out.alias("out"))
        cut = F.least(x["n"], a["left"])
        return (
            F.when(x["role"] == "selection", state(a["left"] - cut, a["used"], row(cut, True, None)))
            .when(F.arrays_overlap(a["used"], x["ids"]), state(a["left"], a["used"], row(F.lit(0), False, None)))
            .when(x["n"] > a["left"], state(a["left"], a["used"], row(F.lit(0), False, "text_budget")))
            .otherwise(state(a["left"] - x["n"], F.concat(a["used"], x["ids"]), row(x["n"], True, None)))
        )

    g = items.groupBy("packet_id").agg(F.array_sort(F.collect_list(one)).alias("xs"))
    return g.select("packet_id", F.explode(F.aggregate("xs", zero, step, lambda a: a["out"])).alias("r")).select("packet_id", "r.*")


#: Greek letters, mathematical operators, brackets, signs and letters.
# fixed values: Unicode ranges of letters and signs of mathematics
MATH_RANGES = (
    (0x0370, 0x03FF),  # Greek
    (0x2200, 0x22FF),  # mathematical operators
    (0x2308, 0x230B),  # ceilings and floors
    (0x27C0, 0x27EF),  # miscellaneous mathematical symbols A
    (0x2980, 0x2AFF),  # miscellaneous mathematical symbols B and supplemental operators
    (0x1D400, 0x1D7FF),  # mathematical letters and digits
)
MATH_LIKE = "[" + "".join(rf"\x{{{a:04X}}}-\x{{{z:04X}}}" for a, z in MATH_RANGES) + "]"


def is_math_like(quote: Column, display_quote: Column) -> Column:
    """Text selections that their text cannot stand for alone: with a display form, or a mathematical sign."""
    return display_quote.isNotNull() | F.coalesce(quote.rlike(MATH_LIKE), F.lit(False))


def image_candidates(selections: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Selections (packet_id, rank, anchor_id, kind, quote, display_quote) with ``eligible``: regions, and texts
    that are math-like or unreadable (anchor_id, unreadable)."""
    u = unreadable.filter("unreadable").select(F.col("anchor_id").alias("u_id")).distinct()
    j = selections.join(u, selections["anchor_id"] == u["u_id"], "left")
    return j.withColumn("eligible", (F.col("kind") == "region") | is_math_like(F.col("quote"), F.col("display_quote")) | F.col("u_id").isNotNull()).drop("u_id")


def content_sha256(packets: DataFrame, columns: list[str]) -> DataFrame:
    """SHA-256 of the canonical JSON of the columns: keys sorted at every depth, one form of each number, nulls kept."""
    kinds = [packets.schema[c] for c in columns]
    body = canonical_json(F.struct(*columns), StructType(kinds))
    return packets.withColumn("content_sha256", F.sha2(body, 256))


def image_quota(items: DataFrame, most: int = 2) -> DataFrame:
    """The first eligible items of each packet in order get an image, the others are excluded."""
    w = Window.partitionBy("packet_id").orderBy("rank")
    return items.filter("eligible").withColumn("image", F.row_number().over(w) <= most).select("packet_id", "rank", "image")


def number_evidence(parts: DataFrame) -> DataFrame:
    """Evidence ids e1.. in order, and source references by first use."""
    w = Window.partitionBy("packet_id").orderBy("rank")
    first = F.min("rank").over(Window.partitionBy("packet_id", "version_id"))
    p = parts.withColumns({"evidence_id": F.concat(F.lit("e"), F.row_number().over(w).cast("string")), "first": first})
    return p.withColumn("source_ref", F.concat(F.lit("src_"), F.dense_rank().over(Window.partitionBy("packet_id").orderBy("first")).cast("string"))).select("packet_id", "rank", "evidence_id", "source_ref")


def packet_markdown(parts: DataFrame) -> DataFrame:
    """Each packet as a Markdown document, a section for each evidence in order."""
    row = F.concat(F.lit("## "), F.col("evidence_id"), F.lit(" p."), (F.col("page_index") + 1).cast("string"), F.lit("\n\n"), F.col("text"))
    g = parts.groupBy("packet_id").agg(F.array_sort(F.collect_list(F.struct("rank", row.alias("t")))).alias("ts"))
    return g.select("packet_id", F.concat(F.lit("# Packet "), F.col("packet_id").cast("string"), F.lit("\n\n"), F.array_join(F.transform("ts", lambda x: x["t"]), "\n\n")).alias("markdown"))


def build_packets(parts: DataFrame) -> DataFrame:
    """Whole packets (packet_id, evidence, sources, flags, limits, content_sha256) from their ``parts``: packet_id, rank,
    version_id, role, page_index, section, text, flags, truncated and reason.

    Parts are evidence in order of rank, selections before pages as they are ranked, with ids e1.. and a reference to
    their source, src_1.. by first use. A part with a reason is excluded: it is no evidence but is named in the
    limits, with its page, beside the number of truncated and of excluded ones. Flags are the union of those of the
    evidence, sorted. The hash is of all but the id, so packets of one content share it. A group is the parts of one packet.
    """
    kept = F.col("reason").isNull()
    w = Window.partitionBy("packet_id")
    first = F.min(F.when(kept, F.col("rank"))).over(Window.partitionBy("packet_id", "version_id"))
    p = parts.withColumn("_first", first)
    number = F.count_if(kept).over(w.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    source = F.dense_rank().over(w.orderBy(F.col("_first").asc_nulls_last()))
    p = p.withColumn("_id", F.concat(F.lit("e"), number.cast("string"))).withColumn("_ref", F.concat(F.lit("src_"), source.cast("string")))
    row = F.struct("rank", F.col("_id").alias("evidence_id"), F.col("_ref").alias("source_ref"), "role", "page_index", "section", "text", F.coalesce("truncated", F.lit(False)).alias("truncated"))
    ranked = lambda cond, x: F.array_sort(F.collect_list(F.when(cond, x)))
    g = p.groupBy("packet_id").agg(
        ranked(kept, row).alias("e"), F.array_sort(F.collect_set(F.when(kept, F.struct(F.length("_ref").alias("n"), F.col("_ref").alias("source_ref"), "version_id")))).alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(kept, F.coalesce("flags", F.array().cast("array<string>"))))))).alias("flags"),
        ranked(~kept, F.struct("rank", "role", "page_index", "reason")).alias("x"),
    )
    without_rank = lambda names: lambda x: F.struct(*[x[n].alias(n) for n in names])
    evidence = F.transform("e", without_rank(["evidence_id", "source_ref", "role", "page_index", "section", "text", "truncated"]))
    excluded = F.transform("x", without_rank(["role", "page_index", "reason"]))
    limits = F.struct(F.size(F.filter("e", lambda x: x["truncated"])).alias("truncated"), F.size("x").alias("excluded"), excluded.alias("exclusions"))
    out = g.select("packet_id", evidence.alias("evidence"), F.transform("s", without_rank(["source_ref", "version_id"])).alias("sources"), "flags", limits.alias("limits"))
    return content_sha256(out, ["evidence", "sources", "flags", "limits"])


def packet_document(packets: DataFrame) -> DataFrame:
    """(packet_id, markdown): each packet of ``build_packets`` as a document with a header, a section for each
    piece of evidence with its role, page and section path and its paragraphs by number, the limits and
    exclusions, the sources, and the hash."""
    page = lambda x: F.when(x["page_index"].isNull(), F.lit("")).otherwise(F.concat(F.lit(", p. "), (x["page_index"] + 1).cast("string")))

    def section(x: Column) -> Column:
        head = F.concat(F.lit("## "), x["evidence_id"], F.lit(" · "), F.coalesce(x["role"], F.lit("text")), page(x), F.lit(" · "), x["source_ref"])
        path = F.when(x["section"].isNotNull(), F.concat(F.lit("\n_"), x["section"], F.lit("_"))).otherwise(F.lit(""))
        paragraphs = F.array_join(F.transform(F.split(F.coalesce(x["text"], F.lit("")), "\n\n"), lambda t, i: F.concat(F.lit("¶"), (i + 1).cast("string"), F.lit(" "), t)), "\n\n")
        return F.concat(head, path, F.lit("\n\n"), paragraphs, F.when(x["truncated"], F.lit("\n\n[truncated]")).otherwise(F.lit("")))

    excluded = lambda x: F.concat(F.lit("- "), F.coalesce(x["role"], F.lit("text")), page(x), F.lit(": "), x["reason"])
    source = lambda x: F.concat(F.lit("- "), x["source_ref"], F.lit(": "), x["version_id"].cast("string"))
    lines = F.concat(
        F.array(F.concat(F.lit("# Packet "), F.col("packet_id").cast("string"))), F.transform("evidence", section),
        F.array(F.concat(F.lit("## Limits\n\ntruncated: "), F.col("limits.truncated").cast("string"), F.lit(", excluded: "), F.col("limits.excluded").cast("string"))),
        F.when(F.size("limits.exclusions") > 0, F.array(F.array_join(F.transform("limits.exclusions", excluded), "\n"))).otherwise(F.array().cast("array<string>")),
        F.array(F.concat(F.lit("## Sources\n\n"), F.array_join(F.transform("sources", source), "\n"))), F.array(F.concat(F.lit("sha256: "), F.col("content_sha256"))),
    )
    return packets.select("packet_id", F.array_join(lines, "\n\n").alias("markdown"))
