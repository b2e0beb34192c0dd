"""Threads, session names, forks, marks and evidence contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import stored
from .structure import blocks_under, body_blocks, nearest_caption
from .translation import sentence_array

#: Forks are followed this far; a record that points at itself ends there.
DEPTH = 20


def readable_quotes(anchors: DataFrame) -> DataFrame:
    """Quotes without control and private characters but line ends and tabs, runs of spaces as one."""
    return anchors.withColumn("quote", F.regexp_replace(F.regexp_replace("quote", r"[\p{Cc}\p{Co}&&[^\n\t]]", ""), " +", " "))


def threads_with_answers(threads: DataFrame, answers: DataFrame) -> DataFrame:
    """Threads that have a live answer."""
    return threads.join(answers.filter("discarded_at is null"), "session", "left_semi")


def versions_to_reprocess(versions: DataFrame, runs: DataFrame, parser: int, config: str | None = None) -> DataFrame:
    """Versions with no queued or running run and none of the current parser and, if given, of the current ``config`` (a
    hash, in the column config_hash of ``runs``)."""
    current = F.col("parser") == parser
    current = current if config is None else current & (F.col("config_hash") == config)
    busy = runs.filter(F.col("status").isin("QUEUED", "RUNNING") | current)
    return versions.join(busy, "version_id", "left_anti")


def orphan_tags(names: DataFrame, tags: DataFrame) -> DataFrame:
    """Tag names that no paper has, case apart."""
    return names.join(tags.select(F.lower("tag").alias("key")).distinct(), F.lower("name") == F.col("key"), "left_anti")


def session_titles(titles: DataFrame, threads: DataFrame) -> DataFrame:
    """Names of sessions from own titles and from live threads; the own one wins."""
    both = titles.select("session", "title", F.lit(0).alias("rank")).unionByName(threads.filter("deleted_at is null").select("session", "title", F.lit(1).alias("rank")))
    return both.groupBy("session").agg(F.min_by("title", "rank").alias("title"))


def list_threads(threads: DataFrame, answers: DataFrame) -> DataFrame:
    """Threads with their live answers and last time; those without any are hidden."""
    g = answers.filter("discarded_at is null").groupBy("session").agg(F.count("*").alias("answers"), F.max("created_at").alias("last"))
    return threads.filter("deleted_at is null").join(g, "session").select("session", "title", "answers", F.unix_timestamp("last").alias("last_s"))


def conversation_turns(answers: DataFrame, forks: DataFrame) -> DataFrame:
    """Turns of each session with those it inherits. forks (session, parent, at): a fork takes the turns
    of its parent, inherited ones included, up to the answer ``at``; all if that is unknown; those
    before its own first answer if ``at`` is null. One round for each level of forks."""
    own = answers.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("created_at", "answer_id"))).alias("own"))
    links = own.join(forks, "session", "left").withColumn("start", F.get("own", F.lit(0))["created_at"])
    links = links.join(own.select(F.col("session").alias("parent"), F.lit(True).alias("known")), "parent", "left")
    links = stored(links, "forks")
    done = level = links.filter("known is null").select("session", F.col("own").alias("turns"), F.size("own").alias("n_own"))
    left = links.filter("known is not null")
    for _ in range(DEPTH):
        ready = left.join(level.select(F.col("session").alias("parent"), F.col("turns").alias("up")), "parent")
        place = F.array_position(F.transform("up", lambda t: t["answer_id"]), F.col("at"))
        inherited = F.when(F.col("at").isNull(), F.filter("up", lambda t: t["created_at"] < F.col("start"))).when(place > 0, F.slice("up", F.lit(1), place.cast("int"))).otherwise(F.col("up"))
        level = stored(ready.select("session", F.concat(inherited, "own").alias("turns"), F.size("own").alias("n_own")), "forks")
        if level.isEmpty():
            break
        done = done.unionByName(level)
        left = left.join(level.select("session"), "session", "left_anti")
    rest = left.select("session", F.col("own").alias("turns"), F.size("own").alias("n_own"))  # forks in a circle keep their own turns
    return done.unionByName(rest).select("session", "n_own", F.posexplode("turns").alias("position", "t"), F.size("turns").alias("n")).select("session", "position", "t.answer_id", (F.col("position") < F.col("n") - F.col("n_own")).alias("inherited"))


def selection_context(anchors: DataFrame, blocks: DataFrame, near: DataFrame) -> DataFrame:
    """The block under each anchor with its neighbours (version_id, p, before, after): the first block
    that covers half of the anchor."""
    under = blocks_under(anchors, blocks).groupBy("anchor_id", "version_id").agg(F.min("p").alias("p"))
    return under.join(near, ["version_id", "p"], "left").select("anchor_id", "version_id", "p", "before", "after")


#: Share of the length of its paragraphs from which a quote stands for them.
CONTAINED = 0.9


def text_selection_context(anchors: DataFrame, blocks: DataFrame, near: DataFrame) -> DataFrame:
    """(anchor_id, role, p, reason): what surrounds each text selection (anchor_id, version_id, page_index, quote and box).

    The blocks that the selection lies on are its ``containing_paragraph`` if the quote has less than nine tenths of
    their characters; the blocks before the first and behind the last of them (``near``) are its previous_paragraph
    and following_paragraph. A selection on no block has one row with the role ``context`` and why: ``text_not_extracted`` if its
    version has no blocks, else ``no_extracted_text``.
    """
    under = blocks_under(anchors, blocks).join(blocks.select("version_id", "p", F.length("text").alias("n")), ["version_id", "p"])
    spans = under.groupBy("anchor_id", "version_id").agg(F.min("p").alias("first"), F.max("p").alias("last"), F.sum("n").alias("n"), F.array_sort(F.collect_set("p")).alias("ps"))
    spans = spans.join(anchors.select("anchor_id", F.length(F.coalesce("quote", F.lit(""))).alias("quoted")), "anchor_id")
    inside = spans.filter(F.col("quoted") < CONTAINED * F.col("n")).select("anchor_id", F.lit("containing_paragraph").alias("role"), F.explode("ps").alias("p"))
    side = lambda at, of, role: spans.join(near.select("version_id", F.col("p").alias(at), F.col(of).alias("beside")), ["version_id", at]).filter("beside is not null").select("anchor_id", F.lit(role).alias("role"), F.col("beside").alias("p"))
    found = inside.unionByName(side("first", "before", "previous_paragraph")).unionByName(side("last", "after", "following_paragraph")).withColumn("reason", F.lit(None).cast("string"))
    extracted = blocks.select("version_id").distinct().withColumn("has", F.lit(True))
    none = anchors.join(spans.select("anchor_id"), "anchor_id", "left_anti").join(extracted, "version_id", "left")
    why = F.when(F.col("has"), "no_extracted_text").otherwise("text_not_extracted")
    return found.unionByName(none.select("anchor_id", F.lit("context").alias("role"), F.lit(None).cast("int").alias("p"), why.alias("reason")))


def region_context(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """The nearest caption of each region and the text of the other blocks that lie half inside it."""
    caption = nearest_caption(anchors, blocks)
    wide = F.greatest(F.lit(0.0), F.least("x1", "a1") - F.greatest("x0", "a0"))
    high = F.greatest(F.lit(0.0), F.least("y1", "b1") - F.greatest("y0", "b0"))
    inside = anchors.join(blocks, ["version_id", "page_index"]).filter(wide * high >= 0.5 * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    text = inside.join(caption.withColumnRenamed("caption_p", "p"), ["anchor_id", "p"], "left_anti").groupBy("anchor_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return caption.join(text, "anchor_id", "full").select("anchor_id", "caption_p", "text")


def unreadable(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Text anchors that their quote cannot stand for: a block under them has unmapped characters, or the
    quote has a visible character outside ASCII that the blocks under it lack. Anchors without blocks are not told."""
    flags = F.coalesce(F.array_contains("quality_flags", "unmapped_chars"), F.lit(False))
    under = blocks_under(anchors, blocks).join(blocks.select("version_id", "p", "text", flags.alias("unmapped")), ["version_id", "p"]).groupBy("anchor_id").agg(F.array_join(F.collect_list("text"), "").alias("have"), F.bool_or("unmapped").alias("unmapped"))
    odd = F.filter(F.array_distinct(F.split("quote", "")), lambda c: c.rlike(r"[^\p{ASCII}\s\p{Cf}]"))
    return anchors.join(under, "anchor_id").select("anchor_id", (F.col("unmapped") | F.exists(odd, lambda c: ~F.contains(F.col("have"), c))).alias("unreadable"))


def styled_sentences(blocks: DataFrame) -> DataFrame:
    """Sentences with the marks (start, end, mark) of their block, from its folded text: each mark is
    clipped to the sentence and written around the piece. blocks: version_id, p, text, styles."""
    s = blocks.select("version_id", "p", "styles", F.posexplode(sentence_array(F.col("text"))).alias("n", "s"))
    w = Window.partitionBy("version_id", "p").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("lo", F.coalesce(F.sum(F.length("s") + 1).over(w), F.lit(0)).cast("int")).withColumn("hi", F.col("lo") + F.length("s"))
    inside = F.array_sort(F.filter("styles", lambda x: (x["start"] < F.col("hi")) & (x["end"] > F.col("lo"))))
    zero = F.struct(F.lit("").alias("out"), F.col("lo").alias("at"))

    def step(a, x):
        lo, hi = F.greatest(x["start"], a["at"]), F.least(x["end"], F.col("hi"))
        part = lambda i, j: F.substring(F.col("s"), i - F.col("lo") + 1, F.greatest(j - i, F.lit(0)))
        return F.struct(F.concat(a["out"], part(a["at"], lo), F.lit("<"), x["mark"], F.lit(">"), part(lo, hi), F.lit("</"), x["mark"], F.lit(">")).alias("out"), hi.alias("at"))

    end = lambda a: F.concat(a["out"], F.substring(F.col("s"), a["at"] - F.col("lo") + 1, F.length("s")))
    return s.select("version_id", "p", "n", F.aggregate(inside, zero, step, end).alias("markup"))


def audit_responses(expected: DataFrame, responses: DataFrame, continued: DataFrame | None = None) -> DataFrame:
    """Problems of responses (version_id, p, n, text) against the expected sentences: missing ones, and
    an empty text for the first sentence of a block, unless it goes on with the block before it (``continued``:
    version_id, p)."""
    e = expected.select("version_id", "p", "n").join(responses.select("version_id", "p", "n", "text"), ["version_id", "p", "n"], "left")
    goes_on = F.lit(False)
    if continued is not None:
        e = e.join(continued.select("version_id", "p", F.lit(True).alias("goes_on")).distinct(), ["version_id", "p"], "left")
        goes_on = F.coalesce("goes_on", F.lit(False))
    bad = F.when(F.col("text").isNull(), F.concat(F.lit("missing "), F.col("n").cast("string"))).when((F.col("n") == 0) & (F.trim("text") == "") & ~goes_on, F.lit("empty 0"))
    rows = e.withColumn("bad", bad).filter("bad is not null")
    return rows.groupBy("version_id", "p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "bad"))), lambda x: x["bad"]), ", ").alias("problems"))


def highlight_targets(found: DataFrame, groups: DataFrame) -> DataFrame:
    """Translated groups (version_id, p, grp, lo, hi) that located quotes (quote_id, version_id, p, start, end) touch."""
    return found.join(groups, ["version_id", "p"]).filter((F.col("start") < F.col("hi")) & (F.col("lo") < F.col("end"))).select("quote_id", "version_id", "p", "grp")


def export_marks(annotations: DataFrame) -> DataFrame:
    """Highlights and notes of each version in reading order; a note goes into the highlight at its
    place, quotes have 200 characters and an ellipsis at most."""
    a = annotations.withColumn("note", F.when(F.coalesce(F.trim("comment"), F.lit("")) != "", F.trim("comment")))
    marks = a.filter("color is not null or note is not null")
    kind = F.when(F.col("color").isNotNull(), "highlight").otherwise("note")
    quote = F.when(F.length("quote") > 200, F.concat(F.substring("quote", 1, 200), F.lit("…"))).otherwise(F.col("quote"))
    w = Window.partitionBy("version_id").orderBy("page_index", "v", "u", "annotation_id")
    return marks.select("version_id", F.row_number().over(w).alias("position"), "annotation_id", kind.alias("kind"), quote.alias("quote"), F.coalesce("note", F.lit("")).alias("note"))


def enrich(papers: DataFrame, identifiers: DataFrame, records: DataFrame) -> DataFrame:
    """Papers (paper_id, authors, year) filled from the first of their identifiers (ordinal) that has a
    record (identifier, authors, year): only empty authors and a null year; ``asked`` is the last one asked."""
    j = identifiers.join(records.select("identifier", F.col("authors").alias("r_authors"), F.col("year").alias("r_year"), F.lit(True).alias("hit")), "identifier", "left")
    g = j.groupBy("paper_id").agg(F.min_by(F.struct("r_authors", "r_year", "identifier"), F.when(F.col("hit"), F.col("ordinal"))).alias("r"), F.max_by("identifier", "ordinal").alias("last"))
    p = papers.join(g, "paper_id", "left")
    return p.select("paper_id", F.when(F.size("authors") > 0, F.col("authors")).otherwise(F.coalesce("r.r_authors", "authors")).alias("authors"), F.coalesce("year", "r.r_year").alias("year"), F.coalesce("r.identifier", "last", F.lit("none")).alias("asked"))


def unused_body(blocks: DataFrame, used: DataFrame) -> DataFrame:
    """Body blocks that no evidence holds yet."""
    return body_blocks(blocks).join(used, ["version_id", "p"], "left_anti")
