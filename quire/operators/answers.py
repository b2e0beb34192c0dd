"""Answers, conversations and what answers refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def extract_citations(answers: DataFrame, marker: str = "cite") -> DataFrame:
    """Distinct citations (number, paragraph or null) of each answer in order of first appearance.
    Only brackets that open with the marker count; a range stands for its first paragraph."""
    groups = F.regexp_extract_all("markdown", F.lit(rf"\[{marker} ([^\[\]]*)\]"), F.lit(1))
    items = F.flatten(F.transform(groups, lambda g: F.split(g, ", *")))
    x = answers.select("answer_id", F.posexplode(items).alias("pos", "item"))
    x = x.select("answer_id", "pos", F.regexp_extract("item", r"^(?:\w+ )?(\d+)", 1).alias("n"), F.regexp_extract("item", r"¶ *(\d+)", 1).alias("q")).filter("n <> ''")
    return x.groupBy("answer_id", F.col("n").cast("int").alias("number"), F.when(F.col("q") != "", F.col("q").cast("int")).alias("paragraph")).agg(F.min("pos").alias("pos"))


def resolve_citations(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations against evidence (answer_id, number, paragraphs): unknown numbers are unresolved,
    paragraphs beyond the evidence become null."""
    e = evidence.select("answer_id", "number", F.col("paragraphs").alias("have"))
    c = citations.join(e, ["answer_id", "number"], "left")
    return c.select("answer_id", "pos", "number", F.when(F.col("paragraph") <= F.col("have"), F.col("paragraph")).alias("paragraph"), F.col("have").isNotNull().alias("resolved"))


def list_answers(answers: DataFrame, origin: str) -> DataFrame:
    """Live answers of an origin, numbered newest first within their session."""
    w = Window.partitionBy("session").orderBy(F.desc("created_at"), "answer_id")
    return answers.filter((F.col("origin") == origin) & F.col("discarded_at").isNull()).select("answer_id", "session", F.unix_timestamp("created_at").alias("created_s"), F.row_number().over(w).alias("position"))


def find_answers(answers: DataFrame, images: DataFrame, connections: DataFrame, packet=None, session=None, origin: str | None = None, paper=None, packets: DataFrame | None = None) -> DataFrame:
    """Live answers by any of packet, session, origin and paper, newest first within their session, with the name of
    their connection (connection_id, name) and the number of their images (answer_id, position).

    A paper's answers are those of the ``packets`` (packet_id, sources) that have it among their sources.
    """
    found = answers.filter("discarded_at is null")
    for column, value in (("packet_id", packet), ("session", session), ("origin", origin)):
        if value is not None:
            found = found.filter(F.col(column) == value)
    if paper is not None:
        of = packets.filter(F.exists("sources", lambda s: s["paper_id"] == paper)).select("packet_id").distinct()
        found = found.join(of, "packet_id", "left_semi")
    n = images.groupBy("answer_id").agg(F.count("*").alias("images"))
    names = connections.select("connection_id", F.col("name").alias("connection"))
    w = Window.partitionBy("session").orderBy(F.desc("created_at"), "answer_id")
    out = found.join(n, "answer_id", "left").join(names, "connection_id", "left")
    return out.select("answer_id", "packet_id", "session", F.unix_timestamp("created_at").alias("created_s"), "connection", F.coalesce("images", F.lit(0)).cast("long").alias("images"), F.row_number().over(w).alias("position"))


def list_conversations(answers: DataFrame, origin: str | None = None) -> DataFrame:
    """Live sessions, of one origin if it is given: answers, last time, and a title from the first prompt (white space
    collapsed, 80 characters). The first answer comes from the same aggregation as the counts."""
    live = answers.filter("discarded_at is null")
    live = live if origin is None else live.filter(F.col("origin") == origin)
    g = live.groupBy("session").agg(F.count("*").alias("answers"), F.max("created_at").alias("last"), F.min_by("prompt", F.struct("created_at", "answer_id")).alias("first_prompt"))
    title = F.substring(F.trim(F.regexp_replace("first_prompt", r"[ \t\r\n]+", " ")), 1, 80)
    return g.select("session", "answers", F.unix_timestamp("last").alias("last_s"), F.coalesce(title, F.lit("Untitled")).alias("title")).orderBy(F.desc("last_s"), "session")


def name_conversations(answers: DataFrame, titles: DataFrame, threads: DataFrame) -> DataFrame:
    """Conversations with their title: the own one (session, title), else that of their live thread (session,
    title, kind, deleted_at), else the first prompt; the kind is that of the thread or ``chat``, and the
    source is the packet of the first live answer."""
    first = answers.filter("discarded_at is null").groupBy("session").agg(F.min_by("packet_id", F.struct("created_at", "answer_id")).alias("source"))
    own = titles.select("session", F.col("title").alias("own_title"))
    live = threads.filter("deleted_at is null").select("session", F.col("title").alias("thread_title"), F.col("kind").alias("thread_kind"))
    c = list_conversations(answers).join(first, "session").join(own, "session", "left").join(live, "session", "left")
    named = lambda x: F.when(F.col(x) != "", F.col(x))
    return c.select("session", "answers", "last_s", "source", F.coalesce(named("own_title"), named("thread_title"), "title").alias("title"), F.coalesce(named("thread_kind"), F.lit("chat")).alias("kind"))


def sessions_of(answers: DataFrame) -> DataFrame:
    """Sessions with their first question, 40 characters and an ellipsis at most."""
    q = answers.groupBy("session").agg(F.min_by("prompt", F.struct("created_at", "answer_id")).alias("q"), F.count("*").alias("answers"))
    return q.select("session", "answers", F.when(F.length("q") > 40, F.concat(F.substring("q", 1, 40), F.lit("…"))).otherwise(F.col("q")).alias("title"))


#: An opening fence: at most three spaces, three or more of one sign, and what follows.
FENCE = r"^( {0,3})(`{3,}(?=[^`]*$)|~{3,})(.*)$"


def extract_artifacts(answers: DataFrame) -> DataFrame:
    """Fenced blocks of answers: (answer_id, number, language, title, content). A fold over the lines
    of an answer holds the open fence; it is closed by at least as many of its sign with nothing
    behind them, and an unclosed one runs to the end."""
    lines = F.transform(F.split("markdown", "\n"), lambda x: F.struct(x.alias("line"), F.regexp_extract(x, FENCE, 2).alias("mark"), F.trim(F.regexp_extract(x, FENCE, 3)).alias("info"), F.rtrim(F.regexp_extract(x, r"^ {0,3}(`{3,}|~{3,})[ \t]*$", 1)).alias("end")))
    row = "array<struct<head:string,body:array<string>>>"
    empty = F.array().cast("array<string>")
    zero = F.struct(F.lit("").alias("fence"), F.lit("").alias("head"), empty.alias("body"), F.array().cast(row).alias("done"))
    state = lambda fence, head, body, done: F.struct(fence.alias("fence"), head.alias("head"), body.alias("body"), done.alias("done"))
    finished = lambda a: F.concat(a["done"], F.array(F.struct(a["head"].alias("head"), a["body"].alias("body"))))

    def step(a, x):
        closes = (x["end"] != "") & x["end"].startswith(a["fence"])
        return (
            F.when((a["fence"] == "") & (x["mark"] != ""), state(x["mark"], x["info"], empty, a["done"]))
            .when(a["fence"] == "", a)
            .when(closes, state(F.lit(""), F.lit(""), empty, finished(a)))
            .otherwise(state(a["fence"], a["head"], F.concat(a["body"], F.array(x["line"])), a["done"]))
        )

    end = lambda a: F.when(a["fence"] == "", a["done"]).otherwise(finished(a))
    found = answers.select("answer_id", F.posexplode(F.aggregate(lines, zero, step, end)).alias("number", "f"))
    return found.select("answer_id", "number", F.regexp_extract("f.head", r"^(\S*)", 1).alias("language"), F.trim(F.regexp_replace("f.head", r"^\S* ?", "")).alias("title"), F.array_join("f.body", "\n").alias("content"))


def paper_artifacts(answers: DataFrame, limit: int = 200) -> DataFrame:
    """The artifacts of the latest ``limit`` live answers of each paper, with its packet_id."""
    newest = Window.partitionBy("packet_id").orderBy(F.desc("created_at"), "answer_id")
    a = answers.filter("discarded_at is null").withColumn("newest", F.row_number().over(newest)).filter(F.col("newest") <= limit)
    return a.select("answer_id", "packet_id").join(extract_artifacts(a), "answer_id")


def strip_artifacts(answers: DataFrame) -> DataFrame:
    """Answers with each closed fence as one line that names it."""
    return answers.select("answer_id", F.regexp_replace("markdown", r"(?ms)^ {0,3}```(\S*) ?([^\n]*)\n.*?^ {0,3}``` *$", r"[artifact: $2]").alias("markdown"))


# fixed values: words that name figures, and what joins or ranges over their numbers
FIGURE_WORDS = ("fig", "figs", "figure", "figures", "그림")
JOINERS, DASHES = (",", "&", "/", "and", "or"), ("-", "–", "~")
#: Numbers that a range of figures is expanded by at most, and digits of a number.
RANGE, DIGITS = 4, 3


def figure_numbers(text: Column) -> Column:
    """Distinct figure labels that a text names, in order of first mention: "Figs. 3, 4 and S1", "fig 3–5", "그림 3".

    The text is read as words, numbers and signs. A word for figures waits for a number; a number may be
    followed by a joiner or a dash, which wait for another one; all else ends the list. A range is expanded
    by RANGE numbers at most.
    """
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|\p{Nd}+|\S)"), F.lit(1))
    state = lambda wait, dash, extra, last, out: F.struct(wait.alias("wait"), dash.alias("dash"), extra.alias("extra"), last.alias("last"), out.alias("out"))
    lit, no, none = F.lit, F.lit(False), F.lit(None).cast("int")
    # wait: nothing, a number after a word, a joiner after a number, a number after a joiner
    start = state(lit(0), no, no, none, F.array().cast("array<string>"))

    def step(a: Column, t: Column) -> Column:
        number = t.cast("int")
        wants = a["wait"].isin(1, 3)
        label = F.concat(F.when(a["extra"], "S").otherwise(""), t)
        ranged = a["dash"] & ~a["extra"] & (a["last"] < number)
        new = F.when(F.coalesce(ranged, no), F.transform(F.sequence(a["last"] + 1, F.least(number, a["last"] + RANGE)), lambda n: n.cast("string"))).otherwise(F.array(label))
        return (
            F.when(t.isin(*FIGURE_WORDS), state(lit(1), no, no, none, a["out"]))
            .when(wants & t.rlike(f"^[0-9]{{1,{DIGITS}}}$"), state(lit(2), no, no, F.when(~a["extra"], number), F.concat(a["out"], new)))
            .when(wants & (t == "s") & ~a["extra"], state(a["wait"], a["dash"], lit(True), a["last"], a["out"]))
            .when(((a["wait"] == 1) & (t == ".") & ~a["extra"]) | ((a["wait"] == 3) & t.isin("and", "or", "&") & ~a["dash"]), a)
            .when((a["wait"] == 2) & t.isin(*JOINERS), state(lit(3), no, no, none, a["out"]))
            .when((a["wait"] == 2) & t.isin(*DASHES), state(lit(3), lit(True), no, a["last"], a["out"]))
            .otherwise(state(lit(0), no, no, none, a["out"]))
        )

    return F.array_distinct(F.aggregate(tokens, start, step, lambda a: a["out"]))


def figure_refs(answers: DataFrame, figures: DataFrame) -> DataFrame:
    """Figure labels that answers name, with the caption of that figure in the answer's paper."""
    n = answers.select("answer_id", F.col("packet_id").alias("version_id"), F.explode(figure_numbers(F.col("markdown"))).alias("label"))
    return n.join(figures.select("version_id", F.col("label").cast("string").alias("label"), "caption"), ["version_id", "label"], "left")


def page_refs(answers: DataFrame) -> DataFrame:
    """Distinct pages that answers name: ``p.19``, the first of ``pp. 19–20``, and ``19쪽``."""
    named = lambda pattern: F.regexp_extract_all("markdown", F.lit(pattern), F.lit(1))
    pages = F.concat(named(r"\b[Pp]{1,2}\.\s*(\d+)"), named(r"(\d+)(?:\s*[-–~]\s*\d+)?\s*쪽"))
    numbers = F.array_distinct(F.filter(F.transform(pages, lambda x: x.try_cast("int")), lambda x: x.isNotNull()))
    return answers.select("answer_id", F.explode(numbers).alias("page"))


def save_answers(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Idempotent save: an incoming answer with the packet, content and prompt (null equals null) of a
    live one, or of an earlier incoming one, takes its id."""
    key = lambda df: df.withColumn("h", F.sha2("markdown", 256))
    old = key(existing.filter("discarded_at is null")).groupBy("packet_id", "h", F.col("prompt").alias("old_prompt")).agg(F.min("answer_id").alias("old_id")).withColumnRenamed("packet_id", "old_packet").withColumnRenamed("h", "old_h")
    new = key(incoming)
    first = F.min("answer_id").over(Window.partitionBy("packet_id", "h", "prompt"))
    j = new.withColumn("first_id", first).join(old, (F.col("packet_id") == F.col("old_packet")) & (F.col("h") == F.col("old_h")) & F.col("prompt").eqNullSafe(F.col("old_prompt")), "left")
    return j.select("answer_id", F.coalesce("old_id", "first_id").alias("saved_id"))


def discard(answers: DataFrame, keys: DataFrame, now: str) -> DataFrame:
    """Answers of the sessions in ``keys`` with ``discarded_at`` set once."""
    k = keys.select("session").distinct().withColumn("hit", F.lit(True))
    return answers.join(k, "session", "left").withColumn("discarded_at", F.when(F.col("hit"), F.coalesce("discarded_at", F.lit(now).cast("timestamp"))).otherwise(F.col("discarded_at"))).drop("hit")


def discard_sessions(answers: DataFrame, titles: DataFrame, threads: DataFrame, keys: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, titles, threads) after the sessions in ``keys`` are deleted: their answers and threads are marked once with
    the time, and their own titles go."""
    k = keys.select("session").distinct()
    return discard(answers, k, now), titles.join(k, "session", "left_anti"), _marked(threads, k, now)


def _marked(threads: DataFrame, keys: DataFrame, now: str) -> DataFrame:
    hit = threads.join(keys.withColumn("_hit", F.lit(True)), "session", "left")
    return hit.withColumn("deleted_at", F.when(F.col("_hit"), F.coalesce("deleted_at", F.lit(now).cast("timestamp"))).otherwise(F.col("deleted_at"))).drop("_hit")


def apply_renames(titles: DataFrame, threads: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(titles, threads) after sessions are renamed (session, title): the live thread of a session takes the name; a
    session without one has it as its own title, in place of one that it had."""
    new = renames.groupBy("session").agg(F.max("title").alias("_title"))
    live = threads.filter("deleted_at is null").select("session").distinct()
    named = threads.join(new, "session", "left").withColumn("title", F.when(F.col("deleted_at").isNull(), F.coalesce("_title", "title")).otherwise(F.col("title"))).drop("_title")
    own = new.join(live, "session", "left_anti").select("session", F.col("_title").alias("title"))
    return titles.join(own, "session", "left_anti").unionByName(own, allowMissingColumns=True), named
