"""The library: papers, tags, annotations and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def live(df: DataFrame, owner: str | None = None, gone: str = "deleted_at") -> DataFrame:
    """Rows of an owner that are not deleted or discarded; both filters reach the scan."""
    out = df.filter(F.col(gone).isNull())
    return out.filter(F.col("owner_id") == owner) if owner else out


def filter_tags(papers: DataFrame, tags: DataFrame, wanted: list[str], mode: str = "any", untagged: bool = False) -> DataFrame:
    """Papers with any or all of the wanted tags, case apart; no wanted tag keeps all; or those without tags."""
    if untagged:
        return papers.join(tags, "paper_id", "left_anti")
    if not wanted:
        return papers
    want = sorted({w.lower() for w in wanted})
    hits = tags.filter(F.lower("tag").isin(want)).groupBy("paper_id").agg(F.count_distinct(F.lower("tag")).alias("hits"))
    return papers.join(hits.filter(F.col("hits") >= (len(want) if mode == "all" else 1)), "paper_id", "left_semi")


def _haystack():
    return F.lower(F.concat_ws("", F.col("quote"), F.col("display_quote"), F.col("comment")))


def filter_highlights(annotations: DataFrame, colors: list[str], query: str) -> DataFrame:
    """Coloured annotations of the given colours that contain the query, case apart."""
    out = annotations.filter(F.col("color").isNotNull())
    out = out.filter(F.col("color").isin(colors)) if colors else out
    return out.filter(_haystack().contains(query.strip().lower())) if query.strip() else out


def filter_notes(annotations: DataFrame, kind: str = "all", query: str = "") -> DataFrame:
    """Annotations with a comment, of one kind or all, that contain the query."""
    out = annotations.filter(F.coalesce(F.trim("comment"), F.lit("")) != "")
    out = out.filter(F.col("kind") == kind) if kind != "all" else out
    return out.filter(_haystack().contains(query.strip().lower())) if query.strip() else out


def note_counts(annotations: DataFrame) -> DataFrame:
    n = filter_notes(annotations)
    return n.groupBy("version_id").agg(F.count("*").alias("all_notes"), F.count_if(F.col("kind") == "text").alias("text_notes"), F.count_if(F.col("kind") == "region").alias("region_notes"))


def filter_page_ranges(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """Pages inside the ranges of a spec like ``1-5, 8`` (from 1; at most 20 parts) for each version of
    ``specs`` (version_id, spec, page_count); a bad or out-of-range part voids the whole spec."""
    parts = F.transform(F.split("spec", ","), lambda x: F.trim(x))
    first, last = (lambda x: F.regexp_extract(x, r"^(\d{1,6})", 1).cast("int")), (lambda x: F.regexp_extract(x, r"(\d{1,6})$", 1).cast("int"))
    good = lambda x: x.rlike(r"^\d{1,6}(?: *- *\d{1,6})?$") & (first(x) >= 1) & (first(x) <= last(x)) & (last(x) <= F.col("page_count"))
    ok = specs.withColumn("parts", parts).filter((F.size("parts") <= 20) & F.forall("parts", lambda x: F.coalesce(good(x), F.lit(False))))
    wanted = ok.select("version_id", F.explode("parts").alias("x")).select("version_id", F.explode(F.sequence(first(F.col("x")) - 1, last(F.col("x")) - 1)).alias("page_index")).distinct()
    return pages.join(wanted, ["version_id", "page_index"], "left_semi")


def clean_titles(papers: DataFrame) -> DataFrame:
    """Titles without markup tags and control characters, white space collapsed, 300 characters at most."""
    bare = F.regexp_replace("title", r"</?[A-Za-z][^<>]*>", "")
    clean = F.substring(F.trim(F.regexp_replace(F.regexp_replace(bare, r"[\p{C}\p{Z}]", " "), " +", " ")), 1, 300)
    return papers.withColumns({"was": F.col("title"), "title": clean}).withColumn("changed", ~F.col("title").eqNullSafe(F.col("was"))).drop("was")


def validate_metadata(edits: DataFrame) -> DataFrame:
    """The fields of each edit (title, authors, year, doi) that are not acceptable."""
    doi = F.regexp_replace(F.trim("doi"), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi: *)", "")
    bad = lambda name, ok: F.when(~F.coalesce(ok, F.lit(True)), F.lit(name))
    errors = F.array_compact(
        F.array(
            bad("title", F.col("title").isNotNull() & F.length(F.trim("title")).between(1, 500)),
            bad("authors", (F.size("authors") <= 100) & F.forall("authors", lambda a: F.length(a) <= 300)),
            bad("year", F.col("year").between(1000, 2100)),
            bad("doi", (doi == "") | (doi.rlike(r"^10\.\d{4,9}/\S+$") & (F.length(doi) <= 200))),
        )
    )
    return edits.withColumn("errors", errors)


def annotations_in_order(annotations: DataFrame) -> DataFrame:
    """Annotations numbered in reading order within their version."""
    w = Window.partitionBy("version_id").orderBy("page_index", "v", "u", "annotation_id")
    return annotations.withColumn("position", F.row_number().over(w))


def list_papers(papers: DataFrame, tags: DataFrame, annotations: DataFrame, answers: DataFrame) -> DataFrame:
    """Live papers with their tags in order, annotations and live conversations, last opened first."""
    t = tags.groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ", ").alias("tags"))
    a = annotations.groupBy("version_id").agg(F.count("*").alias("annotations"))
    c = answers.filter("discarded_at is null").groupBy(F.col("packet_id").alias("paper_id")).agg(F.count_distinct("session").alias("conversations"))
    out = live(papers).join(t, "paper_id", "left").join(a, "version_id", "left").join(c, "paper_id", "left")
    shown = F.unix_timestamp(F.coalesce("last_opened_at", "created_at"))
    return out.select("paper_id", "title", F.coalesce("tags", F.lit("")).alias("tags"), F.coalesce("annotations", F.lit(0)).alias("annotations"), F.coalesce("conversations", F.lit(0)).alias("conversations"), shown.alias("shown_s")).orderBy(F.desc("shown_s"), "paper_id")


def tag_counts(tags: DataFrame) -> DataFrame:
    """Papers of each tag, case apart, under the name seen first by paper."""
    return tags.groupBy(F.lower("tag").alias("key")).agg(F.count_distinct("paper_id").alias("papers"), F.min_by("tag", F.struct("paper_id", "tag")).alias("tag"))


def anchor_comments(annotations: DataFrame) -> DataFrame:
    """The comments of each page of a version in order of time, a blank line between."""
    c = annotations.filter(F.coalesce(F.trim("comment"), F.lit("")) != "")
    return c.groupBy("version_id", "page_index").agg(F.expr("listagg(comment, '\n\n') within group (order by created_at, annotation_id)").alias("comments"))


def page_runs(df: DataFrame) -> DataFrame:
    """Pages of each version as runs: ``3–5, 27``, from 1."""
    d = df.select("version_id", "page_index").distinct()
    d = d.withColumn("run", F.col("page_index") - F.row_number().over(Window.partitionBy("version_id").orderBy("page_index")))
    r = d.groupBy("version_id", "run").agg((F.min("page_index") + 1).alias("a"), (F.max("page_index") + 1).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("–"), F.col("b").cast("string")))
    return r.groupBy("version_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x["t"]), ", ").alias("pages"))


def highlights_markdown(annotations: DataFrame) -> DataFrame:
    """Coloured text annotations of each version as a Markdown list in reading order."""
    h = annotations.filter("color is not null and kind = 'text'")
    note = F.when(F.coalesce(F.trim("comment"), F.lit("")) != "", F.concat(F.lit(" — "), F.trim("comment"))).otherwise("")
    line = F.concat(F.lit("- p."), (F.col("page_index") + 1).cast("string"), F.lit(" “"), F.coalesce("display_quote", "quote"), F.lit("”"), note)
    rows = F.array_sort(F.collect_list(F.struct("page_index", "v", "u", "annotation_id", line.alias("line"))))
    return h.groupBy("version_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("markdown"))


def dedupe_sources(files: DataFrame) -> DataFrame:
    """Each file with the first paper of its bytes; later ones are duplicates of it."""
    first = files.groupBy("sha256").agg(F.min_by("paper_id", F.struct("created_at", "paper_id")).alias("first_id"))
    return files.join(first, "sha256").select("paper_id", "first_id", (F.col("paper_id") != F.col("first_id")).alias("duplicate"))


def latest_rows(target: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert: of all rows of a key the one with the greatest ``order``."""
    both = target.unionByName(updates)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def current_heading(headings: DataFrame, positions: DataFrame) -> DataFrame:
    """The last heading at or before each position (version_id, p): as-of by a union and a window."""
    h = headings.select("version_id", "p", "title", F.lit(0).alias("side"))
    q = positions.select("version_id", "p", F.lit(None).cast("string").alias("title"), F.lit(1).alias("side"))
    w = Window.partitionBy("version_id").orderBy("p", "side").rowsBetween(Window.unboundedPreceding, 0)
    return h.unionByName(q).withColumn("heading", F.last("title", True).over(w)).filter("side = 1").select("version_id", "p", "heading")


def replace_tags(tags: DataFrame, changes: DataFrame) -> DataFrame:
    """Tags after the papers of ``changes`` (paper_id, tag) got exactly their tags there; a tag that
    another paper has in other case keeps that name."""
    kept = tags.join(changes.select("paper_id").distinct(), "paper_id", "left_anti")
    names = kept.groupBy(F.lower("tag").alias("key")).agg(F.min("tag").alias("name"))
    new = changes.withColumn("key", F.lower("tag")).join(names, "key", "left").select("paper_id", F.coalesce("name", "tag").alias("tag")).distinct()
    return kept.select("paper_id", "tag").unionByName(new)


def rename_tag(tags: DataFrame, old: str, new: str) -> DataFrame:
    """Memberships after a rename; where the new name exists the two merge."""
    return tags.withColumn("tag", F.when(F.lower("tag").isin(old.lower(), new.lower()), F.lit(new)).otherwise(F.col("tag"))).distinct()


def lookup_candidates(papers: DataFrame) -> DataFrame:
    """Live papers with an identifier that were never opened, oldest first."""
    return live(papers).filter(F.col("doi").isNotNull() & (F.col("doi") != "") & F.col("last_opened_at").isNull()).select("paper_id", "doi", F.unix_timestamp("created_at").alias("created_s"))


def apply_metadata(papers: DataFrame, edits: DataFrame) -> DataFrame:
    """Papers with their edits (paper_id, new_title, new_doi): a null DOI clears it."""
    e = edits.select("paper_id", "new_title", "new_doi", F.lit(True).alias("edited"))
    p = papers.join(e, "paper_id", "left")
    hit = F.coalesce("edited", F.lit(False))
    return p.select("paper_id", F.when(hit, F.coalesce("new_title", "title")).otherwise(F.col("title")).alias("title"), F.when(hit, F.coalesce("new_doi", F.lit(""))).otherwise(F.col("doi")).alias("doi"), hit.alias("edited"))


def apply_revisions(changes: DataFrame) -> DataFrame:
    """Revision log to state: a change counts only if its expected revision is the current one. A
    fold over the changes of a key in order; ``conflicts`` counts the others."""
    zero = F.struct(F.lit(0).alias("revision"), F.lit(0).alias("conflicts"), F.lit(None).cast("long").alias("last"))
    step = lambda a, c: F.when(c["expected"] == a["revision"], F.struct((a["revision"] + 1).alias("revision"), a["conflicts"].alias("conflicts"), c["id"].alias("last"))).otherwise(F.struct(a["revision"].alias("revision"), (a["conflicts"] + 1).alias("conflicts"), a["last"].alias("last")))
    g = changes.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ts", "id", "expected"))).alias("cs"))
    return g.select("key", F.aggregate("cs", zero, step).alias("s")).select("key", "s.*")


def packet_status(events: DataFrame) -> DataFrame:
    """Life of each packet (key, ts, id, kind): handed off keeps its first time, imported is final,
    cancelled counts only before both; ``illegal`` counts the other events."""
    zero = F.struct(F.lit("PREPARED").alias("status"), F.lit(None).cast("long").alias("handed"), F.lit(0).alias("illegal"))

    def step(a, e):
        to = lambda s, h: F.struct(F.lit(s).alias("status"), h.alias("handed"), a["illegal"].alias("illegal"))
        return (
            F.when((e["kind"] == "HANDED_OFF") & a["status"].isin("PREPARED", "HANDED_OFF"), to("HANDED_OFF", F.coalesce(a["handed"], e["id"])))
            .when((e["kind"] == "IMPORTED") & (a["status"] != "CANCELLED"), to("IMPORTED", a["handed"]))
            .when((e["kind"] == "CANCELLED") & (a["status"] == "PREPARED"), to("CANCELLED", a["handed"]))
            .otherwise(F.struct(a["status"].alias("status"), a["handed"].alias("handed"), (a["illegal"] + 1).alias("illegal")))
        )

    g = events.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ts", "id", "kind"))).alias("es"))
    return g.select("key", F.aggregate("es", zero, step).alias("s")).select("key", "s.*")


def delete_tag(tags: DataFrame, name: str) -> DataFrame:
    """Memberships without those of a tag, case apart."""
    return tags.filter(F.lower("tag") != name.lower())


def packets_of_paper(packets: DataFrame, paper_id) -> DataFrame:
    """Packets (packet_id, sources: array of struct with paper_id) that hold a paper."""
    return packets.filter(F.exists("sources", lambda s: s["paper_id"] == paper_id))
