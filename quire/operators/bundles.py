"""Export bundles: selection, references, manifest and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_FILES, FILE_BYTES, BUNDLE_BYTES = 64, 8 << 20, 32 << 20


def validate_selection(requests: DataFrame, versions: DataFrame, anchors: DataFrame) -> DataFrame:
    """Problems of requests (request_id, version_id, anchor_id): NOT_FOUND, duplicate_version, anchor_other_version."""
    r = requests.join(versions.select("version_id", F.lit(True).alias("known")), "version_id", "left")
    r = r.join(anchors.select(F.col("annotation_id").alias("anchor_id"), F.col("version_id").alias("anchor_version")), "anchor_id", "left")
    twice = F.count("*").over(Window.partitionBy("request_id", "version_id")) > 1
    reason = F.when(F.col("known").isNull(), "NOT_FOUND").when(F.col("anchor_version").isNull(), "NOT_FOUND").when(F.col("anchor_version") != F.col("version_id"), "anchor_other_version").when(twice, "duplicate_version")
    return r.select("request_id", "version_id", "anchor_id", reason.alias("reason")).filter("reason is not null")


def unselected_sources(items: DataFrame, chosen: DataFrame) -> DataFrame:
    """Answers, artifacts and proposals (request_id, kind, position, versions) of which no version is
    among the chosen ones (request_id, version_id) of their request, with the reason."""
    one = items.select("request_id", "kind", "position", F.explode("versions").alias("version_id"))
    met = one.join(chosen.select("request_id", "version_id").distinct(), ["request_id", "version_id"], "left_semi").select("request_id", "kind", "position").distinct()
    return items.select("request_id", "kind", "position").join(met, ["request_id", "kind", "position"], "left_anti").withColumn("reason", F.concat("kind", F.lit("_version_not_selected")))


def invalid_ranges(ranges: DataFrame, counts: DataFrame) -> DataFrame:
    """Page ranges (request_id, version_id, position, first, last) that are not within the pages of their version in order."""
    r = ranges.join(counts.select("version_id", "page_count"), "version_id")
    good = (F.col("first") >= 0) & (F.col("first") <= F.col("last")) & (F.col("last") < F.col("page_count"))
    return r.filter(~F.coalesce(good, F.lit(False))).select("request_id", "version_id", "position", F.lit("invalid_range").alias("reason"))


def auto_anchors(candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """Anchors added to a bundle (bundle_id, anchor_id, reason) by their first reason, but those chosen already."""
    rank = F.when(F.col("reason") == "linked_by_proposal", 0).otherwise(1)
    first = candidates.groupBy("bundle_id", "anchor_id").agg(F.min_by("reason", rank).alias("reason"))
    return first.join(chosen, ["bundle_id", "anchor_id"], "left_anti")


def bundle_text_pages(requests: DataFrame) -> DataFrame:
    """Pages of each request (bundle_id, mode, page_count, anchor_page and, for ``ranges``, an array of
    structs first, last) by mode none, all, anchor_pages or ranges; a range ends with the last page."""
    last = F.col("page_count") - 1
    pages = F.when(F.col("mode") == "all", F.sequence(F.lit(0), last)).when(F.col("mode") == "anchor_pages", F.array("anchor_page"))
    if "ranges" in requests.columns:
        span = lambda r: F.when(r["first"] <= F.least(r["last"], last), F.sequence(r["first"], F.least(r["last"], last))).otherwise(F.array().cast("array<int>"))
        pages = pages.when(F.col("mode") == "ranges", F.flatten(F.transform("ranges", span)))
    return requests.select("bundle_id", F.explode(pages).alias("page_index")).distinct()


def bundle_refs(anchors: DataFrame) -> DataFrame:
    """src_n by version and anc_n in reading order within each bundle; unsafe names become n001."""
    w = Window.partitionBy("bundle_id")
    order = w.orderBy("version_id", "page_index", "v", "u", "annotation_id")
    safe = F.col("name").rlike("^[A-Za-z0-9_-]{1,64}$")
    a = anchors.withColumns({"source_ref": F.concat(F.lit("src_"), F.dense_rank().over(w.orderBy("version_id")).cast("string")), "anchor_ref": F.concat(F.lit("anc_"), F.row_number().over(order).cast("string"))})
    n = F.sum(F.when(safe, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return a.withColumn("file_name", F.when(safe, F.col("name")).otherwise(F.concat(F.lit("n"), F.lpad(n.cast("string"), 3, "0")))).select("bundle_id", "annotation_id", "source_ref", "anchor_ref", "file_name")


def bundle_totals(files: DataFrame) -> DataFrame:
    """Files, bytes, largest path and files by kind of each bundle (bundle_id, path, size_bytes)."""
    kinds = ("anchors", "proposals", "answers", "assets", "texts", "artifacts")
    return files.groupBy("bundle_id").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.max_by("path", F.struct("size_bytes", "path")).alias("largest"), *[F.count_if(F.col("path").startswith(f"{k}/")).alias(k) for k in kinds])


def bundle_manifest(files: DataFrame) -> DataFrame:
    """Hash and size of each file (bundle_id, path, content), and whether its bundle keeps the limits."""
    f = files.withColumns({"sha256": F.sha2("content", 256), "size_bytes": F.octet_length("content").cast("long")})
    t = f.groupBy("bundle_id").agg(F.count("*").alias("n"), F.max("size_bytes").alias("most"), F.sum("size_bytes").alias("total"))
    over = (F.col("n") > MOST_FILES) | (F.col("most") > FILE_BYTES) | (F.col("total") > BUNDLE_BYTES)
    near = (F.col("n") > 0.8 * MOST_FILES) | (F.col("total") > 0.8 * BUNDLE_BYTES)
    return f.join(t.select("bundle_id", F.when(over, "over_limit").when(near, "near_limit").otherwise("ok").alias("state")), "bundle_id").select("bundle_id", "path", "sha256", "size_bytes", "state")


def bundle_texts(blocks: DataFrame, kinds: DataFrame, sections: DataFrame) -> DataFrame:
    """A text document of each page: its blocks in order with kind and section, and the hash."""
    b = blocks.join(kinds, ["version_id", "p"]).join(sections, ["version_id", "p"])
    row = F.concat_ws("|", F.col("p").cast("string"), "kind", F.coalesce("section", F.lit("")), "text")
    doc = b.groupBy("version_id", "page_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", row.alias("row")))), lambda x: x["row"]), "\n").alias("document"))
    return doc.withColumn("sha256", F.sha2("document", 256))


def bundle_documents(answers: DataFrame) -> DataFrame:
    """Each answer as a document whose fence is longer than any run of backticks in it."""
    longest = F.aggregate(F.transform(F.regexp_extract_all("markdown", F.lit("`+"), F.lit(0)), lambda x: F.length(x)), F.lit(2), lambda a, x: F.greatest(a, x))
    fence = F.repeat(F.lit("`"), longest + 1)
    return answers.select("answer_id", F.concat_ws("\n", F.concat(F.lit("# Answer "), F.col("answer_id").cast("string")), F.substring(F.coalesce("prompt", F.lit("")), 1, 200), fence, "markdown", fence).alias("document"))


def bundle_warnings(pages: DataFrame, anchors: DataFrame, citations: DataFrame, manifest: DataFrame) -> DataFrame:
    """(bundle_id, code, subject, detail) of what is wanting in bundles, by code.

    pages_not_extracted: pages (bundle_id, version_id, page_index, extracted) of a version that are missing, from one on;
    TEXT_NOT_READY where all of a version's are. region_without_image and empty_quote: how many anchors (bundle_id,
    version_id, kind, quote, has_image) of a version lack theirs. unresolved_answer_citation: numbers of the citations
    (bundle_id, answer_id, number, pos, resolved) of an answer that name nothing in the bundle, each once in order.
    over_limit and near_limit: the files and bytes of a bundle by its manifest (bundle_id, size_bytes, state).
    """
    row = lambda df, code, subject, detail: df.select("bundle_id", F.lit(code).alias("code"), F.col(subject).cast("string").alias("subject") if subject else F.lit(None).cast("string").alias("subject"), detail.cast("string").alias("detail"))
    missing = ~F.coalesce("extracted", F.lit(False))
    p = pages.groupBy("bundle_id", "version_id").agg(F.array_sort(F.collect_set(F.when(missing, F.col("page_index") + 1))).alias("gone"), F.every(missing).alias("all"))
    p = p.filter(F.size("gone") > 0)
    out = row(p, "pages_not_extracted", "version_id", F.array_join(F.col("gone").cast("array<string>"), ", "))
    out = out.unionByName(row(p.filter("all"), "TEXT_NOT_READY", "version_id", F.size("gone")))
    region, empty = (F.col("kind") != "text") & ~F.coalesce("has_image", F.lit(False)), (F.col("kind") == "text") & (F.coalesce("quote", F.lit("")) == "")
    a = anchors.groupBy("bundle_id", "version_id").agg(F.count_if(region).alias("regions"), F.count_if(empty).alias("empty"))
    out = out.unionByName(row(a.filter("regions > 0"), "region_without_image", "version_id", F.col("regions"))).unionByName(row(a.filter("empty > 0"), "empty_quote", "version_id", F.col("empty")))
    c = citations.filter(~F.coalesce("resolved", F.lit(False))).groupBy("bundle_id", "answer_id", "number").agg(F.min("pos").alias("pos"))
    c = c.groupBy("bundle_id", "answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "number"))), lambda x: x["number"].cast("string")), ", ").alias("numbers"))
    out = out.unionByName(row(c, "unresolved_answer_citation", "answer_id", F.col("numbers")))
    m = manifest.filter("state <> 'ok'").groupBy("bundle_id", "state").agg(F.concat(F.count("*").cast("string"), F.lit(" files, "), F.sum("size_bytes").cast("string"), F.lit(" bytes")).alias("detail"))
    return out.unionByName(m.select("bundle_id", F.col("state").alias("code"), F.lit(None).cast("string").alias("subject"), "detail"))


def list_bundles(log: DataFrame, limit: int) -> DataFrame:
    """The newest bundles: a top-k report."""
    return log.orderBy(F.desc("created_at"), "bundle_id").limit(limit)
