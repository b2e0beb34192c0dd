"""Engine tables from the documents, pages, conversations, labels, benchmark and events tables.

Headings, captions, references, citations and flags that those tables lack are constant expressions
of the position of a line, so a run over more documents has more of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOPS = (0.02, 0.2, 0.4, 0.6, 0.93)
EPOCH = "2024-01-01 00:00:00"
#: Tables of fewer rows stay as they are read.
SPREAD_ROWS = 1000
#: The space separators (Zs) of Unicode. Without a list, Spark trims U+0020 only.
SPACES = "".join(map(chr, (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt by ``key`` over the shuffle's partitions if their files leave most cores idle: a file with one
    row group, whatever its size, is read by one task, and work on texts stays there until the next shuffle.
    The check counts rows by task from the files' footers."""
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("task")).count().collect()]  # one number a task
    total = sum(sizes)
    idle = total >= SPREAD_ROWS and max(sizes) * rows.sparkSession.sparkContext.defaultParallelism > 2 * total
    return rows.repartition(F.col(key)) if idle else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table for work on whole texts."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def _at(seconds) -> F.Column:
    return F.timestamp_seconds(F.lit(1704067200) + seconds)


def _lines() -> F.Column:
    """The lines of a text without spaces at their ends; blank ones are left out, so there may be none."""
    return F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x, F.lit(SPACES))), lambda x: x != "")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs: version_id, p (from 0), page_index, reading_order, text, box, font_size, quality_flags."""
    b = documents(spark, sf_dir).select(F.col("doc_id").alias("version_id"), F.posexplode(_lines()).alias("p", "raw"))
    n = F.floor(F.col("p") / 7).cast("int") + 1
    text = (
        F.when((F.col("p") % 21 == 20), F.lit("References"))
        .when(F.col("p") % 7 == 2, F.concat(n.cast("string"), F.lit(" Section "), n.cast("string")))
        .when(F.col("p") % 7 == 4, F.concat(F.lit("Fig. "), n.cast("string"), F.lit(". "), F.col("raw")))
        .when(F.col("p") % 7 == 1, F.concat("raw", F.lit(" [1, 2] see 10.1234/q"), F.col("version_id").cast("string"), F.lit(".")))
        .when(F.col("p") % 21 == 19, F.concat(F.lit("["), n.cast("string"), F.lit("] "), F.col("raw")))
        .otherwise(F.col("raw"))
    )
    r = (F.col("p") % 5).cast("int")
    top = F.element_at(F.array(*map(F.lit, TOPS)), r + 1)
    flags = F.when(F.col("p") % 13 == 5, F.array(F.lit("math"))).when(F.col("p") % 13 == 8, F.array(F.lit("in_table"))).otherwise(F.array().cast("array<string>"))
    return b.select(
        "version_id", "p", F.floor(F.col("p") / 5).cast("int").alias("page_index"), r.alias("reading_order"), text.alias("text"),
        F.lit(0.1).alias("x0"), top.alias("y0"), F.lit(0.9).alias("x1"), (top + 0.05).alias("y1"),
        F.when(F.col("p") == 0, 14.0).when(F.col("p") % 7 == 2, 12.0).otherwise(10.0).alias("font_size"), flags.alias("quality_flags"),
    )


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper of each document; its title is the first line, null if no line is left."""
    d = documents(spark, sf_dir)
    first = F.get(_lines(), F.lit(0))
    i = F.col("doc_id")
    return d.select(
        i.alias("paper_id"), i.alias("version_id"), F.when(i % 3 == 0, "team").otherwise("local").alias("owner_id"),
        F.when(i % 6 == 1, F.concat(F.lit("<b>"), F.substring(first, 1, 290), F.lit("</b>"))).otherwise(F.substring(first, 1, 300)).alias("title"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), _at(i).alias("created_at"),
        F.when(i % 4 == 0, _at(i + 86400)).alias("last_opened_at"), F.when(i % 5 == 1, "").when(i % 5 > 1, F.concat(F.lit("10.1234/p"), i.cast("string"))).alias("doi"),
        F.when(i % 17 == 0, _at(i + 172800)).alias("deleted_at"), (1900 + i % 130).cast("int").alias("year"), "source",
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with the last user turn before them; markers and fences by position."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    a = c.withColumn("prompt", F.last(F.when(F.col("role") == "user", F.col("text")), True).over(w)).filter("role = 'assistant'")
    k, t = F.col("conv_id"), F.col("turn")
    marks = F.concat(F.lit(" [cite "), (t % 4 + 1).cast("string"), F.lit("¶"), (k % 3 + 1).cast("string"), F.lit(", 9] and [cite "), (k % 5 + 1).cast("string"), F.lit("] see Fig. "), (k % 3 + 1).cast("string"), F.lit(", p.1"), (k % 9).cast("string"), F.lit("\n```html title\n<p>"), k.cast("string"), F.lit("</p>\n```\nend"))
    return a.select(
        (k * 1000 + t).alias("answer_id"), k.alias("session"), t.alias("turn"), "prompt", F.concat("text", marks).alias("markdown"), _at(k * 600 + t * 60).alias("created_at"),
        F.when(k % 7 == 0, "import").otherwise("chat").alias("origin"), F.when((k + t) % 11 == 0, _at(k * 600 + t * 60 + 5)).alias("discarded_at"), k.alias("packet_id"),
    )


def paper_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    la = table(spark, sf_dir, "labels")
    q = la.filter("quality = 1").select(F.col("doc_id").alias("paper_id"), F.lit("Quality").alias("tag"))
    t = la.filter("toxic = 1").select(F.col("doc_id").alias("paper_id"), F.when(F.col("doc_id") % 2 == 0, "toxic").otherwise("TOXIC").alias("tag"))
    h = la.filter("quality = 0").select(F.col("doc_id").alias("paper_id"), F.when(F.col("doc_id") % 3 == 0, "quality").otherwise("poor").alias("tag"))
    return q.unionByName(t).unionByName(h)


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highlights and notes with their anchors, from the event log."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    comment = F.when(F.col("event_type") == "click", F.concat(F.lit("Note "), F.col("props"))).when(F.col("event_type") == "view", F.lit("")).when(F.col("event_type") == "signup", F.lit(None)).otherwise(F.col("event_type"))
    return e.select(
        i.alias("annotation_id"), F.col("user_id").alias("version_id"), (i % 40).cast("int").alias("page_index"), ((i * 7919 % 1000) / 1000.0).alias("v"), ((i * 104729 % 1000) / 1000.0).alias("u"),
        F.when(i % 3 == 0, "region").otherwise("text").alias("kind"), F.when(i % 5 < 3, F.concat(F.lit("c"), (i % 5 + 1).cast("string"))).alias("color"),
        F.concat(F.lit("Quote "), (i % 50).cast("string")).alias("quote"), F.when(i % 4 == 0, F.concat(F.lit("x^2 "), (i % 9).cast("string"))).alias("display_quote"), comment.alias("comment"), F.col("ts").cast("timestamp").alias("created_at"), "value",
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyph counts of each page: chars without spaces, unmapped ones, image coverage."""
    b = blocks(spark, sf_dir)
    chars = F.length(F.regexp_replace("text", " ", ""))
    g = b.groupBy("version_id", "page_index").agg(F.sum(chars).alias("chars"), F.sum(F.length(F.regexp_replace("text", "[^#%$&]", ""))).alias("unmapped"))
    cover = F.when((F.col("version_id") + F.col("page_index")) % 9 == 0, 0.9).otherwise(0.1)
    return g.withColumn("coverage", cover)
