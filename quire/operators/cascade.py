"""Deletion over a graph of tables: what hangs on a row by declared keys goes with it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hangs:
    """Rows of ``table`` go if ``key``, an expression for one key or an array of them, names ``column`` of a row of ``on`` that goes."""

    table: str
    key: str
    on: str
    column: str


#: What identifies the rows of the tables on which others hang, or of which a key is an array.
IDENTITY = {"papers": "paper_id", "source_versions": "version_id", "anchors": "anchor_id", "context_packets": "packet_id", "answers": "answer_id"}
#: The library's graph, in an order in which a table comes behind those on which it hangs.
LIBRARY = (
    Hangs("source_versions", "paper_id", "papers", "paper_id"),
    Hangs("paper_tags", "paper_id", "papers", "paper_id"),
    Hangs("context_packets", "transform(sources, s -> s.paper_id)", "papers", "paper_id"),
    Hangs("anchors", "version_id", "source_versions", "version_id"),
    Hangs("parse_runs", "version_id", "source_versions", "version_id"),
    Hangs("pages", "version_id", "source_versions", "version_id"),
    Hangs("text_blocks", "version_id", "source_versions", "version_id"),
    Hangs("page_translations", "version_id", "source_versions", "version_id"),
    Hangs("annotations", "anchor_id", "anchors", "anchor_id"),
    Hangs("share_grants", "packet_id", "context_packets", "packet_id"),
    Hangs("answers", "packet_id", "context_packets", "packet_id"),
    Hangs("answer_images", "answer_id", "answers", "answer_id"),
    Hangs("chat_threads", "session", "answers", "session"),
    Hangs("chat_titles", "session", "answers", "session"),
)


def delete_papers(tables: dict[str, DataFrame], ids: DataFrame, graph: tuple[Hangs, ...] = LIBRARY) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without the papers of ``ids`` and all that hangs on them, the refused papers).

    A paper with a RUNNING run in ``parse_runs`` is refused, and nothing of it goes. A packet goes if any of its sources does.
    ``tags`` lose the names that only deleted papers had; names that no paper had before stay. Tables that are
    not given are passed over; so are papers that are not there. Keys that are null hang on nothing.
    """
    wanted = ids.select("paper_id").distinct()
    if "parse_runs" in tables and "source_versions" in tables:
        running = tables["parse_runs"].filter("status = 'RUNNING'").select("version_id").distinct()
        busy = tables["source_versions"].join(running, "version_id", "left_semi").select("paper_id").distinct()
        refused = wanted.join(busy, "paper_id", "left_semi")
        wanted = wanted.join(busy, "paper_id", "left_anti")
    else:
        refused = wanted.limit(0)
    gone = {"papers": tables["papers"].join(wanted, "paper_id", "left_semi")}
    left = {"papers": tables["papers"].join(wanted, "paper_id", "left_anti")}
    for edge in graph:
        if edge.table not in tables or edge.on not in gone:
            continue
        df = tables[edge.table]
        names = gone[edge.on].select(F.col(edge.column).alias("_key")).filter("_key is not null").distinct()
        if df.select(F.expr(edge.key)).schema[0].dataType.typeName() == "array":
            own = IDENTITY[edge.table]
            hit = df.select(own, F.explode(F.expr(edge.key)).alias("_key")).join(names, "_key", "left_semi").select(own).distinct()
            gone[edge.table], left[edge.table] = df.join(hit, own, "left_semi"), df.join(hit, own, "left_anti")
        else:
            keyed = df.withColumn("_key", F.expr(edge.key))
            gone[edge.table] = keyed.join(names, "_key", "left_semi").drop("_key")
            left[edge.table] = keyed.join(names, "_key", "left_anti").drop("_key")
    if "tags" in tables and "paper_tags" in left:
        lower = lambda df: df.select(F.lower("tag").alias("_tag")).distinct()
        orphans = lower(gone["paper_tags"]).join(lower(left["paper_tags"]), "_tag", "left_anti")
        left["tags"] = tables["tags"].join(orphans, F.lower("name") == F.col("_tag"), "left_anti")
    return {n: left.get(n, df) for n, df in tables.items()}, refused
