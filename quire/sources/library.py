"""Sources and sinks: typed library tables, intake screening, JSON columns, bibliography responses, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables of a library and their schemas; read as Parquet from a folder, one temporary view each.
SCHEMAS = {
    "papers": "paper_id string, owner_id string, title string, authors array<string>, year int, doi string, current_version_id string, created_at timestamp, last_opened_at timestamp, metadata_lookup string",
    "source_versions": "version_id string, paper_id string, sha256 string, size_bytes long, page_count int, status string, status_reason string",
    "anchors": "anchor_id string, version_id string, page_index int, kind string, quads array<array<double>>, quote string, display_quote string, prefix string, suffix string",
    "annotations": "annotation_id string, anchor_id string, comment string, color string, revision int, created_at timestamp",
    "text_blocks": "version_id string, page_index int, block_id string, reading_order int, text string, regions array<array<double>>, quality_flags array<string>, styles array<struct<start:int,end:int,mark:string>>, font_size double",
    "parse_runs": "run_id string, version_id string, parser_version int, config_hash string, status string, attempts int, lease_expires_at timestamp, started_at timestamp, finished_at timestamp",
    "pages": "version_id string, page_index int, label string, view_box array<double>, rotation int, text_status string, flags array<string>, quality struct<chars:int,unmapped_chars:int,image_coverage:double,error:string>",
    "context_packets": "packet_id string, owner_id string, content_json string, content_sha256 string, status string, sources array<struct<paper_id:string,version_id:string>>, created_at timestamp, confirmed_at timestamp, handed_off_at timestamp, imported_at timestamp",
    "answers": "answer_id string, packet_id string, session string, origin string, prompt string, markdown string, created_at timestamp, discarded_at timestamp",
    "paper_tags": "paper_id string, tag string",
    "answer_images": "answer_id string, position int, data binary",
    "chat_threads": "thread_id string, session string, paper_id string, version_id string, page_index int, anchor_id string, parent_session string, cut_answer_id string, kind string, created_at timestamp, deleted_at timestamp",
    "chat_titles": "session string, title string, updated_at timestamp",
    "tags": "owner_id string, name string, created_at timestamp",
    "host_connections": "connection_id string, name string, created_at timestamp",
    "share_grants": "grant_id string, packet_id string, connection_id string, created_at timestamp",
    "evidence_bundles": "bundle_id string, owner_id string, created_at timestamp, files int, size_bytes long",
    "idempotency_keys": "scope string, key string, request_sha256 string, response string, created_at timestamp",
    "page_translations": "version_id string, page_index int, language string, blocks array<struct<source:string,sentences:array<string>>>",
}
MOST_BYTES, MOST_PAGES, HEADER_BYTES = 100 << 20, 300, 1024


def read_library(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables by name, with fixed schemas, each also a temporary view."""
    tables = {n: spark.read.schema(SCHEMAS[n]).parquet(f"{path}/{n}.parquet") for n in names or SCHEMAS}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return tables


def screen_intake(files: DataFrame) -> DataFrame:
    """Files (path, content, page_count) with their hash and the code of the first rule they break."""
    head = F.substring("content", 1, HEADER_BYTES)
    code = (
        F.when(F.locate("%PDF-", F.decode(head, "ISO-8859-1")) == 0, "NOT_PDF").when(F.octet_length("content") > MOST_BYTES, "RESOURCE_LIMIT")
        .when(F.col("page_count").isNull() | (F.col("page_count") < 1), "MALFORMED_PDF").when(F.col("page_count") > MOST_PAGES, "RESOURCE_LIMIT")
    )
    return files.withColumns({"sha256": F.sha2("content", 256), "reject_code": code})


def decode_json(df: DataFrame, schemas: dict[str, str], empty: tuple[str, ...] = ()) -> DataFrame:
    """JSON text columns as nested ones; a missing value of a column in ``empty`` is an empty array."""
    out = df
    for name, schema in schemas.items():
        value = F.from_json(name, schema)
        out = out.withColumn(name, F.coalesce(value, F.array().cast(schema)) if name in empty else value)
    return out


CROSSREF = "message struct<author:array<struct<name:string,given:string,family:string>>," + ",".join(f"`{k}`:struct<`date-parts`:array<array<int>>>" for k in ("issued", "published", "published-print", "published-online", "created")) + ">"
ATOM = "entry struct<author:array<struct<name:string>>,published:string,id:string,title:string>"


def _names(names: F.Column) -> F.Column:
    clean = F.transform(names, lambda x: F.substring(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), 1, 300))
    return F.slice(F.filter(clean, lambda x: x != ""), 1, 100)


def decode_bibliography(responses: DataFrame) -> DataFrame:
    """Authors and year of staged responses (kind, value, body): Crossref JSON for ``doi``, Atom XML for ``arxiv``."""
    r = responses.withColumns({"j": F.from_json(F.when(F.col("kind") == "doi", F.col("body")), CROSSREF), "x": F.from_xml(F.when(F.col("kind") == "arxiv", F.col("body")), ATOM)})
    crossref = F.transform("j.message.author", lambda a: F.coalesce(a["name"], F.concat_ws(" ", a["given"], a["family"])))
    years = [F.get(F.get(F.col(f"j.message.`{k}`.`date-parts`"), F.lit(0)), F.lit(0)) for k in ("issued", "published", "published-print", "published-online", "created")]
    error = F.col("x.entry.id").contains("api/errors") | F.coalesce(F.col("x.entry.title") == "Error", F.lit(False))
    atom = F.when(~F.coalesce(error, F.lit(False)), F.transform("x.entry.author", lambda a: a["name"]))
    year = F.when(F.col("kind") == "doi", F.coalesce(*years)).otherwise(F.when(~F.coalesce(error, F.lit(False)), F.try_to_number(F.substring("x.entry.published", 1, 4), F.lit("9999")).cast("int")))
    return r.select("kind", "value", _names(F.when(F.col("kind") == "doi", crossref).otherwise(atom)).alias("authors"), F.when(year.between(1000, 2100), year).alias("year"))


def upsert_translations(target: DataFrame, updates: DataFrame) -> DataFrame:
    """Translations by (version_id, page_index, language); an update replaces the stored one."""
    keys = ["version_id", "page_index", "language"]
    both = target.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    rest = [c for c in target.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_new").alias("r")).select(*keys, "r.*")
