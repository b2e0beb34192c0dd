"""Queries that search: by the stored index, and for quotes."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import scratch_dir
from ..operators import quotes as Q
from ..operators import search_index as X
from ..operators import structure as S
from ..sources import adapters as A
from ..sources.adapters_sql import with_tables
from .structure_queries import HEADS, NOT_BODY_SQL, PATHS, SECTION_BODY

QUERY_TERMS = [("q1", "the"), ("q1", "with"), ("q2", "und"), ("q2", "die"), ("q3", "que"), ("q3", "les"), ("q4", "section")]
BM25_SQL = """q AS (SELECT * FROM (VALUES ('q1','the'),('q1','with'),('q2','und'),('q2','die'),('q3','que'),('q3','les'),('q4','section')) t(query_id, term)),
  toks AS (SELECT doc, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ts FROM d),
  stats AS (SELECT count(*) AS n_docs, avg(len(ts)) AS avg_len FROM toks WHERE len(ts) > 0),
  post AS (SELECT doc, len, term, count(*) AS tf FROM (SELECT doc, len(ts) AS len, unnest(ts) AS term FROM toks) GROUP BY ALL),
  hits AS (SELECT * FROM post JOIN q USING (term)), df AS (SELECT term, count(DISTINCT doc) AS df FROM hits GROUP BY term), need AS (SELECT query_id, count(*) AS need FROM q GROUP BY 1),
  sc AS (SELECT query_id, doc, count(*) AS found, sum(ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))) AS score FROM hits JOIN df USING (term), stats GROUP BY 1, 2),
  ranked AS (SELECT query_id, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc) AS rank FROM sc JOIN need USING (query_id) WHERE found = need)"""


PHRASES = [("a", 0, ["the"], False), ("a", 1, ["s"], True), ("b", 0, ["in", "the"], False), ("c", 0, ["et", "l"], True), ("d", 0, ["and"], False), ("d", 1, ["co"], True)]
PHRASE_SQL = """q AS (SELECT * FROM (VALUES ('a',0,['the'],false),('a',1,['s'],true),('b',0,['in','the'],false),('c',0,['et','l'],true),('d',0,['and'],false),('d',1,['co'],true)) v(query_id, term_no, tokens, is_prefix)),
  toks AS (SELECT paper_id AS doc, list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda x: x <> '') AS ts FROM papers),
  stats AS (SELECT count(*) AS n_docs, avg(len(ts)) AS avg_len FROM toks WHERE len(ts) > 0),
  pos AS (SELECT doc, len(ts) AS len, ts, unnest(range(1, len(ts) + 1)) AS i FROM toks),
  parts AS (SELECT query_id, term_no, doc, len, count(*) AS tf FROM pos, q WHERE CASE WHEN len(tokens) = 1 THEN CASE WHEN is_prefix THEN starts_with(ts[i], tokens[1]) ELSE ts[i] = tokens[1] END ELSE i < len AND ts[i] = tokens[1] AND CASE WHEN is_prefix THEN starts_with(ts[i + 1], tokens[2]) ELSE ts[i + 1] = tokens[2] END END GROUP BY ALL),
  df AS (SELECT query_id, term_no, count(*) AS df FROM parts GROUP BY ALL), need AS (SELECT query_id, count(*) AS need FROM q GROUP BY 1),
  sc AS (SELECT query_id, doc, count(*) AS found, sum(ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))) AS score FROM parts JOIN df USING (query_id, term_no), stats GROUP BY 1, 2),
  ranked AS (SELECT query_id, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc) AS rank FROM sc JOIN need USING (query_id) WHERE found = need)"""
FOLD = r"regexp_replace(lower({}), '[\s\x{{2010}}-\x{{2015}}\x{{00AD}}\x{{2212}}\x{{00A0}}-]+', '', 'g')"




def _state(table: DataFrame) -> str:
    """A name of the files of ``table`` and their times."""
    files = table.select("_metadata.file_path", F.col("_metadata.file_modification_time").cast("string")).distinct().orderBy("file_path")
    return hashlib.sha256(repr([tuple(r) for r in files.collect()]).encode()).hexdigest()[:24]


def _stored_index(spark: SparkSession, d: str, name: str, docs, id_col: str, fields: tuple[str, ...] = ()) -> X.Index:
    """The index of ``docs(spark, d)`` over the documents as they are now: opened if it is stored, else written
    beside its place and then moved there as a whole."""
    path = f"{scratch_dir(spark)}/quire/index-{name}-{_state(A.table(spark, d, 'documents'))}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at):
        own = f"{path}-{uuid.uuid4().hex}"
        X.write_index(docs(spark, d), own, id_col, "text", fields)
        if store.exists(at) or not store.rename(spark._jvm.org.apache.hadoop.fs.Path(own), at):
            return X.open_index(spark, own)  # another session was first
    return X.open_index(spark, path)


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Body paragraphs with their page and section."""
    b = A.blocks(spark, d)
    sections = S.section_paths(b, S.headings(b))
    doc = (F.col("version_id") * 100000 + F.col("p")).alias("doc")
    return S.body_blocks(b).join(sections, ["version_id", "p"], "left").select(doc, "text", "page_index", "section")


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return A.papers(spark, d).select("paper_id", F.col("title").alias("text"))


def _words(spark: SparkSession) -> DataFrame:
    """QUERY_TERMS as parsed terms: whole words."""
    seen: dict[str, int] = {}
    rows = []
    for query, word in QUERY_TERMS:
        rows.append((query, seen.get(query, 0), [word], False))
        seen[query] = seen.get(query, 0) + 1
    return spark.createDataFrame(rows, "query_id string, term_no int, tokens array<string>, is_prefix boolean")


def search_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Body paragraphs for four queries, with page and section: the flagship."""
    index = _stored_index(spark, d, "blocks", _paragraphs, "doc", ("page_index", "section"))
    return X.search_index(index, _words(spark))


def _title_index(spark: SparkSession, d: str) -> X.Index:
    return _stored_index(spark, d, "titles", _titles, "paper_id")


def _positions(spark: SparkSession, d: str) -> DataFrame:
    """All postings of the titles, position by position."""
    e = _title_index(spark, d).table("postings").select("term", F.explode("entries").alias("e"))
    return e.select("term", F.col("e.doc").alias("doc"), F.col("e.len").alias("len"), F.explode("e.positions").alias("pos"))


def _phrase_terms(spark):
    return spark.createDataFrame(PHRASES, "query_id string, term_no int, tokens array<string>, is_prefix boolean")


def _short_and_long_quotes(spark, d):
    """Each benchmark item whole, and its first three words."""
    b = A.table(spark, d, "benchmark")
    words = F.slice(F.filter(F.split("text", "[ ]+"), lambda x: x != ""), 1, 3)
    return b.select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")).unionByName(b.select((F.col("item_id") + 1000000).alias("quote_id"), F.array_join(words, " ").alias("quote")))


SECTIONS = f"sections AS ({SECTION_BODY})"
TITLE_WORDS = "SELECT paper_id AS doc, list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda x: x <> '') AS ts FROM papers"


def search_queries() -> dict:
    return {
        "search_blocks": (
            search_blocks,
            with_tables("blocks", more=HEADS + ", " + PATHS + ", " + SECTIONS + f", d AS (SELECT version_id::BIGINT * 100000 + p AS doc, text FROM blocks WHERE trim(text) <> '' AND NOT {NOT_BODY_SQL}), " + BM25_SQL,
                        body="SELECT query_id, rank, doc, score, page_index, section FROM ranked JOIN blocks b ON doc = b.version_id::BIGINT * 100000 + b.p JOIN sections x ON x.version_id = b.version_id AND x.p = b.p WHERE rank <= 20"),
        ),
        "search_titles": (lambda x, d: X.search_index(_title_index(x, d), _words(x), 10), with_tables("papers", more="d AS (SELECT paper_id AS doc, title AS text FROM papers), " + BM25_SQL, body="SELECT query_id, rank, doc, score FROM ranked WHERE rank <= 10")),
        "build_index": (
            lambda x, d: _title_index(x, d).table("postings").withColumn("tf", F.aggregate("entries", F.lit(0).cast("long"), lambda a, e: a + F.size(e["positions"]))).groupBy("term").agg(F.sum("n").alias("docs"), F.sum("tf").alias("tf")),
            with_tables("papers", body="SELECT term, count(DISTINCT doc) AS docs, count(*) AS tf FROM (SELECT paper_id AS doc, unnest(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM papers) GROUP BY term"),
        ),
        "index_positions": (_positions, with_tables("papers", more=f"toks AS ({TITLE_WORDS})", body="SELECT ts[i] AS term, doc, len(ts)::INT AS len, (i - 1)::INT AS pos FROM (SELECT doc, ts, unnest(range(1, len(ts) + 1)) AS i FROM toks)")),
        "index_terms": (
            lambda x, d: _title_index(x, d).table("terms").select("word", "df"),
            with_tables("papers", more=f"toks AS ({TITLE_WORDS})", body="SELECT word, count(DISTINCT doc) AS df FROM (SELECT doc, unnest(ts) AS word FROM toks) GROUP BY word"),
        ),
        "search_phrases": (
            lambda x, d: X.search_index(_title_index(x, d), _phrase_terms(x), 20),
            with_tables("papers", more=PHRASE_SQL, body="SELECT query_id, rank, doc, score FROM ranked WHERE rank <= 20"),
        ),
        "locate_quotes": (
            lambda x, d: Q.locate_quotes(_short_and_long_quotes(x, d), A.documents(x, d).select(F.col("doc_id").alias("doc"), "text")).select("doc", "quote_id", F.size("starts").alias("places"), F.col("starts")[0].alias("first_start")),
            rf"""WITH b AS (SELECT item_id, {FOLD.format("text")} AS f, text FROM benchmark),
              q AS (SELECT item_id AS quote_id, f AS q FROM b UNION ALL SELECT item_id + 1000000, {FOLD.format("array_to_string((list_filter(regexp_split_to_array(text, '[ ]+'), lambda x: x <> ''))[1:3], ' ')")} FROM b),
              t AS (SELECT doc_id AS doc, {FOLD.format("coalesce(text, '')")} AS t FROM documents)
              SELECT doc, quote_id, (len(string_split(t, q)) - 1)::INT AS places, (instr(t, q) - 1)::INT AS first_start FROM t JOIN q ON q <> '' AND contains(t, q)""",
        ),
    }
