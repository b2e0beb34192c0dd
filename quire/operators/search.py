"""Search: parsing of queries and marking of matches. ``search_index`` ranks, ``quotes`` locates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nfkc


def parse_queries(queries: DataFrame) -> DataFrame:
    """Terms of each query (query_id, query) in NFKC: quoted phrases are exact, bare words are prefixes; 16
    terms of 200 characters in sum at most; terms without a letter or digit are dropped."""
    queries = nfkc(queries.select("query_id", "query"), "query")
    items = F.regexp_extract_all(F.substring("query", 1, 200), F.lit(r'("[^"]*"|[^\s"]+)'), F.lit(1))
    good = F.slice(F.filter(items, lambda x: x.rlike(r"[\p{L}\p{N}]")), 1, 16)
    t = queries.select("query_id", F.posexplode(good).alias("term_no", "item"))
    tokens = F.filter(F.split(F.lower("item"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return t.select("query_id", "term_no", tokens.alias("tokens"), (~F.col("item").startswith('"')).alias("is_prefix"))


def invalid_queries(queries: DataFrame) -> DataFrame:
    """(query_id, code) of the queries without a term."""
    terms = parse_queries(queries).select("query_id").distinct()
    return queries.select("query_id").distinct().join(terms, "query_id", "left_anti").withColumn("code", F.lit("INVALID_QUERY"))


def highlight(hits: DataFrame, text_col: str, terms: list[str]) -> DataFrame:
    """Texts as parts (text, match): runs of words that are terms, and what lies between."""
    words = F.split(F.col(text_col), " ")
    is_term = F.lower(F.regexp_replace("word", "[^A-Za-z0-9]", "")).isin([t.lower() for t in terms])
    w = hits.select("doc", F.posexplode(words).alias("i", "word")).withColumn("match", is_term)
    over = Window.partitionBy("doc").orderBy("i")
    w = w.withColumn("run", F.sum(F.when(F.col("match") == F.lag("match").over(over), 0).otherwise(1)).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return w.groupBy("doc", "run", "match").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("part"))
