"""Work on texts of one file runs on all cores, and quotes fold each character once."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import quotes as Q
from quire.sources import adapters as A


def _one_file(spark, folder, rows):
    long = [F.sha2(F.concat_ws(" ", "id", F.lit(k)), 256) for k in range(60)]  # some kilobytes that do not compress
    text = F.concat(F.lit("Line of "), *long, F.lit(".\nSecond é line. It goes on."))
    docs = spark.range(0, rows, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"))
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_blocks_of_one_file_are_made_in_several_tasks(spark, tmp_path):
    d = _one_file(spark, tmp_path, 2000)
    blocks = A.blocks(spark, d).filter("p = 1")
    tasks = blocks.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == 2000
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 1500
    assert A.papers(spark, d).select("paper_id").distinct().count() == 2000


def test_even_and_small_tables_stay_as_they_are_read(spark, tmp_path):
    even = spark.range(0, 4000, 1, 8).select(F.col("id").alias("doc_id"))
    assert A.spread(even, "doc_id") is even
    few = spark.range(0, 10, 1, 1).select(F.col("id").alias("doc_id"))
    assert A.spread(few, "doc_id") is few
    none = few.filter("doc_id < 0")
    assert A.spread(none, "doc_id").count() == 0


def test_each_character_is_folded_once(monkeypatch):
    calls, fold = [], Q.fold
    monkeypatch.setattr(Q, "fold", lambda x: calls.append(x) or fold(x))
    parts = ["Ǆé ﬁ-İ­" * 2000, None, " ½ q"]
    text, places = Q.folded_with_places(parts)
    assert len(calls) < 30
    slow = [(fold(c), i, at) for i, part in enumerate(parts) for at, c in enumerate(part or "")]
    assert text == "".join(f for f, _, _ in slow)
    assert places == [(i, at) for f, i, at in slow for _ in f]
