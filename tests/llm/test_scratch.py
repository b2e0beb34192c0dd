"""Scratch tables belong to the call that wrote them."""

import threading

import pytest
from pyspark.sql import functions as F


def exists(spark, df):
    try:
        return df.count() >= 0
    except Exception:
        return False


def test_threads_keep_their_tables(spark):
    from quire.llm.common import scratch_of, written

    inside, leave, out = threading.Event(), threading.Event(), {}

    def other():
        with scratch_of(spark):
            out["mine"] = written(spark.range(5).toDF("a"), "mine")
            inside.set()
            leave.wait(60)
            out["rows"] = out["mine"].count()

    t = threading.Thread(target=other)
    t.start()
    inside.wait(60)
    with scratch_of(spark):
        gone = written(spark.range(3).toDF("a"), "gone")
    leave.set()
    t.join()
    assert out["rows"] == 5 and not exists(spark, gone) and not exists(spark, out["mine"])


def test_failure_and_kept_tables(spark):
    from quire.llm.common import scratch_of, written

    tables = []
    with pytest.raises(ZeroDivisionError), scratch_of(spark, keep=1):
        tables.append(written(spark.range(3).toDF("a"), "failed"))
        1 / 0
    with scratch_of(spark):
        with scratch_of(spark, keep=1):
            tables += [written(spark.range(3).toDF("a"), "gone"), written(spark.range(4).toDF("a"), "kept")]
        assert not exists(spark, tables[1]) and tables[2].count() == 4
    assert not any(exists(spark, t) for t in tables)


def test_operators_in_two_threads(spark, sf):
    from quire.llm.queries import QUERIES

    docs, out = {}, {}

    def run(name):
        out[name] = QUERIES[name](spark, sf).agg(F.count("*")).first()[0]

    threads = [threading.Thread(target=run, args=(n,)) for n in ("op4_ngram_jaccard", "op6_cqf_dedup")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert out == {"op4_ngram_jaccard": docs, "op6_cqf_dedup": docs}


def test_broadcast_by_bytes(spark):
    from quire.llm.common import small, written

    narrow = small(written(spark.range(1000).toDF("a"), "narrow"))
    wide = small(written(spark.range(40).select(F.repeat(F.lit("x"), 1 << 20).alias("s")), "wide"))
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(narrow) and not hinted(wide)
