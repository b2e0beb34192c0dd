"""Exact dedup: counting quotient filters built per partition, merged by sorted remainders.

Each partition keeps the fingerprints of its documents in a counting quotient filter: a fingerprint
is split into a quotient (its run) and a remainder, and a run holds its sorted remainders with
counts. Filters are kept as their sorted runs, three arrays of quotients, remainders and counts, without
slots or run bits, and those of different partitions merge run by run like sorted lists and lose nothing.
Fingerprints whose merged count is above one may be copies: only their documents go on to the
verification, which compares the bytes of the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, small, spread_join, without_rows, written

#: Fingerprints have QUOTIENT_BITS + REMAINDER_BITS bits; runs travel in blocks of neighbouring quotients, which are
#: as many as hold BLOCK_ROWS fingerprints each on average, between 2 ** 6 and 2 ** QUOTIENT_BITS.
QUOTIENT_BITS, REMAINDER_BITS, BLOCK_ROWS = 20, 32, 1 << 16
#: A block of one filter; remainders are sorted within each quotient's run.
FILTER = "block int, quotients binary, remainders binary, counts binary"


def _filter_rows(quotients: np.ndarray, remainders: np.ndarray, counts: np.ndarray, bits: int) -> pd.DataFrame:
    """Rows of FILTER, of 2 ** bits blocks, from sorted runs."""
    blocks = quotients >> (QUOTIENT_BITS - bits)
    edges = np.flatnonzero(np.diff(blocks, prepend=-1, append=1 << bits))
    parts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pd.DataFrame({"block": [int(blocks[p.start]) for p in parts], "quotients": [quotients[p].astype("<u4").tobytes() for p in parts], "remainders": [remainders[p].astype("<u4").tobytes() for p in parts], "counts": [counts[p].astype("<i8").tobytes() for p in parts]})


def merged_runs(quotients: np.ndarray, remainders: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in order of quotient and remainder, equal remainders with their counts added."""
    if not len(quotients):
        return quotients, remainders, counts
    order = np.lexsort((remainders, quotients))
    quotients, remainders, counts = quotients[order], remainders[order], counts[order]
    first = np.flatnonzero(np.r_[True, (quotients[1:] != quotients[:-1]) | (remainders[1:] != remainders[:-1])])
    return quotients[first], remainders[first], np.add.reduceat(counts, first)


def _build(bits: int) -> Callable:
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The filter of one partition, sent on whenever it holds a million fingerprints."""
        empty = np.empty(0, np.int64)
        held = (empty, empty, empty)
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64)
            new = (fp >> REMAINDER_BITS, fp & ((1 << REMAINDER_BITS) - 1), np.ones(len(fp), np.int64))
            held = merged_runs(*(np.concatenate(x) for x in zip(held, new, strict=True)))
            if len(held[0]) > 1 << 20:
                yield _filter_rows(*held, bits)
                held = (empty, empty, empty)
        if len(held[0]):
            yield _filter_rows(*held, bits)

    return build


def _merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    read = lambda c, kind: np.frombuffer(b"".join(rows[c]), kind).astype(np.int64)
    q, r, n = merged_runs(read("quotients", "<u4"), read("remainders", "<u4"), read("counts", "<i8"))
    again = n > 1
    return pd.DataFrame({"fp": (q[again] << REMAINDER_BITS) | r[again], "n": n[again]})


def repeated_fingerprints(rows: DataFrame) -> DataFrame:
    """fp and its count n over all partitions of ``rows`` (column fp), a written table, for counts above one.

    A block holds an even share of the distinct fingerprints, copies counted, not kept.
    """
    bits = min(QUOTIENT_BITS, max(6, (rows.count() // BLOCK_ROWS).bit_length()))
    return rows.select("fp").mapInPandas(_build(bits), FILTER).groupBy("block").applyInPandas(_merge, "fp long, n long")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}]+", "")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of ``docs`` (doc_id, text).

    Texts are equal when their bytes are after white space is deleted. The row with the most code
    points, then the smallest doc_id, stays. Null texts count as empty and are copies of each
    other. A null doc_id loses ties. Of repeated rows that all could stay one does; ids may be of any type that has an order. An empty table
    gives no rows; other columns are not looked at.
    """
    return _groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _groups(docs: DataFrame) -> DataFrame:
    norm = normalised(F.col("text"))
    sha = F.sha2(norm.cast("binary"), 256)
    fp = F.conv(F.substring(sha, 1, (QUOTIENT_BITS + REMAINDER_BITS) // 4), 16, 10).cast("long")
    # numbered as they are written; all later reads see the same numbers
    rows = written(docs.select(F.monotonically_increasing_id().alias("at"), "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("len"), sha.alias("sha"), F.xxhash64("text").alias("text_hash")).withColumn("fp", F.conv(F.substring("sha", 1, (QUOTIENT_BITS + REMAINDER_BITS) // 4), 16, 10).cast("long")), "dedup-rows")
    repeated = written(repeated_fingerprints(rows), "dedup-repeated")
    texts = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("len"), norm.alias("norm"), fp.alias("fp"))
    best = F.min_by("doc_id", F.struct((-F.col("len")).alias("len"), F.col("doc_id").isNull().alias("none"), "doc_id"))
    checked = texts.join(repeated.select("fp"), "fp", "left_semi").groupBy("fp", "norm").agg(F.count("*").alias("n"), best.alias("best"), F.max("len").alias("best_len"))
    classes = written(checked.filter("n > 1").select(F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "n", "best", "best_len"), "dedup-classes")
    joined = spread_join(rows, classes, "sha", "n")
    single = F.col("n").isNull()
    could = single | (F.col("best").eqNullSafe(F.col("doc_id")) & (F.col("best_len") == F.col("len")))
    out = joined.select("at", "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("best")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), could.alias("could"), F.col("sha").alias("text_sha256"), "text_hash")
    # equal doc_id and text: one of the rows stays
    twice = out.filter("could and group_size > 1").groupBy("doc_id", "text_sha256").agg(F.min("at").alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    i, h = F.col("of_id"), F.col("of_sha")
    twice = small(written(twice.select(F.col("doc_id").alias("of_id"), F.col("text_sha256").alias("of_sha"), "first"), "dedup-twice"))
    again = out.join(twice, out["doc_id"].eqNullSafe(i) & (out["text_sha256"] == h), "left")
    return again.withColumn("kept", F.col("could") & (F.col("first").isNull() | (F.col("first") == F.col("at")))).drop("of_id", "of_sha", "first", "at")


def without_copies(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) that stay, with all their columns; of wholly repeated rows one stays.

    Null and empty texts, and texts of white space alone, are copies of each other. A null doc_id
    loses ties. Rows that go are known by doc_id and a hash of their text, so the texts meet a
    narrow table. Extra columns may have any names. An empty table gives none.
    """
    marks = _groups(docs).groupBy("doc_id", "text_hash").agg(F.bool_or("kept").alias("kept"), F.count_if(~F.col("kept")).alias("others"))
    marks = written(marks.filter("not kept or others > 0"), "dedup-marks")
    return without_rows(docs, marks.filter("not kept"), marks.filter("kept"))
