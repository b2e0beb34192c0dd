"""Shared helpers: scratch tables in the cluster's shared folder and column idioms."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from ..functions.scratch import scratch_dir

#: ASCII white space as a Java regular expression class body: \x20 and \x09-\x0D.
WS = r" \t\n\x0B\f\r"
#: Paths of the scratch tables that the innermost ``scratch_of`` of this thread holds.
_HELD: ContextVar[list[str] | None] = ContextVar("held", default=None)
#: Most rows and bytes of a table that is broadcast by hint.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again.

    Unlike a cached block, the files outlive any executor. Within ``scratch_of`` they are deleted at
    its end.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"
    held = _HELD.get()
    if held is not None:
        held.append(path)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a scratch table, after its last reader has run."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_of(spark: SparkSession, *, keep: int = 0) -> Iterator[None]:
    """Delete at the end, also of a failure, all tables that ``written`` made within by this thread, but for the last
    ``keep`` of them if nothing failed; these are then held by the caller's ``scratch_of``, if there is one.
    Everything that reads the others must have run by then."""
    outer, own = _HELD.get(), []
    token = _HELD.set(own)
    kept: list[str] = []
    try:
        yield
        kept = own[len(own) - keep :] if keep else []
    finally:
        _HELD.reset(token)
        for path in own[: len(own) - len(kept)]:
            deleted(spark, path)
        if outer is not None:
            outer += kept


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table, with a broadcast hint if it has few rows and bytes; else Spark chooses the join."""
    rows = df.count()
    if rows > BROADCAST_ROWS:
        return df
    if all(isinstance(f.dataType, NumericType | BooleanType) for f in df.schema):
        size = 8 * len(df.columns) * rows
    else:
        size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def fresh(columns: list[str], name: str) -> str:
    """``name`` with as many underscores behind it as make it differ from all ``columns``."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def without_rows(docs: DataFrame, gone: DataFrame, again: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id and text hash are not in ``gone``; of those in ``again`` one row each.

    Both are narrow tables (doc_id, text_hash), unique and apart; whole texts move only where one
    of them is too large to broadcast.
    """
    i, h, n = (fresh(docs.columns, x) for x in ("gone_id", "gone_hash", "gone_number"))
    named = lambda df: small(df.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)))
    key = docs["doc_id"].eqNullSafe(F.col(i)) & (F.xxhash64(docs["text"]) == F.col(h))
    left = docs.join(named(gone), key, "left_anti")
    if again.isEmpty():
        return left
    twice = named(again)
    number = F.row_number().over(Window.partitionBy(i, h).orderBy(h))
    once = left.join(twice, key).withColumn(n, number).filter(F.col(n) == 1).select([left[c] for c in docs.columns])
    return left.join(twice, key, "left_anti").unionByName(once)


def slices(batch: pa.RecordBatch, size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in their order, cut where the bytes of ``text`` pass a multiple of ``size``: what a worker
    makes of the texts at once is bounded by that and the longest text, not by the rows of a batch."""
    at = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype("int64")) // size
    edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def map_ids(df: DataFrame, run: Callable, columns: str, *ids: str, arrow: bool = False) -> DataFrame:
    """``mapInPandas`` (``mapInArrow`` if ``arrow``) that carries the columns ``ids`` (doc_id if none is named) as text and gives them
    their type back: pandas would make floats of whole numbers beside a null. ``columns`` is the schema of the others, which come after the ids."""
    ids = ids or ("doc_id",)
    kinds = {c: df.schema[c].dataType for c in ids}
    text = df.select([F.col(c).cast("string").alias(c) if c in kinds else F.col(c) for c in df.columns])
    out = (text.mapInArrow if arrow else text.mapInPandas)(run, ", ".join([*(f"{c} string" for c in ids), columns]))
    return out.select([F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in out.columns])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is evaluated once a row, also where nested lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """White-space separated words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{WS}]+"), "")


def crc32_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: str) -> DataFrame:
    """Left join of ``left`` with the unique keys of ``right``, whose column ``rows`` says how many
    rows of ``left`` have the key.

    Keys of a thousandth of all rows or more, of which there are a thousand at most, are broadcast;
    rows that met one of them are dealt by a key of their own and not to the task of the hot key.
    """
    bar = max(1000, -(-left.count() // 1000))
    names = [c for c in right.columns if c != key]
    renamed = lambda df, p: df.select(F.col(key).alias(f"_{p}key"), *[F.col(c).alias(f"_{p}{c}") for c in names])
    hot, rest = renamed(right.filter(F.col(rows) >= bar), "h"), renamed(right.filter(F.col(rows) < bar), "c")
    met = left.join(F.broadcast(hot), F.col(key) == F.col("_hkey"), "left")
    own = F.when(F.col("_hkey").isNull(), F.struct(F.col(key).alias("k"), F.lit(0).cast("long").alias("s"))).otherwise(F.struct(F.lit(None).cast(left.schema[key].dataType).alias("k"), F.monotonically_increasing_id().alias("s")))
    out = met.withColumn("_own", own).join(rest.withColumn("_own", F.struct(F.col("_ckey").alias("k"), F.lit(0).cast("long").alias("s"))), "_own", "left")
    return out.select(*[left[c] for c in left.columns], *[F.coalesce(f"_h{c}", f"_c{c}").alias(c) for c in names])
