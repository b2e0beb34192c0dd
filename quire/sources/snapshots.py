"""Snapshots of the latest row of each key, in parts by a hash of the key, merged part by part."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.structure import carry_block_ids

#: Parts of a snapshot; a batch reads and writes those that its keys fall into.
PARTS = 64


def _part(keys: list[str], parts: int) -> F.Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a snapshot, or None before its first batch."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(f"{path}/rows")


def merge_snapshot(path: str, batch: DataFrame, keys: list[str], order: str, parts: int = PARTS) -> list[int]:
    """Merge ``batch`` into the snapshot at ``path``: of each key the row of greatest ``order`` stays, of ties one of the
    batch. Gives the parts that were written.

    Only the parts of the batch's keys are read, merged and overwritten, all in one job. A job that breaks between two
    parts leaves some merged; as the merge of a batch twice is that of it once, the replay mends it. Keys may be null.
    """
    spark = batch.sparkSession
    new = batch.withColumn("_new", F.lit(1)).withColumn("part", _part(keys, parts))
    touched = sorted(r[0] for r in new.select("part").distinct().collect())  # at most ``parts`` numbers
    if not touched:
        return []
    old = read_snapshot(spark, path)
    rows = new if old is None else new.unionByName(old.filter(F.col("part").isin(touched)).withColumn("_new", F.lit(0)), allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in (*keys, "part", "_new")]
    best = F.max_by(F.struct(*rest), F.struct(F.col(order), F.col("_new")))
    merged = rows.groupBy(*keys, "part").agg(best.alias("_row")).select(*keys, "_row.*", "part")
    merged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/rows")
    return touched


def stream_snapshot(changes: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, parts: int = PARTS, log: Callable[[int, list[int]], None] | None = None) -> StreamingQuery:
    """Merge each micro-batch of ``changes`` into the snapshot at ``path``; ``log`` gets its number and the parts that it wrote."""

    def merge(batch: DataFrame, number: int) -> None:
        written = merge_snapshot(path, batch, keys, order, parts)
        if log:
            log(number, written)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replace_extraction(current: DataFrame, new: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """The latest extraction of each version (version_id, page_index, p, text, block_id and more).

    Versions in ``new`` replace theirs as a whole. Blocks whose page and text were there before keep their id: the k-th
    of equal ones that of the k-th. A version whose latest run (``runs``: version_id, status) failed has no blocks,
    whatever ``new`` holds of it.
    """
    failed = None if runs is None else runs.filter("status = 'FAILED'").select("version_id").distinct()
    fresh = new if failed is None else new.join(failed, "version_id", "left_anti")
    ids = carry_block_ids(current, fresh.drop("block_id")).select("version_id", "p", "block_id")
    touched = new.select("version_id") if failed is None else new.select("version_id").unionByName(failed)
    kept = current.join(touched.distinct(), "version_id", "left_anti")
    return kept.unionByName(fresh.drop("block_id").join(ids, ["version_id", "p"]), allowMissingColumns=True)
