"""Publication of export bundles: written whole, then shown by one marker."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "bundle_id string, path string, sha256 string, size_bytes long, batch string"


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _store(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def published_batches(spark: SparkSession, root: str) -> list[str]:
    """Names of the batches that have a marker, in order."""
    folder, store = _path(spark, root, "published"), _store(spark, root)
    return sorted(f.getPath().getName() for f in store.listStatus(folder)) if store.exists(folder) else []


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """(bundle_id, path, sha256, size_bytes, batch) of the files of all published bundles."""
    batches = published_batches(spark, root)
    if not batches:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(*[f"{root}/batches/{b}/manifests" for b in batches])


def read_bundles(spark: SparkSession, root: str) -> DataFrame:
    """(bundle_id, path, content) of all published bundles; what a broken write left is not seen."""
    batches = published_batches(spark, root)
    if not batches:
        return spark.createDataFrame([], "path string, content binary, bundle_id string")
    parts = [spark.read.schema("path string, content binary, bundle_id string").parquet(f"{root}/batches/{b}/files") for b in batches]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def broken_files(spark: SparkSession, root: str) -> DataFrame:
    """(bundle_id, path) of published files that are missing, not in the manifest, or differ from it."""
    now = read_bundles(spark, root).select("bundle_id", "path", F.sha2("content", 256).alias("now"))
    both = read_manifests(spark, root).select("bundle_id", "path", "sha256").join(now, ["bundle_id", "path"], "full")
    return both.filter(~F.col("sha256").eqNullSafe(F.col("now"))).select("bundle_id", "path")


def publish_bundles(files: DataFrame, root: str, batch: str | None = None) -> str | None:
    """Publish the bundles of ``files`` (bundle_id, path, content) under ``root`` and give the batch's name.

    Files are written first, the manifests from what was written last, and then a marker, one empty file, makes
    the batch visible: readers see all of its bundles or none. A write that breaks leaves no marker; its
    folder is written anew when the same batch is tried again, and ``clean_up`` drops it otherwise. Bundles do not
    change: those that are published already are left out, so a batch that is replayed adds nothing. Of files with one
    path in a bundle one stays. Without a bundle to publish there is no batch, and None is given.
    """
    spark = files.sparkSession
    root = root.rstrip("/")
    batch = batch or uuid.uuid4().hex
    if batch in published_batches(spark, root):
        return batch
    known = read_manifests(spark, root).select("bundle_id").distinct()
    new = files.select(F.col("bundle_id").cast("string").alias("bundle_id"), "path", F.col("content").cast("binary").alias("content"))
    new = new.filter("bundle_id is not null and path is not null").join(known, "bundle_id", "left_anti").dropDuplicates(["bundle_id", "path"])
    at = f"{root}/batches/{batch}"
    new.repartition("bundle_id").write.mode("overwrite").partitionBy("bundle_id").parquet(f"{at}/files")
    store = _store(spark, root)
    if not any(f.getPath().getName().startswith("bundle_id=") for f in store.listStatus(_path(spark, at, "files"))):
        store.delete(_path(spark, at), True)
        return None
    written = spark.read.schema("path string, content binary, bundle_id string").parquet(f"{at}/files")
    rows = written.select("bundle_id", "path", F.sha2("content", 256).alias("sha256"), F.octet_length(F.coalesce("content", F.lit(b""))).cast("long").alias("size_bytes"), F.lit(batch).alias("batch"))
    rows.write.mode("overwrite").parquet(f"{at}/manifests")
    store.create(_path(spark, root, "published", batch), False).close()
    return batch


def clean_up(spark: SparkSession, root: str) -> list[str]:
    """Delete the batches without a marker, when no write is under way, and give their names."""
    folder, store = _path(spark, root, "batches"), _store(spark, root)
    seen = set(published_batches(spark, root))
    left = [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []
    for name in left:
        if name not in seen:
            store.delete(_path(spark, root, "batches", name), True)
    return sorted(set(left) - seen)
