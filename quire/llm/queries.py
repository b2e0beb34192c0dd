"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .cqf_dedup import exact_groups
from .host_consensus import extract_pages
from .langid import identify
from .maxplus_pieces import encode_pieces
from .minimax_shards import minimax_shards
from .ngram_jaccard import jaccard_components
from .packing import pack
from .periodic_runs import run_digests
from .quality_mcd import quality_verdicts
from .role_repair import repair_conversations
from .secret_scan import scan_secrets
from .suffix_dedup import without_repeats
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quality_verdicts(_table(spark, sf_dir, "documents"))
    return v.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("d2").alias("distance2"))


def op2_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards(_table(spark, sf_dir, "documents"))


def op3_host_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op5_maxplus_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = encode_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op6_cqf_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op7_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(_table(spark, sf_dir, "conversations"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_naive_bayes_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), docs.filter(~F.col("held_out")).select("text", "lang"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(_table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_mcd": op1_quality_mcd,
    "op2_minimax_shards": op2_minimax_shards,
    "op3_host_consensus": op3_host_consensus,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_maxplus_pieces": op5_maxplus_pieces,
    "op6_cqf_dedup": op6_cqf_dedup,
    "op7_role_repair": op7_role_repair,
    "op8_secret_scan": op8_secret_scan,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_naive_bayes_langid": op10_naive_bayes_langid,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_whitening": op12_whitening,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {"op4_ngram_jaccard": oracles.OP4, "op6_cqf_dedup": oracles.OP6, "op11_suffix_dedup": oracles.OP11, "op13_periodic_runs": oracles.OP13}
