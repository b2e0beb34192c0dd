"""Corpus pipeline: quality rules, exact dedup, n-gram Jaccard join, secret scans, best-fit packing."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import deleted, scratch_dir, scratch_of
from quire.llm.cqf_dedup import without_copies
from quire.llm.ngram_jaccard import one_of_each
from quire.llm.packing import pack
from quire.llm.quality_mcd import keep_good
from quire.llm.secret_scan import mask_secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    Null, empty and very short texts go; repeated rows stay or go together.
    """
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space.

    Null and empty texts are one group; the longest text, then the least doc_id stays, and one of repeated rows.
    """
    return without_copies(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle similarity of 0.8 or more.

    That of the least doc_id stays; texts without words stay; a null doc_id comes last.
    """
    return one_of_each(docs, k=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked; null and empty texts as they are."""
    return mask_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 1024 tokens; null and empty texts are the end id alone."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again by the next.

    The scratch tables of a stage, and what it read from the one before, go when it is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch_of(spark):
            path = f"{scratch_dir(spark)}/quire/pipeline-{k}-{uuid.uuid4().hex}"
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            deleted(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
