"""Cleans a corpus and packs it: quality, repeated lines, near-duplicates, secrets, length buckets.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet in the cluster's shared folder and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wickwork.llm import cotraining, dart_minhash, fuzzy_lines, length_buckets, secret_spans
from wickwork.llm.tools import dropped, stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the co-trained classifier rejects."""
    return cotraining.accepted(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that repeat, or nearly repeat, an earlier line out of the texts; every document stays."""
    return fuzzy_lines.without_repeats(docs).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return dart_minhash.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark."""
    return secret_spans.redacted(docs, "doc_id")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each segment of each document: bucket, batch, slot."""
    return length_buckets.pack(docs, "doc_id", length_buckets.words())


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_duplicates),
    ("secret scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Trained models, signatures and dynamic programming can't be expressed in SQL; tests/llm holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            dropped(before)
        before = docs
    return docs
