"""The corpus pipeline: quality classifier, near-duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bytebpe, cnn, decontam, secrets, simhash, simhash_wide
from textloom.llm.common import discard, release, table, tables_made, written
from textloom.llm.queries import BYTE_RANKS, PATTERN


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network rejects go."""
    return cnn.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word similarity 0.8 or more stays, that of the smallest id."""
    return simhash.keep_first(docs, groups=simhash_wide.similar)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text. Every document stays."""
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's number of tokens, with hashes of its ids and of what they decode to."""
    return bytebpe.round_trip(docs, BYTE_RANKS, PATTERN)


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE", byte_bpe),
]

#: SQL cannot train a network or encode text; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other. What a stage has written beside its result goes when the result stands."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        standing = tables_made()
        result = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, standing, result)
        discard(docs)
        docs = result
    return docs
