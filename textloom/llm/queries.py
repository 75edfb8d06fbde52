"""The query of each corpus operator, with production parameters over its whole table; SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bytebpe, cnn, decontam, fertility, secrets, simhash, slots, tokencount, transcripts, warc
from textloom.llm.common import shared_dir, table

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document."""
    return bytebpe.round_trip(table(spark, sf_dir, "documents"), BYTE_RANKS, PATTERN)


def op2_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every document by its fertility."""
    return fertility.judge(table(spark, sf_dir, "documents"), PIECE_BPE)


def op3_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts every document into shards 0 to 23 through a stored map of virtual slots, with the bytes that each slot holds
    stored beside it, and plans one shard more."""
    path = f"{shared_dir(spark)}/textloom/slot-map-{uuid.uuid4().hex}"
    slots.save_map(slots.first_map(spark, 24), path)
    slots.save_map(slots.add_shard(slots.load_map(spark, path, 1), 24), path)
    return slots.shard_rows(table(spark, sf_dir, "documents"), (slots.load_map(spark, path, 1), slots.load_map(spark, path, 2)), sizes_path=f"{path}-sizes")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts the tokens of every document."""
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), WORD_BPE, limit=2048)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds every benchmark item in every document."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds the secrets of every document."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op7_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovers the role of every entry of every conversation and renders it; roles only train the model."""
    rows = table(spark, sf_dir, "conversations")
    found = transcripts.recover_roles(rows, transcripts.train(rows))
    return found.select("conv_id", "turn", "role", "n_lines", F.sha2("rendered", 256).alias("rendered_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate components of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page to an archive and reads the archives back."""
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document by a network trained on the labelled ones that are not held out."""
    return cnn.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_fertility": op2_fertility,
    "op3_slots": op3_slots,
    "op4_token_counts": op4_token_counts,
    "op5_decontamination": op5_decontamination,
    "op6_secrets": op6_secrets,
    "op7_transcripts": op7_transcripts,
    "op8_simhash": op8_simhash,
    "op9_warc": op9_warc,
    "op10_quality_cnn": op10_quality_cnn,
}

ORACLES: dict[str, str] = {"op3_slots": slots.SQL, "op9_warc": warc.SQL}
