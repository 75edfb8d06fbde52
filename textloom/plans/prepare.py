"""The whole preparation of a corpus, as one lazy plan per result."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import blocks as B
from textloom.operators import classify as C
from textloom.operators import diagnose as D
from textloom.operators import feedback as K
from textloom.operators import pack as P
from textloom.operators import quality as Q
from textloom.operators import render as R
from textloom.operators.curate import Template, curate
from textloom.operators.normalize import normalize
from textloom.rules import RuleSet


@dataclass
class Prepared:
    """Results of a preparation; each is a DataFrame that nothing has computed yet."""

    diagnosis: DataFrame
    blocks: DataFrame
    chunks: DataFrame
    measures: DataFrame
    gates: DataFrame
    cleaned: DataFrame
    review: DataFrame
    warnings: list[str] = field(default_factory=list)


def prepare(
    docs: DataFrame, rules: RuleSet | None = None, source_type: str = "generic_block", id_col: str = "doc_id", text_col: str = "text", split_strategy: str | None = None, path: str | None = None, template: Template | None = None
) -> Prepared:
    """(doc_id, text) -> everything that is derived from it. Null texts are empty; ids must be there and unique.

    Every result stems from the blocks. With a ``path`` in shared storage they are written there once, and all results
    read that table; without one each result, when it is asked for, makes them again."""
    own = normalize(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), "text")
    blocks = C.cta_to_review(C.apply_rules(C.classify(B.with_heading_path(B.blockify(own)), rules), rules), rules)
    if template is not None:
        blocks = curate(blocks, template)
    if path is not None:
        blocks.write.mode("overwrite").parquet(f"{path}/blocks")
        blocks = docs.sparkSession.read.schema(blocks.schema).parquet(f"{path}/blocks")
    chunks, warnings = P.dispatch(blocks, source_type, split_strategy)
    measures = Q.cleanup_measures(blocks)
    gates = Q.gates(Q.with_messages(Q.cleanup_measures(blocks, P.packer_of(source_type, split_strategy)), source_type=source_type))
    diagnosis = D.text_quality(own).join(D.text_profile(own), "doc_id")
    return Prepared(diagnosis, blocks, chunks, measures, gates, R.cleaned_markdown(blocks), K.review_pack(blocks), warnings)


def skip_known(sources: DataFrame, ledger: DataFrame, version: str) -> DataFrame:
    """Sources whose content hash the ledger does not hold for this version: what a batch still has to do."""
    hashed = sources.withColumn("sha256", F.sha2(F.col("content"), 256))
    return hashed.join(ledger.where(F.col("version") == version).select("sha256").distinct(), "sha256", "left_anti")
