"""Sources: tables, directory inventories, text files, and the Markdown projection of plain documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources import formats as Z

#: Names of folders that no scan enters, in lower case. Fixed values.
IGNORED = (
    ".git", ".hg", ".svn", ".cache", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".venv", "venv", "env", "__pycache__", "node_modules", "dist", "build", "coverage", ".next", ".nuxt",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, size, place) of every file below a directory, but for ignored folders and for
    names that begin with a dot or an underscore, which the engine's file sources never list.

    ``place`` orders files as a walk does that takes the names of each folder without regard to case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    folders = F.split(F.lower(F.regexp_replace("path", "/[^/]*$", "")), "/")
    below = files.where(~F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED))))
    return below.select("path", "content", F.col("length").alias("size"), F.split(F.lower("path"), "/").alias("place"))


def inventory(paths: DataFrame) -> DataFrame:
    """(path, size) -> format, source type, family, weight, and whether a batch takes the file or why not."""
    ext = Z.extension(F.col("path"))
    reason = Z.skip_reason(ext)
    return paths.select(
        "path", ext.alias("ext"), Z.format_of(ext).alias("format"), Z.source_type_of(ext).alias("source_type"), Z.source_family(ext).alias("family"),
        F.when(Z.format_of(ext).isin(*Z.HEAVY), "heavy").otherwise("light").alias("weight"), "size", F.when(reason.isNull(), "process").otherwise("skip").alias("action"), reason.alias("skip_reason"),
    )


def batch_totals(inventory: DataFrame, results: DataFrame) -> DataFrame:
    """One row: what a batch found, took and left out, and how its files ended. ``results(path, ok, errors, cached)``."""
    joined = inventory.join(results, "path", "left")
    taken, good = F.col("action") == "process", F.coalesce(F.col("ok") & (F.col("errors") == 0), F.lit(False))
    count = lambda c, name: F.count_if(c).alias(name)
    return joined.agg(
        F.count("*").alias("discovered"), count(taken, "total"), count(~taken, "skipped_unsupported"), count(taken & good, "succeeded"), count(taken & good & F.coalesce("cached", F.lit(False)), "skipped"),
        count(taken & F.col("ok").isNotNull() & ~good, "failed"), count(taken & (F.col("weight") == "heavy"), "heavy"), count(taken & (F.col("weight") == "light"), "light"),
    )


#: What line i of document doc_id becomes in the Markdown projection; read by Spark and by the SQL oracles alike.
LINE_CASE = """CASE
 WHEN (doc_id * 31 + i) % 17 = 3 THEN 'Join our community and subscribe today'
 WHEN (doc_id * 31 + i) % 17 = 5 THEN concat('![shot](images/', cast(i AS string), '.png)')
 WHEN (doc_id * 31 + i) % 17 = 7 THEN concat('| a | b |', chr(10), '| --- | --- |', chr(10), '| ', cast(i AS string), ' | x |')
 WHEN (doc_id * 31 + i) % 17 = 9 THEN concat(repeat(chr(96), 3), 'python', chr(10), 'x = ', cast(i AS string), chr(10), chr(10), '# note', chr(10), repeat(chr(96), 3))
 WHEN (doc_id * 31 + i) % 17 = 11 THEN 'Copyright notice, all rights reserved'
 WHEN (doc_id * 31 + i) % 17 = 12 THEN 'Students earned 300% in a month'
 WHEN (doc_id * 31 + i) % 17 = 13 THEN concat('See https://example.org/p', cast(i AS string), ' with temperature=0.2, seed=', cast(i AS string))
 WHEN (doc_id * 31 + i) % 17 = 15 THEN 'Limited-time offer for readers'
 WHEN i % 9 = 0 THEN concat('# ', x)
 WHEN i % 9 = 3 THEN concat('### ', x)
 WHEN i % 9 = 4 THEN concat('1. ', x)
 WHEN i % 9 = 6 THEN concat('> ', x, chr(10), chr(10), '> ', x)
 ELSE x END"""
LINE_END = "CASE WHEN (doc_id + i) % 5 = 1 THEN chr(10) ELSE concat(chr(10), chr(10)) END"


def markdown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): every line of a plain document in some Markdown shape, chosen by its number and the id."""
    shaped = f"array_join(transform(split(`{text_col}`, chr(10)), (x, i) -> concat({LINE_CASE}, {LINE_END})), '')"
    return docs.select(F.col(id_col).alias("doc_id"), F.expr(shaped.replace("doc_id", f"`{id_col}`")).alias("text"))
