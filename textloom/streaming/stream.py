"""The preparation over a stream of documents: one document is one row, so every micro-batch is complete in itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.plans.prepare import prepare
from textloom.rules import RuleSet


def documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string") -> DataFrame:
    """A stream of documents from Parquet files that land in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def first_copies(stream: DataFrame, time_col: str, within: str = "1 hour") -> DataFrame:
    """Without texts that were seen before within the watermark; the state is bounded by it."""
    hashed = stream.withColumn("sha256", F.sha2("text", 256)).withWatermark(time_col, within)
    return hashed.dropDuplicatesWithinWatermark(["sha256"])


def prepare_stream(stream: DataFrame, out: str, checkpoint: str, rules: RuleSet | None = None) -> StreamingQuery:
    """Appends gates and chunks of each micro-batch below ``out``; a batch that runs again replaces its own files.

    The blocks of a batch are written once, and both are made of them."""

    def batch(df: DataFrame, number: int) -> None:
        done = prepare(df, rules, path=f"{out}/work/batch={number}")
        for name, rows in (("gates", done.gates), ("chunks", done.chunks)):
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in windows of event time; works on streams and on tables."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("window.start").alias("window_start"), "event_type", "events", "value")
