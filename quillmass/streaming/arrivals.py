"""Chunks that arrive as files, mined batch by batch; and counts of events in windows of their own time.

A batch's claims go to a folder of its number, so a batch that is run again after a failure writes the same folder
again; claims of all batches are merged when they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmass.operators import inventory


def read_chunk_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Chunks in JSON lines, a bounded number of new files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def mine_stream(chunks: DataFrame, compound_class: str, out: str, checkpoint: str, subclasses: dict[str, str] | None = None) -> StreamingQuery:
    """Diagnostic fragment claims of all files there are now, one folder for each batch."""

    def write(batch: DataFrame, number: int) -> None:
        inventory.mine_diagnostics(batch, compound_class, subclasses).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_claims(spark: SparkSession, out: str) -> DataFrame:
    """The claims of all batches, those of one fragment, subclass and kind as one: evidence and sources united."""
    rows = spark.read.parquet(out)
    key = ["claim_type", "compound_class", "subclass", "fragment_mz", "diagnostic_evidence_type"]
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)  # noqa: E731 - one claim's evidence
    return rows.groupBy(*key).agg(united("evidence_ids"), united("source_files"), F.max("confidence").alias("confidence"))


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "2 hours", value: Column | None = None) -> DataFrame:
    """Counts (and the sum of ``value``) of each window and key; events later than ``late`` are left out, and old state is dropped."""
    window = F.window(time, width).alias("window")
    more = [F.sum(value).alias("total")] if value is not None else []
    found = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(window, *keys).agg(F.count("*").alias("events"), *more)
    return found.select("window.start", "window.end", *[c for c in found.columns if c != "window"])
