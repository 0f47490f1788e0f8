"""Streaming over the append-only logs: miss split, counts by event time with late rows, deduplication of resent rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.sources import files, sinks


def read_log(spark: SparkSession, path: str, schema: str = files.QA_LOG, files_per_trigger: int | None = None) -> DataFrame:
    """A log folder as a stream, with event_time from ts; malformed lines are dropped."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = files.parsed(reader.text(path), schema)
    return rows.withColumn("event_time", F.try_to_timestamp("ts"))


def once(rows: DataFrame, keys: list[str], lateness: str = "3 days") -> DataFrame:
    """Resent rows once; state older than the lateness is let go."""
    return rows.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(keys)


def misses_by_hour(rows: DataFrame, lateness: str = "3 days", width: str = "1 hour") -> DataFrame:
    """(window, product_id, n, misses) by event time."""
    counts = rows.withWatermark("event_time", lateness).groupBy(F.window("event_time", width), F.col("meta")["product_id"].alias("product_id"))
    return counts.agg(F.count("*").alias("n"), F.count_if(~F.coalesce("hit", F.lit(False))).alias("misses"))


def split_sinks(rows: DataFrame, qa_path: str, miss_path: str, checkpoint: str):
    """A query that writes each batch to the question log and its misses to the miss log, below ``batch=<id>``: a batch that is tried again replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        sinks.log_qa(batch.drop("event_time"), f"{qa_path}/batch={number}", f"{miss_path}/batch={number}", mode="overwrite")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
