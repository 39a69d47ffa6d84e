"""Structured Streaming forms of the time-windowed parts: rates, idempotent intake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: States from which a job moves no more.
FINAL = ("completed", "failed", "cancelled", "expired")


def events(spark: SparkSession, folder: str, schema: str, time: str = "ts", files_per_batch: int = 8) -> DataFrame:
    """A stream of parquet files; the time, which files hold without a zone, is read as UTC."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn(time, F.col(time).cast("timestamp"))


def windowed_rate(rows: DataFrame, time: str, late: str, width: str, *keys: str, tokens: F.Column | None = None) -> DataFrame:
    """Requests, and tokens if told how many a request has, per key and window; state is dropped once a window is older than late."""
    sums = [F.count("*").alias("requests")] + ([] if tokens is None else [F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("tokens")])
    counted = rows.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(*sums)
    return counted.select(F.col("w.start").alias("window_start"), *keys, *counted.columns[1 + len(keys) :])


def finished(messages: DataFrame, url_of: F.Column) -> DataFrame:
    """The records that a worker leaves for job messages: job_id, status, result_urls."""
    return messages.select("job_id", F.lit("completed").alias("status"), F.array(url_of).alias("result_urls"))


def once(rows: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each idempotency key once, as long as repeats come within late."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
