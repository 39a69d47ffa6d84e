"""Files as a stream, and what a stream has given once its input is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterlake.session import new_folder


def stream_of(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream over the files of a folder, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def appended(out: DataFrame, folder: str | None = None) -> DataFrame:
    """All rows that a stream appends until its input is read. folder holds its state and rows; given again, the stream goes on from there."""
    spark = out.sparkSession
    folder = folder or new_folder(spark, "stream")
    sink = out.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    sink.outputMode("append").format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")
