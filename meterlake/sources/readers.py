"""Sources: JSON requests, collections of files, constant relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.schemas import COLLECTIONS


def collection(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored collection, with its declared schema."""
    return spark.read.schema(COLLECTIONS[name]).parquet(path)


def untyped(rows: DataFrame, body: str) -> DataFrame:
    """rows with the body as a variant; null where it is no JSON."""
    return rows.withColumn("request", F.try_parse_json(body))


#: What a message of the job topic says.
MESSAGE = "job_id STRING, job_type STRING, payload STRING"


def job_topic(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Published job messages as a stream: job_id, job_type, payload; bodies that do not parse are left out."""
    lines = spark.readStream.schema("key STRING, value STRING, job_type STRING").option("maxFilesPerTrigger", files_per_batch).json(path)
    return lines.select(F.from_json("value", MESSAGE).alias("m")).where("m.job_id IS NOT NULL").select("m.*")


def inputs_of(rows: DataFrame, value: str) -> DataFrame:
    """One row per input with its index, from JSON text that is a string or a list of strings."""
    listed = F.from_json(F.when(F.ltrim(value).startswith("["), F.col(value)).otherwise(F.concat(F.lit("["), F.col(value), F.lit("]"))), "array<string>")
    return rows.select("*", F.posexplode(listed).alias("index", "input"))


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and name of uploaded files; the contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.element_at(F.split("path", "/"), -1).alias("name"))


def kept_files(path: Column, without_dirs: Sequence[str] = (), without_ends: Sequence[str] = (), without_names: Sequence[str] = ()) -> Column:
    """Whether a path has none of the excluded folders, its name none of the endings and is none of the names."""
    parts, name = F.split(path, "/"), F.element_at(F.split(path, "/"), -1)
    end = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    keep = ~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, without_dirs)).cast("array<string>"))
    return keep & ~end.isin(*without_ends, "\0") & ~name.isin(*without_names, "\0")


def tree(spark: SparkSession, folder: str, without_dirs: Sequence[str] = (), without_ends: Sequence[str] = (), without_names: Sequence[str] = ()) -> DataFrame:
    """Files below a folder, by path, without excluded folders, extensions and names."""
    return uploads(spark, folder).where(kept_files(F.col("path"), without_dirs, without_ends, without_names)).orderBy("path")


def constant(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A relation of literal rows: registries, price lists, catalogues."""
    return spark.createDataFrame(list(rows), schema)
