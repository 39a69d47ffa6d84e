"""Reading tables and cutting lineage, for every operator of the subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterlake.session import new_folder

#: Words, as the contracts define them, in Java, RE2 and Python syntax alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again, so that a lost executor costs no recomputation."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
