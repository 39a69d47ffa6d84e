"""Keyed tables that are stored in buckets, sorted by key, so that updates join without moving them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def create(rows: DataFrame, name: str, key: str, buckets: int) -> None:
    """Stores rows as a table of that many buckets of the key; keys must be told apart by it. Choose buckets so that one fits a task."""
    rows.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).option("compression", "zstd").saveAsTable(name)


def latest(changes: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """One change per key: the one of the greatest version, or, without versions, of the greatest columns in turn."""
    if version:
        order = [F.col(version).desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in changes.columns if c not in (key, version))]
    else:
        order = [F.col(c).desc_nulls_last() for c in changes.columns if c != key]
    return changes.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def updated(spark: SparkSession, name: str, changes: DataFrame, key: str, version: str | None = None, insert: bool = True, deleted: str | None = None) -> DataFrame:
    """The table's rows with changes: fields that a change gives are set, null fields stay; unknown keys are inserted if wanted; a true deleted field takes the row away.

    changes, of which the latest per key counts, go to the table's buckets, once; the table itself is neither shuffled nor sorted,
    and comes out in its buckets. Null keys of changes are left out.
    """
    table = spark.table(name)
    news = latest(changes.where(F.col(key).isNotNull()), key, version).withColumns({"_hit": F.lit(True)})
    fields = [c for c in news.columns if c in table.columns and c != key]
    told = news.select(F.col(key).alias("_key"), "_hit", *(F.col(c).alias(f"_new_{c}") for c in fields), *([F.col(deleted).alias("_gone")] if deleted else []))
    joined = table.join(told.hint("shuffle_merge"), table[key] == F.col("_key"), "full" if insert else "left")
    if deleted:
        joined = joined.where(~F.coalesce("_gone", F.lit(False)))
    value = lambda c: F.coalesce(F.col(f"_new_{c}"), table[c]) if c in fields else F.coalesce(table[c], F.col("_key")) if c == key else table[c]
    return joined.select(*(value(c).alias(c) for c in table.columns))


def update_by(table: DataFrame, changes: DataFrame, on: str, key: str, fields: Sequence[str]) -> DataFrame:
    """table with fields set where changes name a row by on, a column that is not its key, such as an email.

    The first row of each value of on, by key, is the one that is meant, as a lookup would find it; changes
    of values that no row has change nothing. Of several changes of a value the greatest counts.
    """
    first = table.where(F.col(on).isNotNull()).groupBy(on).agg(F.min(key).alias("_key"))
    news = changes.where(F.col(on).isNotNull()).groupBy(on).agg(F.max(F.struct(*fields)).alias("_new"))
    found = first.join(news, on).select("_key", "_new")
    joined = table.join(found, table[key] == F.col("_key"), "left")
    return joined.select(*(F.coalesce(F.col(f"_new.{c}"), table[c]).alias(c) if c in fields else table[c] for c in table.columns))
