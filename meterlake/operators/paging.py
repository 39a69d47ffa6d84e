"""Pages by key: each page is found by the key that it begins with, so a late page costs what an early one does."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlake.session import new_folder


def paged(rows: DataFrame, keys: Sequence[str], size: int, parts: int | None = None, folder: str | None = None) -> tuple[str, DataFrame]:
    """(folder of the rows in the order of keys, table of pages): page, first (the keys of its first row), rows.

    keys together must tell rows apart; nulls come first. Rows are range-partitioned once and written in order;
    the numbers of rows of the parts, one row each, give every part its first number, so that page
    boundaries are found part by part. The table of pages has a row for size rows.
    """
    spark = rows.sparkSession
    folder = folder or new_folder(spark, "pages")
    spread = rows.repartitionByRange(*([parts] if parts else []), *keys).sortWithinPartitions(*keys)
    spread.withColumn("_part", F.spark_partition_id()).write.parquet(folder)
    stored = spark.read.parquet(folder)
    counts = stored.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    numbered = stored.select("_part", *keys).withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1)
    placed = numbered.join(F.broadcast(starts), "_part").withColumn("_at", F.col("_start") + F.col("_row"))
    pages = placed.groupBy(F.floor(F.col("_at") / size).alias("page")).agg(F.min(F.struct(*keys)).alias("first"), F.count("*").alias("rows"))
    return folder, pages


def after(keys: Sequence[str], values: Sequence[object], inclusive: bool = True) -> Column:
    """Rows at or after a key in order (nulls first), as conditions on single columns that scans can skip by."""
    out = F.lit(inclusive)
    for name, value in reversed(list(zip(keys, values))):
        column = F.col(name)
        out = (column.isNull() & out) | column.isNotNull() if value is None else (column > F.lit(value)) | ((column == F.lit(value)) & out)
    first, value = keys[0], values[0]
    return out if value is None else (F.col(first) >= F.lit(value)) & out


def page(folder: str, pages: DataFrame, keys: Sequence[str], number: int) -> DataFrame:
    """The rows of a page: read from its first key on and before the next page's; an unknown number is an empty page.

    Two rows of the table of pages come to the driver; the scan skips files and row groups before and after by their least and greatest key.
    """
    spark = pages.sparkSession
    stored = spark.read.parquet(folder).drop("_part")
    found = {r.page: r["first"] for r in pages.where(F.col("page").isin(number, number + 1)).collect()}
    if number not in found:
        return stored.where("false")
    rows = stored.where(after(keys, list(found[number])))
    if number + 1 not in found:
        return rows
    last = list(found[number + 1])
    rows = rows.where(~F.coalesce(after(keys, last), F.lit(False)))
    return rows if last[0] is None else rows.where(F.col(keys[0]).isNull() | (F.col(keys[0]) <= F.lit(last[0])))


def following(rows: DataFrame, keys: Sequence[str], last: Sequence[object] | None, size: int) -> DataFrame:
    """The next size rows after the last one seen, whose keys are given (None: from the beginning): a filter and a top of size rows, never an offset."""
    rest = rows if last is None else rows.where(after(keys, last, inclusive=False))
    return rest.orderBy(*keys).limit(size)
