"""A tree of texts as one document in many parts: ordered by path over all parts, with a manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlake.session import new_folder
from meterlake.sources.readers import kept_files

#: How a file's block names its language, by the end of its name.
FENCES = {".py": "python", ".html": "html"}
#: Unless told how many, a part holds about so many bytes of texts.
PART_BYTES = 1 << 25


def section(path: Column, text: Column) -> Column:
    """What a file adds to the bundle: its path as a heading and its text in a fenced block."""
    end = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    fence = F.lit("")
    for ending, language in FENCES.items():
        fence = F.when(end == ending, language).otherwise(fence)
    return F.concat(F.lit("### File: `"), path, F.lit("`\n\n```"), fence, F.lit("\n"), text, F.lit("\n```\n\n"))


def bundled(files: DataFrame, path: Column, text: Column, parts: int | None = None, folder: str | None = None) -> DataFrame:
    """The bundle's manifest: part, place (from 0), path, offset and bytes of every file in the whole bundle; null texts are empty, null paths first.

    Files are range-partitioned by path and hash of their text, sorted within, and each part is written by its own task, with the offsets of its
    files in the part. The sums of the parts, one row each, then turn offsets in a part into offsets in the
    bundle: no task sees more than its part, and nothing is written twice. The text of part k lies in
    folder/part=k; parts in order are the bundle (see read_back).
    """
    spark = files.sparkSession
    if parts is None:
        parts = max(1, -(-int(files.agg(F.sum(F.octet_length(text))).first()[0] or 0) // PART_BYTES))
    folder = folder or new_folder(spark, "bundle")
    rows = files.select(path.alias("path"), section(F.coalesce(path, F.lit("")), F.coalesce(text, F.lit(""))).alias("section"))
    rows = rows.withColumn("_tie", F.xxhash64("section"))
    spread = rows.repartitionByRange(parts, "path", "_tie").withColumn("part", F.spark_partition_id())
    within = spread.sortWithinPartitions("part", "path", "_tie")
    placed = within.withColumn("bytes", F.octet_length("section").cast("long")).withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed.select("part", "row", "path", "bytes", "section").write.partitionBy("part").parquet(folder)
    written = spark.read.schema("row long, path string, bytes long, section string, part int").parquet(folder)
    order = Window.partitionBy("part").orderBy("row")
    local = written.select("part", "row", "path", "bytes", (F.sum("bytes").over(order) - F.col("bytes")).alias("_offset"))
    sums = written.groupBy("part").agg(F.count("*").alias("_files"), F.sum("bytes").alias("_bytes"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("_files").over(before), F.lit(0)).alias("_row"), F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_start"))
    return local.join(F.broadcast(starts), "part").select("part", (F.col("_row") + F.col("row")).alias("place"), "path", (F.col("_start") + F.col("_offset")).alias("offset"), "bytes")


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """part, row, section of a bundle, in no order; sorted by part and row they are its text."""
    return spark.read.schema("row long, path string, bytes long, section string, part int").parquet(folder).select("part", "row", "section")


def texts_of(spark: SparkSession, folder: str, without_dirs: Sequence[str] = (), without_ends: Sequence[str] = (), without_names: Sequence[str] = ()) -> DataFrame:
    """path (from the folder on) and text of the files of a tree that readers.tree keeps; bytes that are no UTF-8 are left out, and so are empty files, which Spark does not list.

    Excluded files are not opened: what is kept is known by path before any content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    kept = files.where(kept_files(F.col("path"), without_dirs, without_ends, without_names))
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")
    return kept.select(F.substring(plain(F.col("path")), F.length(plain(F.lit(base))) + 2, F.length("path")).alias("path"), text.alias("text"))
