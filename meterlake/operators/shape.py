"""Records from requests, one-to-many expansion, method dispatch, calendar and maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: JSON-RPC's code for a method or tool that does not exist: a fixed value.
NOT_FOUND = -32601


def job_records(requests: DataFrame, key: str, now: Column) -> DataFrame:
    """New jobs: an id from the request's key, queued, without progress. A rerun gives the same ids."""
    return requests.withColumns(
        {
            "job_id": F.concat(F.lit("job_"), F.upper(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 12))),
            "status": F.lit("queued"),
            "progress": F.lit(0).cast("long"),
            "created_at": now,
            "updated_at": now,
        }
    )


def cancelled(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """jobs with those in ids cancelled, from any state."""
    hit = jobs.join(ids.select("job_id", F.lit(True).alias("_hit")).distinct(), "job_id", "left")
    return hit.withColumn("status", F.when(F.col("_hit"), "cancelled").otherwise(F.col("status"))).withColumn("updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))).drop("_hit")


def shaped(rows: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """The columns of a response under its names; all others go."""
    return rows.select(*(F.col(old).alias(new) for old, new in names.items()))


def times(rows: DataFrame, n: str, index: str = "index") -> DataFrame:
    """Each row n times, numbered from 0; null counts as one, and less than one gives none."""
    count = F.coalesce(F.col(n).cast("int"), F.lit(1))
    return rows.where(count > 0).select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias(index))


def flattened(documents: DataFrame, paths: str, *keys: str) -> DataFrame:
    """A row per path and method of API descriptions (path -> method -> summary), with the keys of the description; a missing or empty summary is the path."""
    by_path = documents.select(*keys, F.explode(paths).alias("path", "methods"))
    rows = by_path.select(*keys, "path", F.explode("methods").alias("method", "summary"))
    folder = F.coalesce(F.nullif(F.element_at(F.split(F.btrim("path", F.lit("/")), "/"), 1), F.lit("")), F.lit("root"))
    return rows.select(*keys, folder.alias("folder"), "path", F.upper("method").alias("method"), F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.col("path")).alias("name"))


def with_parents(rows: DataFrame, parents: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """rows with the columns of each (parent, reference, key) in turn; a reference that is null or names none gives nulls, so no row is lost. Keys tell parents apart."""
    for parent, reference, key in parents:
        rows = rows.join(parent, F.col(reference) == F.col(key), "left")
    return rows


def dispatched(calls: DataFrame, body: str, handlers: Mapping[str, Column], tools: Mapping[str, Column]) -> DataFrame:
    """calls with id, result and error_code, for JSON-RPC text: methods by name, and tools/call by the tool's name."""
    text = lambda path: F.get_json_object(body, path)
    tool = F.lit(None).cast("string")
    for name, value in tools.items():
        tool = F.when(text("$.params.name") == name, value).otherwise(tool)
    result = F.when(text("$.method") == "tools/call", tool)
    for name, value in handlers.items():
        result = F.when(text("$.method") == name, value).otherwise(result)
    return calls.withColumns({"id": text("$.id"), "result": result}).withColumn("error_code", F.when(F.col("result").isNull(), F.lit(NOT_FOUND)))


def calendar(rows: DataFrame, date: str) -> DataFrame:
    """rows with the weekday of the month's first day (Sunday 0), the days of the month, and the first of the next."""
    first = F.trunc(date, "month")
    return rows.withColumns({"first_weekday": F.dayofweek(first) - 1, "month_days": F.dayofmonth(F.last_day(date)), "next_month": F.add_months(first, 1)})


def merged_maps(old: Column, new: Column) -> Column:
    """Both maps; where both have a key, the new value, whatever the session does with duplicate keys."""
    kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.coalesce(F.map_concat(kept, new), old, new)


def file_totals(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of files and their bytes, in all or by keys."""
    return files.groupBy(*keys).agg(F.count("*").alias("files"), F.sum("length").cast("long").alias("bytes"))
