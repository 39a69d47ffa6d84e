"""Document-store operations as functions from DataFrame to DataFrame.

Parquet tables cannot be updated in place, so a mutation returns the table's new rows; the caller
writes them to a new path or version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exclude(table: DataFrame, *secret: str) -> DataFrame:
    """Every column but the secret ones."""
    return table.drop(*secret)


def find_eq(table: DataFrame, **values: object) -> DataFrame:
    """Rows that equal all given values; pushed down to the scan."""
    for column, value in values.items():
        table = table.where(F.col(column) == F.lit(value))
    return table


def find_one(table: DataFrame, order: Sequence[str] = (), **values: object) -> DataFrame:
    """The first matching row in the given order, or none."""
    found = find_eq(table, **values)
    return (found.orderBy(*order) if order else found).limit(1)


def recent(table: DataFrame, time: str, key: str, n: int = 100) -> DataFrame:
    """The n newest rows; rows of equal time by key, so that the result is defined."""
    return table.orderBy(F.col(time).desc_nulls_last(), F.col(key)).limit(n)


def page(table: DataFrame, order: Sequence[Column], number: int, size: int = 25) -> DataFrame:
    """Page number (from 0) of the given size."""
    return table.orderBy(*order).offset(number * size).limit(size)


def first_match(table: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of every key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return table.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def set_fields(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """table with the non-null fields of updates set, by key. Keys that table lacks are not inserted; updates must have each key once."""
    fields = [c for c in updates.columns if c != key]
    news = updates.select(key, *(F.col(c).alias(f"_new_{c}") for c in fields))
    joined = table.join(news, key, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns))


def upsert(table: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of both; where both have a key, the incoming row; of several incoming rows of a key, the last by their columns in turn."""
    both = table.withColumn("_age", F.lit(1)).unionByName(incoming.withColumn("_age", F.lit(0)))
    return first_match(both, [key], ["_age", *(F.col(c).desc() for c in table.columns if not c == key and dict(table.dtypes)[c][:3] != "map")]).drop("_age")


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """table without the given keys."""
    return table.join(keys.select(key), key, "left_anti")


#: Limits of a key whose request names none: fixed values of the key store.
DEFAULT_LIMITS = {"rpm_limit": 60, "tpm_limit": 100_000, "concurrency_limit": 5}


def _kept(table: DataFrame, column: str) -> Column:
    """A column of the table, or nulls where it has none yet."""
    return F.col(column) if column in table.columns else F.lit(None).cast("string")


def approve(requests: DataFrame, request_id: str, secret: str, now: Column | None = None, key_prefix: str = "key_", text_prefix: str = "mk_") -> tuple[DataFrame, DataFrame]:
    """(new keys, requests with approved_key_id set), for every request still pending; what was decided before stays.

    A key's text comes from the secret and the request's id, so that a rerun gives the same one and none can
    guess it who does not know the secret; a request without an id gets null. It is stored as a prefix and a hash, and key_id is part of a hash of that hash. A key takes the request's tenant, if it has one, and limits, or DEFAULT_LIMITS.
    """
    if not secret:
        raise ValueError("keys need a secret")
    made = F.sha2(F.concat(F.lit(f"{secret}:"), F.col(request_id).cast("string")), 256)
    plain, pending = F.concat(F.lit(text_prefix), made), F.col("status") == "pending_approval"
    hashed = F.sha2(plain, 256)
    key = F.concat(F.lit(key_prefix), F.substring(F.sha2(hashed, 256), 1, 10))
    limits = [(F.coalesce(F.col(c), F.lit(n)) if c in requests.columns else F.lit(n)).cast("long").alias(c) for c, n in DEFAULT_LIMITS.items()]
    keys = requests.where(pending).select(
        key.alias("key_id"), F.col(request_id), _kept(requests, "tenant_id").alias("tenant_id"), F.concat(F.substring(plain, 1, 12), F.lit("...")).alias("prefix"),
        hashed.alias("hashed_key"), *limits, F.lit("enabled").alias("status"), (F.current_timestamp() if now is None else now).alias("created_at"),
    )
    done = _stamped(requests, pending, now).withColumns({"approved_key_id": F.when(pending, key).otherwise(_kept(requests, "approved_key_id")), "status": F.when(pending, "approved").otherwise(F.col("status"))})
    return keys, done


def reject(requests: DataFrame, refused: DataFrame, request_id: str, now: Column | None = None) -> DataFrame:
    """requests with status rejected and the reason, where refused (id, rejection_reason; one row per id) has them; other reasons stay."""
    news = refused.groupBy(request_id).agg(F.max("rejection_reason").alias("_reason"), F.lit(True).alias("_hit"))
    joined = requests.join(news, request_id, "left")
    hit = F.coalesce("_hit", F.lit(False))
    told = joined.withColumns({"status": F.when(hit, "rejected").otherwise(F.col("status")), "rejection_reason": F.when(hit, F.col("_reason")).otherwise(_kept(requests, "rejection_reason"))})
    return _stamped(told, hit, now).drop("_reason", "_hit")


def _stamped(requests: DataFrame, changed: Column, now: Column | None) -> DataFrame:
    """requests with updated_at set to now where they changed; without now or such a column, as they are."""
    if now is None and "updated_at" not in requests.columns:
        return requests
    time = F.current_timestamp() if now is None else now
    old = F.col("updated_at") if "updated_at" in requests.columns else F.lit(None).cast("timestamp")
    return requests.withColumn("updated_at", F.when(changed, time).otherwise(old))
