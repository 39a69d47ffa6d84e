"""Request bodies typed and checked in one pass; rejects go to a dead-letter table with their reasons."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from meterlake.session import new_folder

#: The reason of a body that is no JSON object of the schema; no other check is made then.
MALFORMED = "malformed"


def typed(rows: DataFrame, body: str, schema: str, checks: Mapping[str, Column], required: tuple[str, ...] = ()) -> DataFrame:
    """rows with request, the typed body, and reasons, why it is not accepted: an empty array if it is.

    checks are conditions on request by the reason that it gives if one does not hold; a condition that is
    null, as of a field that is not given, holds. required fields give 'missing <field>' where they are null. A null body,
    or one that does not fit the schema, is malformed and nothing else.
    """
    parsed = rows.withColumn("request", F.from_json(body, f"{schema}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.coalesce(F.col("request").isNull() | F.col("request._corrupt").isNotNull() | ~F.ltrim(body).startswith("{"), F.lit(True))
    parsed = parsed.withColumn("request", F.when(~bad, F.col("request").dropFields("_corrupt")))
    found = [F.when(F.col("request")[c].isNull(), F.lit(f"missing {c}")) for c in required] + [F.when(~ok, F.lit(reason)) for reason, ok in checks.items()]
    reasons = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return parsed.withColumn("reasons", F.when(F.col("request").isNull(), F.array(F.lit(MALFORMED))).otherwise(reasons))


def routed(rows: DataFrame, body: str, schema: str, checks: Mapping[str, Column], required: tuple[str, ...] = (), folder: str | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(accepted rows with request, rejected rows with body and reasons, counts), by one scan of rows.

    What typed gives is written once, in a folder for each outcome, and the counts (requests, accepted,
    malformed) are observed on the way. A reader of one outcome reads only its folder.
    """
    spark = rows.sparkSession
    folder = folder or new_folder(spark, "intake")
    told = typed(rows, body, schema, checks, required).withColumn("accepted", F.size("reasons") == 0)
    watch = Observation()
    told = told.observe(watch, F.count("*").alias("requests"), F.count_if("accepted").alias("accepted"), F.count_if(F.array_contains("reasons", MALFORMED)).alias("malformed"))
    told.write.partitionBy("accepted").mode("overwrite").parquet(folder)
    kinds = told.drop("accepted").schema
    one = lambda way: spark.read.schema(kinds).parquet(f"{folder}/accepted={way}") if watch.get["requests"] else spark.createDataFrame([], kinds)
    counts = dict(watch.get)
    good = one("true") if counts["accepted"] else spark.createDataFrame([], kinds)
    dead = one("false") if counts["accepted"] < counts["requests"] else spark.createDataFrame([], kinds)
    return good.drop("reasons"), dead.drop("request"), counts
