"""Jobs of one stream matched to results of another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matched(jobs: DataFrame, results: DataFrame, key: str, submitted: str, finished: str, within: str = "1 hour", late: str = "10 minutes", outer: bool = True) -> DataFrame:
    """Every job with each of its results that come at or after submitted and no more than within later; a job without any comes once, with nulls, if outer.

    Both streams have a watermark and the join bounds the distance in time, so both sides of the state are
    freed: a job waits for within and late, a result only for late. A job without a result comes when its
    wait is over, not before. Rows with a null key or time match nothing; such jobs come with nulls if outer.
    Other columns of results keep their names, so they must differ from those of jobs.
    """
    left = jobs.withWatermark(submitted, late)
    right = results.withWatermark(finished, late).withColumnRenamed(key, "_key")
    on = F.expr(f"{key} = _key AND {finished} >= {submitted} AND {finished} <= {submitted} + INTERVAL {within}")
    return left.join(right, on, "leftOuter" if outer else "inner").drop("_key")
