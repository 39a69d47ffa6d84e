"""Metrics over long spans from sketches that are stored by day and merged: callers, latencies, calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the sketches: 2^LG_K registers of callers (about 1.04 / sqrt(2^LG_K) of relative error), and K of latencies (about 1.7 / K^0.9 of rank error).
LG_K, K = 12, 400


def daily(rows: DataFrame, time: str, labels: Sequence[str], caller: str, latency: str) -> DataFrame:
    """day, labels, calls, callers and latencies (sketches): a row per day and label set, whatever the number of calls. Rows without a time have no day."""
    by = rows.groupBy(F.to_date(time).alias("day"), *labels)
    return by.agg(F.count("*").alias("calls"), F.hll_sketch_agg(caller, LG_K).alias("callers"), F.kll_sketch_agg_double(F.col(latency).cast("double"), K).alias("latencies"), F.count(latency).alias("timed"))


def rolled_up(days: DataFrame, *keys: str | Column) -> DataFrame:
    """The rows of daily merged by other keys, as months or fewer labels: sums and merged sketches, of one size however many days go in."""
    return days.groupBy(*keys).agg(
        F.sum("calls").alias("calls"), F.hll_union_agg("callers").alias("callers"), F.kll_merge_agg_double("latencies").alias("latencies"), F.sum("timed").alias("timed")
    )


def read_out(sketches: DataFrame, *shares: float) -> DataFrame:
    """sketches with distinct (estimated callers) and p<share> of the latencies, null where there are none, in place of the sketches."""
    shown = sketches.withColumn("distinct", F.hll_sketch_estimate("callers"))
    for s in shares:
        shown = shown.withColumn(f"p{round(s * 100)}", F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("latencies", F.lit(s))))
    return shown.drop("callers", "latencies")
