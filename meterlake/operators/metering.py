"""Usage: rates against limits, metered bills, prices, chargeback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlake.operators.metrics import time_part

#: Free units a month, and the price of a unit beyond them: fixed values of the price list.
#: Speech to text counts blocks of 15 s, speech characters, language tokens (the price is of 1,000).
PRICES = {"api_stt": (10_000, "150"), "api_tts": (100_000, "1"), "api_llm": (50_000, "0.01")}


def tumbling(rows: DataFrame, time: str, width: str, *keys: str, tokens: Column | None = None) -> DataFrame:
    """Requests per key and window, and their tokens if told how many a request has."""
    sums = [F.count("*").alias("requests")] + ([] if tokens is None else [F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("tokens")])
    wide = rows.groupBy(F.window(time, width).alias("w"), *keys).agg(*sums)
    return wide.select(F.col("w.start").alias("window_start"), *keys, *wide.columns[1 + len(keys) :])


def hopping(rows: DataFrame, time: str, width: str, step: str, *keys: str) -> DataFrame:
    """Requests per key and overlapping window."""
    return rows.groupBy(F.window(time, width, step).alias("w"), *keys).agg(F.count("*").alias("requests")).select(F.col("w.start").alias("window_start"), *keys, "requests")


def sliding(rows: DataFrame, seconds: Column, width: int, *keys: str) -> DataFrame:
    """rows with recent: the requests of the same key in the last width seconds, this one included; none where the time is null.

    A request lies in one stretch of width seconds and is seen from that and the next, so a task orders
    two stretches of a key however long its history is.
    """
    timed = rows.withColumn("_at", seconds).withColumn("_own", F.floor(F.col("_at") / width))
    seen = timed.withColumn("_part", F.explode(F.array("_own", F.col("_own") + 1)))
    frame = Window.partitionBy(*keys, "_part").orderBy("_at").rangeBetween(-width, 0)
    counted = seen.withColumn("recent", F.count("_at").over(frame)).where(F.col("_part").eqNullSafe(F.col("_own")) | F.col("_own").isNull())
    whole = counted.where("_own IS NOT NULL").unionByName(timed.where("_own IS NULL").withColumns({"_part": F.col("_own"), "recent": F.lit(0).cast("long")}))
    return whole.drop("_at", "_own", "_part")


def breaches(rates: DataFrame, limits: DataFrame, key: str, limit: str, what: str = "requests") -> DataFrame:
    """Windows in which a key made more requests, or used more tokens, than its limit."""
    return rates.join(limits, key).where(F.col(what) > F.col(limit))


def metered_bill(usage: DataFrame, month: Column, units: Column, free: int, price: str, *keys: str) -> DataFrame:
    """Per month and keys: units, and what those beyond the free ones cost, in decimals."""
    summed = usage.groupBy(month.alias("month"), *keys).agg(F.sum(units).cast("long").alias("units"))
    return summed.withColumn("amount", (F.greatest(F.col("units") - free, F.lit(0)) * F.lit(price).cast("decimal(12,4)")).cast("decimal(24,4)"))


def price_by(usage: DataFrame, prices: DataFrame, on: Column, group: str, units: str, price: str) -> DataFrame:
    """Cost by group: units at the price of their model."""
    joined = usage.join(prices, on)
    return joined.groupBy(group).agg(F.sum(F.col(units).cast("decimal(18,4)") * F.col(price).cast("decimal(18,4)")).cast("decimal(38,4)").alias("cost"))


def monthly_bill(usage: DataFrame, api: str, month: Column, units: Column, *keys: str) -> DataFrame:
    """metered_bill with the free units and the price of the price list."""
    free, price = PRICES[api]
    return metered_bill(usage, month, units, free, price, *keys)


def two_price_cost(usage: DataFrame, models: DataFrame, on: Column, group: str, tokens_in: str, tokens_out: str, price_in: str, price_out: str) -> DataFrame:
    """Cost by group of tokens read and written, each at its own price per 1,000."""
    part = lambda n, p: F.sum(F.col(n).cast("decimal(18,4)") * F.col(p).cast("decimal(16,6)"))
    sums = usage.join(models, on).groupBy(group).agg(part(tokens_in, price_in).alias("_in"), part(tokens_out, price_out).alias("_out"))
    return sums.select(group, ((F.coalesce("_in", F.lit(0)) + F.coalesce("_out", F.lit(0))) / 1000).cast("decimal(38,6)").alias("cost"))


def chargeback(rows: DataFrame, levels: Sequence[str], amount: str) -> DataFrame:
    """Sums by all levels, by the first ones, and in all."""
    return rows.rollup(*levels).agg(F.sum(F.col(amount).cast("decimal(18,2)")).cast("decimal(38,2)").alias("amount"), F.count("*").alias("accounts"))


def sessions(rows: DataFrame, time: str, gap: str, *keys: str) -> DataFrame:
    """Runs of a key's requests without a gap as long as gap or longer; rows without a time are in none.

    Runs are found within a key's day, so that no task orders a key's whole history; then the first run of a
    day joins the last of the day before if it follows closely enough, over one row per key and day.
    """
    by = [*keys, "_day"]
    timed = rows.where(F.col(time).isNotNull()).select(*keys, F.col(time).alias("_at")).withColumn("_day", time_part("_at", dict(rows.dtypes)[time]))
    order = Window.partitionBy(*by).orderBy("_at")
    far = lambda later, earlier: later >= earlier + F.expr(f"INTERVAL {gap}")
    new = F.coalesce(far(F.col("_at"), F.lag("_at").over(order)), F.lit(True)).cast("int")
    # rows of one time are one step apart by 0, so a running sum by rows numbers the runs from 0
    numbered = timed.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    runs = numbered.groupBy(*by, "_run").agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"), F.count("*").alias("_n"))
    days = runs.groupBy(*by).agg(F.min("_from").alias("_first"), F.max("_to").alias("_last"), F.max("_run").alias("_most"))
    over = Window.partitionBy(*keys).orderBy("_day")
    days = days.withColumn("_joins", ~F.coalesce(far(F.col("_first"), F.lag("_last").over(over)), F.lit(True)))
    # where the last run of a day began: in this day, unless it is the only one and joins the day before
    own = F.when(~(F.col("_joins") & (F.col("_most") == 0)), F.struct(F.col("_day").alias("day"), F.col("_most").alias("run")))
    days = days.withColumn("_root", F.last(own, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)))
    told = days.where("_joins").select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), "_root")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)] + [F.col("_run") == 0]
    whole = runs.join(told, same, "left").withColumn("_id", F.coalesce("_root", F.struct(F.col("_day").alias("day"), F.col("_run").alias("run"))))
    out = whole.groupBy(*keys, "_id").agg(F.min("_from").alias("session_start"), F.max("_to").alias("_end"), F.sum("_n").alias("requests"))
    return out.select(*keys, "session_start", (F.col("_end") + F.expr(f"INTERVAL {gap}")).alias("session_end"), "requests")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: str, out: str) -> DataFrame:
    """left with, per row, the value of the last row of right at or before its time, by keys.

    Both sides are merged and the last value carried forward, within a key's day and then from day to
    day: no range join that pairs every row with all earlier ones, and no task that orders a key's
    whole history. At equal times right comes first.
    """
    a = left.withColumn("_side", F.lit(1)).withColumn("_value", F.lit(None).cast(dict(right.dtypes)[value]))
    b = right.select(*keys, time, F.col(value).alias("_value")).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    both = both.withColumn("_part", time_part(time, dict(both.dtypes)[time]))
    order = Window.partitionBy(*keys, "_part").orderBy(time, "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    within = both.withColumn("_within", F.last("_value", ignorenulls=True).over(order))
    end = F.when(F.col("_value").isNotNull(), F.struct(F.col(time).alias("t"), F.col("_value").alias("v")))
    days = both.groupBy(*keys, "_part").agg(F.max(end).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*keys, "_part", F.last("_end.v", ignorenulls=True).over(earlier).alias("_before"))
    days = days.select(*(F.col(k).alias(f"_{n}") for n, k in enumerate([*keys, "_part"])), "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_{n}")) for n, k in enumerate([*keys, "_part"])]
    joined = within.where("_side = 1").join(days, same, "left")
    return joined.withColumn(out, F.coalesce("_within", "_before")).select(*left.columns, out)
