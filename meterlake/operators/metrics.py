"""Traffic metrics: counters, latency histogram, gauge, text exposition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Upper bounds of the latency histogram: fixed values of the common metrics client.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def counter(rows: DataFrame, *labels: str | Column) -> DataFrame:
    """Rows per label set."""
    return rows.groupBy(*labels).agg(F.count("*").alias("requests"))


def histogram(rows: DataFrame, labels: Sequence[str], value: str, bounds: Sequence[float] = LATENCY_BOUNDS) -> DataFrame:
    """Per label set and bound le, the last of which is infinite: how many values are at most le, with the sum and count of all.

    All bounds are counted in one aggregation and unpivoted afterwards, so rows are not multiplied.
    """
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = rows.groupBy(*labels).agg(*counts, F.sum(value).alias("total"), F.count(value).alias("n"))
    last = F.struct(F.lit(float("inf")).alias("le"), F.col("n").alias("cumulative"))
    pairs = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(bounds)), last)
    return wide.select(*labels, F.explode(pairs).alias("p"), "total", "n").select(*labels, "p.le", "p.cumulative", "total", "n")


def quantiles(rows: DataFrame, labels: Sequence[str], value: str, *shares: float) -> DataFrame:
    """Exact quantiles per label set, between neighbouring values by their distance; null where it has no values.

    Values are counted first, and counts summed by stretches of like size of the values; then only the
    stretches that hold a wanted rank are ordered, so no task holds all values of a label set.
    """
    v = F.col(value).cast("double")
    counts = rows.where(v.isNotNull()).groupBy(*labels, v.alias("_v")).agg(F.count("*").alias("_n"))
    size = F.floor(F.log2(F.abs("_v")) * 64)
    keyed = counts.withColumn("_part", F.struct(F.signum("_v").alias("sign"), F.when(F.col("_v") < 0, -size).when(F.col("_v") > 0, size).otherwise(0).alias("size")))
    by = Window.partitionBy(*labels)
    parts = keyed.groupBy(*labels, "_part").agg(F.sum("_n").alias("_in"))
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_in").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_in").over(by)})
    asked = F.array(*(F.struct(F.lit(k).alias("k"), ((F.col("_all") - 1) * s).alias("at")) for k, s in enumerate(shares)))
    wanted = parts.withColumn("_q", F.explode(asked)).withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_q.at"), F.ceil("_q.at")))))
    wanted = wanted.where("_before <= _rank and _rank < _before + _in")
    names = [*labels, "_part"]
    wanted = wanted.select(*(F.col(c).alias(f"_w{i}") for i, c in enumerate(names)), "_before", "_q", "_rank")
    near = keyed.join(wanted, [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate(names)])
    upto = F.sum("_n").over(Window.partitionBy(*names, "_q.k", "_rank").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    hits = near.withColumn("_upto", upto).where("_upto - _n <= _rank and _rank < _upto")
    weight = F.lit(1.0) - F.abs(F.col("_q.at") - F.col("_rank"))
    found = rows.select(*labels, F.lit(None).cast("int").alias("_k"), F.lit(None).cast("double").alias("_x")).distinct().unionByName(hits.select(*labels, F.col("_q.k").alias("_k"), (weight * F.col("_v")).alias("_x")))
    return found.groupBy(*labels).agg(*(F.sum(F.when(F.col("_k") == k, F.col("_x"))).alias(f"p{round(s * 100)}") for k, s in enumerate(shares)))


def approximate_quantiles(rows: DataFrame, labels: Sequence[str], value: str, *shares: float, accuracy: int = 10_000) -> DataFrame:
    """Quantiles from a bounded sketch, for label sets too large to sort."""
    return rows.groupBy(*labels).agg(*(F.percentile_approx(value, s, accuracy).alias(f"p{round(s * 100)}") for s in shares))


def in_flight(rows: DataFrame, by: str, start: str, end: str, key: str) -> DataFrame:
    """Per start and end of an interval [start, end): how many are running then, by tenant.

    At equal times ends come first, so an interval that ends when another starts does not overlap it.
    Moves are summed by tenant and day, and these sums over a tenant's days, so that a task orders one day of a tenant.
    """
    moves = F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("delta")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("delta")))
    steps = rows.select(by, key, F.explode(moves).alias("m")).select(by, key, "m.at", "m.delta")
    steps = steps.withColumn("_part", time_part("at", dict(steps.dtypes)["at"]))
    parts = steps.groupBy(by, "_part").agg(F.sum("delta").alias("_moved"))
    before = F.coalesce(F.sum("_moved").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    order = Window.partitionBy(by, "_part").orderBy("at", "delta", key).rowsBetween(Window.unboundedPreceding, 0)
    within = steps.withColumn("_within", F.sum("delta").over(order))
    joined = within.join(parts.select(by, "_part", before.alias("_before")), (within[by].eqNullSafe(parts[by])) & within["_part"].eqNullSafe(parts["_part"]))
    return joined.select(*(within[c] for c in (by, key, "at", "delta")), (F.col("_before") + F.col("_within")).alias("running"))


def time_part(time: str, kind: str, width: int = 86_400) -> Column:
    """The number of the stretch of width seconds, or of as many units of a number, that a time lies in; null for null."""
    seconds = F.unix_seconds(F.col(time).cast("timestamp")) if kind.startswith("timestamp") else F.col(time)
    return F.floor(seconds / width)


def in_flight_totals(rows: DataFrame, alias: str, start: str, end: str, now: Column) -> DataFrame:
    """Per alias, and for all of them where it is null: how many intervals [start, end) hold now."""
    running = (F.col(start) <= now) & (F.col(end) > now)
    return rows.rollup(alias).agg(F.count_if(running).alias("in_flight"))


def page_label(rows: DataFrame, number: int, size: int) -> DataFrame:
    """The numbers that the label of page number (from 0) shows: its first and last row, and the count of all."""
    total = F.count("*")
    return rows.agg(F.least(F.lit(number * size + 1), total).alias("first_row"), F.least(F.lit((number + 1) * size), total).alias("last_row"), total.alias("total"))


def status_counters(rows: DataFrame, status: Column) -> DataFrame:
    """How many requests were refused for want of a key, and for too many at once."""
    return rows.agg(F.count_if(status == 401).alias("unauthorized"), F.count_if(status == 429).alias("limited"), F.count("*").alias("requests"))


def report(rows: DataFrame, time: str, api: str, status: str, status_class: str | None = None, apis: Sequence[str] = (), first: str | None = None, last: str | None = None) -> DataFrame:
    """The rows of the API report: of a class of statuses such as 4xx, or one status, of some APIs, from the day first to the end of the day last.

    What is not given filters nothing. Times and APIs are compared as they are stored, so these filters reach the scan.
    """
    if status_class:
        rows = rows.where(F.floor(F.col(status) / 100) == int(status_class[0]) if status_class[1:].lower() == "xx" else F.col(status) == int(status_class))
    if apis:
        rows = rows.where(F.col(api).isin(*apis))
    kind = rows.schema[time].dataType
    if first:
        rows = rows.where(F.col(time) >= F.lit(first).cast(kind))
    if last:
        rows = rows.where(F.col(time) < F.date_add(F.to_date(F.lit(last)), 1).cast(kind))
    return rows


def alias_stats(rows: DataFrame, alias: str, time: str, latency: str, seconds: Column) -> DataFrame:
    """Per alias: last call, mean latency, requests a second over the given time."""
    return rows.groupBy(alias).agg(F.max(time).alias("last_called"), F.round(F.avg(latency), 4).alias("avg_latency"), F.round(F.count("*") / F.first(seconds), 6).alias("rps"))


def exposition(counters: DataFrame, metric: str, labels: Sequence[str], value: str, help_text: str | None = None, kind: str = "counter") -> DataFrame:
    """Text lines of a labelled metric, as scrapers read them, with section (0: HELP, 1: TYPE, 2: samples) to order them by; HELP and TYPE come if there is a help_text.

    Backslashes, quotes and line ends of label values are escaped; a null value is empty.
    """
    shown = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), shown(c), F.lit('"')) for c in labels))
    lines = counters.select(F.lit(2).alias("section"), F.concat(F.lit(f"{metric}{{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))
    if help_text is None:
        return lines
    head = [(0, f"# HELP {metric} {help_text}"), (1, f"# TYPE {metric} {kind}")]
    return counters.sparkSession.createDataFrame(head, "section int, line string").unionByName(lines)
