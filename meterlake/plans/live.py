"""Queries over streams of stored rows: state with timers, joins of two streams, topics, deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.operators import store
from meterlake.plans.registry import query
from meterlake.session import new_folder, table
from meterlake.sources import readers, sinks, topic
from meterlake.streaming import jobs, matching, replay, stateful

#: What streams have passed once all events are read: the last time, in whole milliseconds, less what is allowed to be late.
_PASSED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL {late} FROM events)"


def _events(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """events as a stream, times read as UTC; the folder holds other tables, hence the filter by name."""
    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return rows.select(F.col("ts").cast("timestamp").alias("ts"), *columns)


@query(
    "SELECT user_id, event_id, moved, delta, running FROM (SELECT user_id, event_id, moved, delta, sum(delta) OVER (PARTITION BY user_id ORDER BY moved, delta, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running "
    "FROM (SELECT user_id, event_id, ts AS moved, 1 AS delta FROM events UNION ALL SELECT user_id, event_id, ts + INTERVAL 6 HOUR, -1 FROM events)) "
    f"WHERE moved < {_PASSED.format(late='1 HOUR')}"
)
def q76_stream_inflight(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d, "event_id", "user_id")
    requests = events.withColumn("done", F.expr("ts + INTERVAL 6 HOURS"))
    with stateful.state_on_disk(spark):
        told = replay.appended(stateful.running_requests(requests, "user_id", "ts", "done", "event_id", "1 hour"))
    return told.select("user_id", "event_id", F.col("at").cast("timestamp_ntz").alias("moved"), "delta", "running")


@query(
    "WITH u AS (SELECT event_id // 4 AS job_id, ts AS t, CASE event_type WHEN 'view' THEN 'queued' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status FROM events), "
    f"seen AS (SELECT *, row_number() OVER w AS k, lag(status) OVER w AS was, lag(t) OVER w AS before FROM u WHERE t < {_PASSED.format(late='1 HOUR')} WINDOW w AS (PARTITION BY job_id ORDER BY t, status)), "
    "kept AS (SELECT * FROM (SELECT *, min(k) FILTER (WHERE was IN ('completed', 'failed') OR t - before > INTERVAL 20 MINUTE) OVER (PARTITION BY job_id) AS stop FROM seen) WHERE stop IS NULL OR k < stop) "
    "SELECT job_id, status, t AS changed_at FROM kept WHERE was IS DISTINCT FROM status UNION ALL "
    "SELECT job_id, 'expired', t + INTERVAL 20 MINUTE FROM (SELECT job_id, max(t) AS t, arg_max(status, k) AS status FROM kept GROUP BY job_id) "
    f"WHERE status NOT IN ('completed', 'failed') AND t + INTERVAL 20 MINUTE < {_PASSED.format(late='1 HOUR')}"
)
def q77_stream_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d, "event_id", "event_type")
    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    updates = events.select(F.expr("event_id div 4").alias("job_id"), status.alias("status"), F.col("ts").alias("at"))
    with stateful.state_on_disk(spark):
        told = replay.appended(stateful.lifecycle(updates, "20 minutes", "1 hour"))
    return told.select("job_id", "status", F.col("at").cast("timestamp_ntz").alias("changed_at"))


_JOBS = "SELECT event_id // 2 AS job_id, user_id, ts AS submitted_at FROM events WHERE event_id % 2 = 0"
_RESULTS = "SELECT event_id // 2 AS job_id, event_type AS outcome, ts AS finished_at FROM events WHERE event_id % 2 = 1 AND event_type <> 'error'"


@query(
    f"SELECT j.job_id, user_id, submitted_at, outcome, finished_at FROM ({_JOBS}) j LEFT JOIN ({_RESULTS}) r ON j.job_id = r.job_id AND finished_at BETWEEN submitted_at AND submitted_at + INTERVAL 5 MINUTE "
    f"WHERE finished_at IS NOT NULL OR submitted_at + INTERVAL 5 MINUTE < (SELECT least((SELECT max(submitted_at) FROM ({_JOBS})), (SELECT max(finished_at) FROM ({_RESULTS})))) - INTERVAL 10 MINUTE"
)
def q78_stream_results(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d, "event_id", "user_id", "event_type")
    even = events.where("event_id % 2 = 0").select(F.expr("event_id div 2").alias("job_id"), "user_id", F.col("ts").alias("submitted_at"))
    odd = _events(spark, d, "event_id", "event_type").where("event_id % 2 = 1 AND event_type <> 'error'")
    results = odd.select(F.expr("event_id div 2").alias("job_id"), F.col("event_type").alias("outcome"), F.col("ts").alias("finished_at"))
    with stateful.state_on_disk(spark):
        told = replay.appended(matching.matched(even, results, "job_id", "submitted_at", "finished_at", "5 minutes", "10 minutes"))
    return told.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("submitted_at", "finished_at")})


@query(
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, user_id, count(*) AS requests, sum(ceil(value))::BIGINT AS tokens FROM events GROUP BY ALL "
    f"HAVING time_bucket(INTERVAL 1 HOUR, max(ts)) + INTERVAL 1 HOUR <= {_PASSED.format(late='2 HOUR')}"
)
def q79_stream_tokens(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d, "user_id", "value")
    rates = jobs.windowed_rate(events, "ts", "2 hours", "1 hour", "user_id", tokens=F.ceil("value"))
    return replay.appended(rates).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT o_orderkey::VARCHAR AS job_id, 'completed' AS status, 'jobs/' || o_orderkey || '.png' AS url FROM orders WHERE o_orderstatus = 'P'")
def q80_topic_consumed(spark: SparkSession, d: str) -> DataFrame:
    topic.register(spark)
    path = new_folder(spark, "topic")
    queued = store.find_eq(table(spark, d, "orders"), o_orderstatus="P")
    messages = sinks.envelopes(queued.select(F.col("o_orderkey").cast("string").alias("job_id"), F.lit("image").alias("job_type"), F.col("o_custkey").cast("string").alias("payload")))
    messages.write.format("job_topic").mode("append").save(path)
    arrived = spark.readStream.format("job_topic").load(path).select(F.from_json("value", readers.MESSAGE).alias("m")).where("m.job_id IS NOT NULL").select("m.*")
    done = jobs.finished(arrived, F.concat(F.lit("jobs/"), F.col("job_id"), F.lit(".png")))
    return replay.appended(done.select("job_id", "status", F.col("result_urls")[0].alias("url")))
