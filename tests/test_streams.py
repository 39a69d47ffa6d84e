"""Stateful streams, joins of streams, the job topic and webhook deliveries: order of arrival, restarts, failures."""

import datetime as dt
import json
import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from meterlake.operators import metrics
from meterlake.sources import sinks, topic
from meterlake.streaming import matching, replay, stateful

T0 = dt.datetime(2024, 1, 1)
REQUESTS = "user string, id long, s timestamp, e timestamp"


def at(minutes: float) -> dt.datetime:
    return T0 + dt.timedelta(minutes=minutes)


def requests(n=300, seed=1):
    pick = random.Random(seed)
    rows = []
    for k in range(n):
        start = k + pick.random()
        rows.append((pick.choice(["a", "a", "b", None]), k, at(start), at(start + pick.randrange(0, 90))))
    return rows


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def gauge(spark, folder, out):
    with stateful.state_on_disk(spark):
        return replay.appended(stateful.running_requests(replay.stream_of(spark, folder, spark.createDataFrame([], REQUESTS).schema), "user", "s", "e", "id", "30 minutes"), out)


def test_gauge_is_the_batch_gauge_whatever_the_order_and_restarts(spark, tmp_path):
    rows = requests()
    lots = [rows[k : k + 60] for k in range(0, 300, 60)]
    for lot in lots:
        random.Random(3).shuffle(lot)
    # two rows swap lots but stay within what may be late
    lots[0][0], lots[1][0] = lots[1][0], lots[0][0]
    lots[0].sort(key=lambda r: r[2])
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    for lot in lots:
        put(spark, lot, REQUESTS, one)
    whole = {tuple(r) for r in gauge(spark, one, f"file://{tmp_path}/out1").collect()}
    for k, lot in enumerate(lots):
        put(spark, lot, REQUESTS, two)
        if k in (1, 3, 4):
            parts = gauge(spark, two, f"file://{tmp_path}/out2")
    again = [tuple(r) for r in parts.collect()]
    kept = spark.createDataFrame([r for r in rows], REQUESTS)
    passed = kept.agg(F.max("s")).first()[0].replace(microsecond=kept.agg(F.max("s")).first()[0].microsecond // 1000 * 1000) - dt.timedelta(minutes=30)
    want = {tuple(r) for r in metrics.in_flight(kept, "user", "s", "e", "id").where(F.col("at") < F.lit(passed)).collect()}
    assert whole == want and len(again) == len(set(again)) and set(again) == want


UPDATES = "job_id string, status string, at timestamp"


def test_lifecycle_with_timers(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    for rows in (
        [("a", "queued", at(0)), ("b", "running", at(1)), ("b", "queued", at(0)), ("b", "completed", at(2)), ("n", None, at(1)), (None, "queued", at(3))],
        [("b", "running", at(5)), ("c", "queued", at(200)), ("a", "running", at(61))],
        [("c", "running", at(230)), ("c", "running", at(240))],
        [("d", "queued", at(1000))],
    ):
        put(spark, rows, UPDATES, folder)
    with stateful.state_on_disk(spark):
        got = replay.appended(stateful.lifecycle(replay.stream_of(spark, folder, spark.createDataFrame([], UPDATES).schema), "1 hour", "10 minutes", "2 hours"))
    told = [(r.job_id, r.status, r["at"]) for r in got.orderBy("job_id", "at").collect()]
    assert told == [
        (None, "queued", at(3)), (None, "expired", at(63)), ("a", "queued", at(0)), ("a", "expired", at(60)), ("b", "queued", at(0)), ("b", "running", at(1)), ("b", "completed", at(2)),
        ("c", "queued", at(200)), ("c", "running", at(230)), ("c", "expired", at(300)),
    ]


def test_jobs_of_a_bucket_go_their_own_ways(spark, tmp_path):
    pick, folder = random.Random(8), f"file://{tmp_path}/in"
    rows = [(pick.choice([None, *(f"j{k}" for k in range(60 * lot, 60 * lot + 90))]), pick.choice(["queued", "running", "running", "completed"]), at(100 * lot + 100 * pick.random())) for lot in range(4) for _ in range(300)]
    for lot in range(4):
        put(spark, rows[300 * lot : 300 * lot + 300], UPDATES, folder)
    with stateful.state_on_disk(spark):
        out = stateful.lifecycle(replay.stream_of(spark, folder, spark.createDataFrame([], UPDATES).schema), "20 minutes", "2 hours", buckets=4)
        run = out.writeStream.format("parquet").option("path", f"file://{tmp_path}/rows").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    passed, silent, want = max(r[2] for r in rows), dt.timedelta(minutes=20), set()
    passed = passed.replace(microsecond=passed.microsecond // 1000 * 1000) - dt.timedelta(hours=2)
    for job in {r[0] for r in rows}:
        status = last = None
        for when, new in [*sorted((r[2], r[1]) for r in rows if r[0] == job and r[2] < passed), (passed, None)]:
            if status in ("queued", "running") and last + silent < when:
                status = "expired"
                want.add((job, status, last + silent))
            if new and status not in ("completed", "expired"):
                if new != status:
                    want.add((job, new, when))
                status, last = new, when
    got = [tuple(r) for r in spark.read.schema(out.schema).parquet(f"file://{tmp_path}/rows").collect()]
    assert len(got) == len(set(got)) and set(got) == want and {r[1] for r in got} == {"queued", "running", "completed", "expired"}
    # a hundred jobs and more are in the state, yet its rows and timers go by buckets
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress) <= 4 * 20


def test_join_of_streams_frees_its_state(spark, tmp_path):
    left, right = f"file://{tmp_path}/jobs", f"file://{tmp_path}/results"
    for k in range(0, 600, 100):
        put(spark, [(j, at(j)) for j in range(k, k + 100)] + [(None, at(k))], "job_id long, sent timestamp", left)
        put(spark, [(j, at(j + (1 if j % 3 else 9)), "ok") for j in range(k, k + 100, 2)], "job_id long, back timestamp, outcome string", right)
    jobs_in = replay.stream_of(spark, left, spark.createDataFrame([], "job_id long, sent timestamp").schema)
    results = replay.stream_of(spark, right, spark.createDataFrame([], "job_id long, back timestamp, outcome string").schema)
    out = matching.matched(jobs_in, results, "job_id", "sent", "back", "5 minutes", "2 minutes")
    run = out.writeStream.format("parquet").option("path", f"file://{tmp_path}/rows").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.read.schema(out.schema).parquet(f"file://{tmp_path}/rows").collect()
    hit = {r.job_id for r in got if r.outcome}
    assert hit == {j for j in range(0, 600, 2) if j % 3}
    assert all(r.back is None for r in got if not r.outcome) and {r.job_id for r in got if not r.outcome} >= {j for j in range(580) if j % 2 or j % 3 == 0} and sum(r.job_id is None for r in got) == 6
    last = run.recentProgress[-1]
    assert last["stateOperators"][0]["numRowsTotal"] < 60


def test_topic_in_batches_and_streams(spark, tmp_path):
    topic.register(spark)
    path = f"file://{tmp_path}/topic"
    rows = spark.createDataFrame([(f"jobs.{k % 2}", json.dumps({"k": k, "é": "\n"}), None) for k in range(100)], topic.SCHEMA)
    rows.repartition(3).write.format("job_topic").mode("append").save(path)
    rows.limit(0).write.format("job_topic").mode("append").save(path)
    assert {tuple(r) for r in spark.read.format("job_topic").load(path).collect()} == {tuple(r) for r in rows.collect()}
    stream = lambda: spark.readStream.format("job_topic").load(path)
    assert replay.appended(stream(), f"file://{tmp_path}/out").count() == 100
    rows.limit(7).write.format("job_topic").mode("append").save(path)
    assert replay.appended(stream(), f"file://{tmp_path}/out").count() == 107
    with pytest.raises(Exception, match="append"):
        rows.write.format("job_topic").mode("overwrite").save(path)
    assert spark.read.format("job_topic").load(f"file://{tmp_path}/none").count() == 0


def test_a_batch_that_is_run_again_adds_nothing_to_the_topic(spark, tmp_path):
    topic.register(spark)
    source, path, state = f"file://{tmp_path}/in", f"file://{tmp_path}/topic", tmp_path / "state"
    kind = spark.createDataFrame([], topic.SCHEMA).schema

    def run():
        out = replay.stream_of(spark, source, kind).writeStream.format("job_topic").option("writer", "w").option("checkpointLocation", f"file://{state}")
        out.trigger(availableNow=True).start(path).awaitTermination()

    put(spark, [("jobs.a", str(k), "a") for k in range(5)], topic.SCHEMA, source)
    run()
    put(spark, [("jobs.a", str(k), "a") for k in range(5, 9)], topic.SCHEMA, source)
    run()
    # as if the driver had died between the topic's commit and its own
    last = max((p for p in (state / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (state / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert sorted(int(r.value) for r in spark.read.format("job_topic").load(path).collect()) == list(range(9))
    assert len(list((tmp_path / "topic" / "segments").iterdir())) == sum(len(json.loads(p.read_text())["segments"]) for p in (tmp_path / "topic" / "commits").glob("*.json"))


def test_a_failed_batch_posts_only_the_rest(spark, tmp_path):
    seen, down = tmp_path / "seen", tmp_path / "down"
    seen.mkdir()
    down.touch()
    schema = "webhook_id string, payload string"
    put(spark, [(f"w{k}", json.dumps({"n": k})) for k in range(12)] + [("w3", '{"n": 3}')], schema, f"file://{tmp_path}/events")

    def post(webhook: str, payload: str, signature: str) -> int:
        if down.exists() and webhook in ("w5", "w7"):
            if webhook == "w7":
                raise OSError("no answer")
            return 503
        with (seen / webhook).open("a") as file:
            file.write("x")
        return 200

    stream = lambda: sinks.deliver(replay.stream_of(spark, f"file://{tmp_path}/events", spark.createDataFrame([], schema).schema), "s", post, f"file://{tmp_path}/state").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="refused"):
        stream().awaitTermination()
    assert len(list(seen.iterdir())) == 10
    down.unlink()
    stream().awaitTermination()
    assert {p.name: p.read_text() for p in seen.iterdir()} == {f"w{k}": "x" for k in range(12)}
