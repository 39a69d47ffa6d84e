"""Operators on small hand-made rows, for what the driver's tables do not hold."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from meterlake.functions import scalar, schemas
from meterlake.operators import gate, metering, metrics, shape, store
from meterlake.sources import readers, sinks
from meterlake.streaming import stateful


def test_set_fields_keeps_old_values_and_inserts_nothing(spark):
    t = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, name string, n int")
    u = spark.createDataFrame([(1, None, 11), (3, "c", 30)], "k int, name string, n int")
    assert sorted(map(tuple, store.set_fields(t, u, "k").collect())) == [(1, "a", 11), (2, "b", 20)]


def test_upsert_and_delete(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    u = spark.createDataFrame([(2, "x"), (3, "c")], "k int, v string")
    assert sorted(map(tuple, store.upsert(t, u, "k").collect())) == [(1, "a"), (2, "x"), (3, "c")]
    assert [r.k for r in store.delete(t, u, "k").collect()] == [1]
    assert store.upsert(t.limit(0), u.limit(0), "k").count() == 0


def test_approve_twice_changes_nothing_more(spark):
    t = spark.createDataFrame([("r1", "pending_approval"), ("r2", "rejected")], "request_id string, status string")
    keys, done = store.approve(t, "request_id", "s")
    assert keys.count() == 1
    again, same = store.approve(done, "request_id", "s")
    assert {r.request_id: r.approved_key_id for r in same.collect()} == {r.request_id: r.approved_key_id for r in done.collect()}
    assert again.count() == 0 and {r.status for r in same.collect()} == {"approved", "rejected"}


def test_reject(spark):
    t = spark.createDataFrame([("r1", "pending_approval"), ("r2", "pending_approval")], "request_id string, status string")
    no = spark.createDataFrame([("r2", "no budget")], "request_id string, rejection_reason string")
    assert {tuple(r) for r in store.reject(t, no, "request_id").collect()} == {("r1", "pending_approval", None), ("r2", "rejected", "no budget")}


@pytest.mark.parametrize("header, ok", [(None, False), ("Bearer short", False), ("Bearer long-enough", True), ("Basic long-enough-key", False), ("Bearer  12345678 ", True)])
def test_bearer(spark, header, ok):
    row = spark.createDataFrame([(header,)], "h string").select(gate.bearer_ok(F.col("h")).alias("ok")).first()
    assert row.ok is ok


def test_networks(spark):
    nets = gate.cidr_bounds(spark.createDataFrame([("10.0.0.0/7",), ("192.168.1.7",)], "cidr string"))
    ips = spark.createDataFrame([("11.255.255.255",), ("12.0.0.0",), ("192.168.1.7",), ("192.168.1.8",), ("bad",), (None,)], "a string").withColumn("ip", scalar.ipv4_number(F.col("a")))
    assert {r.a for r in gate.in_networks(ips, "ip", nets).collect()} == {"11.255.255.255", "192.168.1.7"}


def test_admitted_hosts_of_both_versions(spark):
    import ipaddress

    cidrs = ["10.0.0.0/7", "192.168.1.7", "2001:db8::/33", "fe80::/10", "::/0", "1.2.3.4/31", "bad", "1.2.3.4/40", None, " 9.0.0.0/255.0.0.0 ", "8.8.8.0/0.0.0.255", "7.0.0.0/255.0.255.0", "6.0.0.0/+8", "::ffff:1.2.3.0/120", "05.0.0.0/8", "4.0.0.0/"]
    hosts = ["11.255.0.1", "12.0.0.0", "192.168.1.7", "2001:db8:7fff::1", "2001:DB8:8000::", "febf::1", "fec0::", "::1", "localhost", "1.2.3.5", "1.2.3.6", "x", "1::2::3", ":::", "a:", None, "1:2:3:4:5:6:7:8:9", "01.2.3.4", "1.2.3.4.", "::ffff:1.2.3.4", "::ffff:1.2.3.256", "1:2:3:4:5:6:7:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "fe80::1%eth0", "fe80::1%", "9.255.1.1", "8.8.8.200", "7.1.2.3", "6.1.1.1", "5.1.1.1", "4.1.1.1", "1.2.3.4\n", "::ffff:01.2.3.4", ""]
    rows = spark.createDataFrame([(k, h) for k, h in enumerate(hosts)], "k int, h string")

    def known(h, nets):
        try:
            return any(ipaddress.ip_address(h) in n for n in nets)
        except ValueError:
            return False

    for some in (cidrs, cidrs[:4], cidrs[5:7], cidrs[9:], cidrs[6:9]):
        nets = []
        for c in some:
            try:
                nets.append(ipaddress.ip_network(str(c).strip(), strict=False))
            except ValueError:
                pass
        got = {r.k: r.admitted for r in gate.admitted(rows, "h", spark.createDataFrame([(c,) for c in some], "cidr string")).collect()}
        assert got == {k: h in gate.LITERAL_HOSTS or not nets or known(h, nets) for k, h in enumerate(hosts)}
    assert all(r.admitted for r in gate.admitted(rows, "h", spark.createDataFrame([], "cidr string")).collect())


def test_unknown_paths_need_a_key(spark):
    rows = spark.createDataFrame([(None,), ("/v1/chat",), ("/v1/auth/x",), ("/health",)], "p string")
    assert [r.o for r in rows.select(gate.is_open(F.col("p")).alias("o")).collect()] == [False, False, True, True]


def test_exposition_escapes_and_explains(spark):
    rows = spark.createDataFrame([('a"b\\c\n', 3), (None, 1)], "k string, n int")
    got = [r.line for r in metrics.exposition(rows, "m", ["k"], "n", "What it is.").orderBy("section", "line").collect()]
    assert got == ["# HELP m What it is.", "# TYPE m counter", 'm{k=""} 1', 'm{k="a\\"b\\\\c\\n"} 3']


def test_windows_in_parts_agree_with_whole_ones(spark):
    import random

    pick = random.Random(1)
    rows = [(k, pick.choice(["a", "b", None]), pick.randrange(0, 400_000), pick.choice([None, k])) for k in range(400)]
    table = spark.createDataFrame(rows, "id int, k string, t long, v int")
    got = {r.id: r.recent for r in metering.sliding(table, F.col("t"), 50_000, "k").collect()}
    assert got == {i: sum(k2 == k and t - 50_000 <= t2 <= t for _, k2, t2, _ in rows) for i, k, t, _ in rows}
    right = table.where("id % 2 = 0 and v is not null")
    got = {r.id: r.last for r in metering.as_of(table.where("id % 2 = 1"), right, ["k"], "t", "v", "last").collect()}
    held = [(t, v, k) for i, k, t, v in rows if i % 2 == 0 and v is not None]
    assert got == {i: max(((t2, v2) for t2, v2, k2 in held if k2 == k and t2 <= t), default=(0, None))[1] for i, k, t, _ in rows if i % 2}
    moves = metrics.in_flight(table.withColumn("e", F.col("t") + 100_000), "k", "t", "e", "id").collect()
    for r in moves:
        if r.delta == 1:
            seen = sum(k == r.k and (t, i) <= (r["at"], r.id) and t + 100_000 > r["at"] for i, k, t, _ in rows)
            assert r.running == seen


def test_quantiles_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(k % 3 or None, float(x)) for k, x in enumerate(np.round(rng.normal(0, 50, 500), 1))] + [(7, None), (8, -3.0), (9, 0.0), (9, 1.0)]
    got = {r.k: r for r in metrics.quantiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", 0.5, 0.95, 0).collect()}
    for k, r in got.items():
        mine = [v for j, v in rows if j == k and v is not None]
        assert [r.p50, r.p95, r.p0] == ([None] * 3 if not mine else pytest.approx(np.quantile(mine, [0.5, 0.95, 0])))
    assert got.keys() == {None, 1, 2, 7, 8, 9}


def test_files_and_unexpired(spark, tmp_path):
    rows = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("b", None)], "k string, expires_at timestamp")
    sinks.write_lines(rows, str(tmp_path / "t"), "k")
    sinks.write_json(rows, str(tmp_path / "j"), "k")
    assert {r.value for r in spark.read.text(str(tmp_path / "t")).collect()} == {"a", "b"} and spark.read.json(str(tmp_path / "j")).count() == 2
    assert [r.k for r in gate.unexpired(rows, F.lit("2024-06-01").cast("timestamp")).collect()] == ["b"]


def test_upsert_of_several_incoming_rows_is_defined(spark):
    t, u = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "x"), (1, "z"), (1, "y")], "k int, v string")
    assert [tuple(r) for r in store.upsert(t, u, "k").collect()] == [(1, "z")]


def test_title_case_is_pythons(spark):
    names = ["dev_name", "o'neil", "ANNE-marie", "", "é.a b"]
    got = [r.t for r in spark.createDataFrame([(n,) for n in names], "n string").select(scalar.title_case(F.col("n")).alias("t")).collect()]
    assert got == [n.title() for n in names]


def test_signature_ignores_key_order(spark):
    rows = spark.createDataFrame([(json.dumps({"b": 1, "a": "é"}),), (json.dumps({"a": "é", "b": 1}),), (None,)], "p string")
    a, b, c = (r.s for r in rows.select(scalar.signature("secret")("p").alias("s")).collect())
    assert a == b and a.startswith("sha256=") and len(a) == 71 and c is None


def test_in_flight_ends_before_it_starts(spark):
    rows = spark.createDataFrame([(1, "t", 0, 5), (2, "t", 5, 9), (3, "t", 6, 7)], "id int, tenant string, s int, e int")
    got = [(r["at"], r.delta, r.running) for r in metrics.in_flight(rows, "tenant", "s", "e", "id").orderBy("at", "delta", "id").collect()]
    assert got == [(0, 1, 1), (5, -1, 0), (5, 1, 1), (6, 1, 2), (7, -1, 1), (9, -1, 0)]


def test_histogram_holds_nulls_and_edges(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None)], "k string, v double")
    assert {(r.le, r.cumulative, r.n) for r in metrics.histogram(rows, ["k"], "v", [1, 2]).collect()} == {(1.0, 1, 2), (2.0, 2, 2), (float("inf"), 2, 2)}
    assert len(metrics.histogram(rows, ["k"], "v").collect()) == len(metrics.LATENCY_BOUNDS) + 1


def test_bill_charges_beyond_the_free_units(spark):
    rows = spark.createDataFrame([("2024-01", "a", 7), ("2024-01", "a", 8), ("2024-02", "a", 3)], "m string, k string, n int")
    got = {(r.month, str(r.amount)) for r in metering.metered_bill(rows, F.col("m"), F.col("n"), 10, "0.5", "k").collect()}
    assert got == {("2024-01", "2.5000"), ("2024-02", "0.0000")}


def test_as_of_takes_equal_times(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "x"), (1, 6, "y")], "k int, t int, v string")
    assert {tuple(r) for r in metering.as_of(left, right, ["k"], "t", "v", "v").collect()} == {(1, 5, "x"), (1, 1, None), (2, 9, None)}


def test_inputs_scalar_or_list(spark):
    rows = spark.createDataFrame([(1, '"one"'), (2, '["a","b"]')], "id int, v string")
    assert {(r.id, r["index"], r.input) for r in readers.inputs_of(rows, "v").collect()} == {(1, 0, "one"), (2, 0, "a"), (2, 1, "b")}


def test_tree_and_uploads(spark, tmp_path):
    for name in ("a.py", "b.log", "skip/c.py", "d/e.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x" * 3)
    found = readers.tree(spark, str(tmp_path), ["skip"], [".log"])
    assert [(r.name, r.length) for r in found.collect()] == [("a.py", 3), ("e.py", 3)]


def test_normalise(spark):
    rows = spark.createDataFrame([("a", "m1", "active", "2024-01-02T03:04:05Z", 1)], "alias_name string, model_name string, status string, updated_at string, extra int")
    row = schemas.normalise(rows, "aliases", schemas.STATUS_WORDS).first()
    assert (row.target_model, row.status, row.updated_at) == ("m1", "enabled", dt.datetime(2024, 1, 2, 3, 4, 5)) and "extra" not in row.asDict()


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("j1", "image", "p")], "job_id string, job_type string, payload string")
    sinks.publish(rows, str(tmp_path / "topic"))
    assert spark.read.json(str(tmp_path / "topic")).first().key == "jobs.image"
    sinks.report_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == rows.columns
    sinks.append(spark.createDataFrame([("x", None)], "log_id string, timestamp timestamp"), str(tmp_path / "logs"), "timestamp")
    assert spark.read.parquet(str(tmp_path / "logs")).first().timestamp is not None


def test_lifecycle_expires_and_stays_final(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    schema = "job_id string, status string, at timestamp"
    batches = [
        [("a", "queued", t(0)), ("b", "queued", t(0)), ("b", "completed", t(1))],
        [("b", "running", t(2)), ("c", "queued", t(300))],
        [("c", "running", t(301))],
        [("c", "completed", t(700))],
    ]
    source, out = tmp_path / "in", []
    stream = stateful.lifecycle(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)), "1 hour", "10 minutes") if source.mkdir() is None else None
    with stateful.state_on_disk(spark):
        run = stream.writeStream.outputMode("append").foreachBatch(lambda df, _: out.extend((r.job_id, r.status) for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
            run.processAllAvailable()
    finally:
        run.stop()
    assert [s for j, s in out if j == "a"] == ["queued", "expired"]
    assert [s for j, s in out if j == "b"] == ["queued", "completed"]
    assert [s for j, s in out if j == "c"][:2] == ["queued", "running"]


def test_webhooks_are_delivered_signed(spark, tmp_path):
    seen = tmp_path / "seen"
    schema = "webhook_id string, payload string"
    spark.createDataFrame([("w1", '{"a":1}')], schema).write.parquet(str(tmp_path / "events"))

    def post(webhook: str, payload: str, signature: str) -> int:
        seen.write_text(f"{webhook} {signature[:7]}")
        return 200

    sinks.deliver(spark.readStream.schema(schema).parquet(str(tmp_path / "events")), "s", post, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert seen.read_text() == "w1 sha256="


def test_paths_are_flattened(spark):
    docs = spark.createDataFrame([({"/v1/chat": {"post": "Chat", "get": None}, "/": {"get": "Home"}},)], "paths map<string, map<string, string>>")
    assert {tuple(r) for r in shape.flattened(docs, "paths").collect()} == {("v1", "/v1/chat", "POST", "Chat"), ("v1", "/v1/chat", "GET", "/v1/chat"), ("root", "/", "GET", "Home")}


def test_times_and_maps_with_nulls(spark):
    rows = spark.createDataFrame([(1, None), (2, 3), (3, 0)], "id int, n int")
    assert sorted((r.id, r["index"]) for r in shape.times(rows, "n").collect()) == [(1, 0), (2, 0), (2, 1), (2, 2)]
    maps = spark.createDataFrame([({"a": 1}, {"a": 2, "b": 3}), (None, {"a": 1}), ({"a": 1}, None)], "x map<string, int>, y map<string, int>")
    assert [r.m for r in maps.select(shape.merged_maps(F.col("x"), F.col("y")).alias("m")).collect()] == [{"a": 2, "b": 3}, {"a": 1}, {"a": 1}]


def test_keys_need_a_secret(spark):
    t = spark.createDataFrame([("r1", "pending_approval")], "request_id string, status string")
    with pytest.raises(ValueError):
        store.approve(t, "request_id", "")
    one, two = (store.approve(t, "request_id", s)[0].first() for s in ("a", "b"))
    assert one.key_id != two.key_id and one.hashed_key != two.hashed_key and one.key_id[4:] not in one.hashed_key


def test_sessions_over_days(spark):
    import random

    pick = random.Random(4)
    start = dt.datetime(2024, 1, 1, 22)
    rows = [(k, start + dt.timedelta(minutes=pick.randrange(0, 4000))) for k in ("a", "b", None) for _ in range(120)]
    rows += [("c", start + dt.timedelta(minutes=20 * n)) for n in range(300)]  # one session of four days
    rows += [("d", start), ("d", start), ("d", start + dt.timedelta(minutes=30)), ("d", None)]
    t = spark.createDataFrame(rows, "k string, t timestamp")
    gap, want = dt.timedelta(minutes=30), []
    for k in ("a", "b", None, "c", "d"):
        at = sorted(x for key, x in rows if key == k and x is not None)
        runs = [[at[0]]]
        for x in at[1:]:
            if x - runs[-1][-1] >= gap:
                runs.append([])
            runs[-1].append(x)
        want += [(k, r[0], r[-1] + gap, len(r)) for r in runs]
    assert sorted(map(str, (tuple(r) for r in metering.sessions(t, "t", "30 minutes", "k").collect()))) == sorted(map(str, want))


@pytest.fixture
def small_tables(spark, tmp_path):
    """Writes tables of the driver's kinds to a folder; says their path and a DuckDB session with them."""
    import duckdb

    def put(**tables):
        c = duckdb.connect()
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/{name}.parquet")
            c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        return f"file://{tmp_path}", c

    return put


def test_requests_that_share_a_key_id_come_once(spark, small_tables):
    from meterlake.plans import catalog
    from tests.conftest import rows_of

    # the first two make the same key_id; an id that repeats, and none
    ids = [381846, 915026, 7, 7, None, 8]
    folder, duck = small_tables(
        orders=([(k, 3, "F" if k == 8 else "P") for k in ids], "o_orderkey long, o_custkey long, o_orderstatus string"), supplier=([(4, "four")], "s_suppkey long, s_name string")
    )
    got = catalog.QUERIES["q10_approve_flow"](spark, folder).toPandas()
    assert rows_of(got) == rows_of(duck.execute(catalog.ORACLE_SQL["q10_approve_flow"]).df()) and len(got) == 5
    assert got.key_id[got.request_id.isin(ids[:2])].nunique() == 1


def test_every_user_has_a_bill_of_their_own(spark, small_tables):
    from meterlake.plans import catalog
    from tests.conftest import rows_of

    rows = [(dt.datetime(2024, m, 5), u, v) for m in (1, 2) for u in (1, 2, None) for v in (1490.0, 16.0 * m, None)] + [(dt.datetime(2024, 1, 6), 4, None)]
    folder, duck = small_tables(events=(rows, "ts timestamp_ntz, user_id long, value double"))
    got = catalog.QUERIES["q28_metered_billing"](spark, folder).toPandas()
    assert rows_of(got) == rows_of(duck.execute(catalog.ORACLE_SQL["q28_metered_billing"]).df()) and len(got) == 7
    assert set(got[got.user_id == 2].amount) == {"300.0000", "450.0000"}
