"""Requests with rejects, bundles, indexed search, sketches, pages, variants, signatures and bucketed tables: odd rows and plans."""

import datetime as dt
import hashlib
import hmac
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.functions import signing
from meterlake.operators import gate, keyed, metrics, paging, search, sketches
from meterlake.sources import bundle, intake, variants
from tests.conftest import DATA


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def scanned(df) -> int:
    """Rows that the file scans of df have given, once it is collected."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            node = node.executedPlan()
        if "QueryStage" in node.nodeName():
            node = node.plan()
        if node.nodeName().startswith("Scan "):
            total += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return total


def test_rejects_say_why(spark):
    schema = "model STRING, n BIGINT, tags ARRAY<STRING>, inner STRUCT<a: INT>"
    bodies = [
        (1, '{"model":"m","n":1}'), (2, '{"n":9}'), (3, "{cut"), (4, None), (5, ""), (6, "[]"), (7, '"text"'), (8, "{}"), (9, '{"model":"m","n":"two"}'), (10, '{"model":"m","n":null,"more":1}'),
        (11, '{"model":"m","tags":"x"}'), (12, ' {"model":"m","inner":{"a":1}}'), (12, ' {"model":"m","inner":{"a":1}}'), (13, "null"), (14, '{"model":"m"} {"model":"m"}'),
    ]
    rows = spark.createDataFrame([(*b, "clash") for b in bodies], "id int, body string, _corrupt string")
    good, dead, counts = intake.routed(rows, "body", schema, {"n": gate.within(F.col("request.n"), 1, 5)}, ("model",))
    assert sorted(r.id for r in good.collect()) == [1, 10, 12, 12, 14]
    why = {r.id: list(r.reasons) for r in dead.collect()}
    assert why == {2: ["missing model", "n"], 8: ["missing model"], **{k: ["malformed"] for k in (3, 4, 5, 6, 7, 9, 11, 13)}}
    assert counts == {"requests": 15, "accepted": 5, "malformed": 8} and dead.columns == ["id", "body", "_corrupt", "reasons"]
    good, dead, counts = intake.routed(rows.limit(0), "body", schema, {}, ("model",))
    assert (good.count(), dead.count(), counts["requests"]) == (0, 0, 0) and "request" in good.columns


def test_requests_are_scanned_once(spark):
    rows = spark.read.parquet(f"{DATA}/events.parquet")
    told = intake.typed(rows, "props", "k BIGINT", {"k": F.col("request.k") > 10})
    assert plan(told).split("Physical Plan")[1].count("FileScan parquet") == 1
    good, dead, counts = intake.routed(rows, "props", "k BIGINT", {"k": F.col("request.k") > 10})
    assert good.count() == counts["accepted"] and dead.count() == rows.count() - counts["accepted"]
    assert all("accepted=true" in f for f in good.inputFiles())


def test_bundle_equals_one_made_by_hand(spark, tmp_path):
    rows = [(f"src/{k % 7}/f{k:03d}{random.Random(k).choice(['.py', '.html', '.md', ''])}", f"text {k} é\n" * (k % 5)) for k in range(200)] + [("src/a.PY", None), (None, "x"), ("src/1/f001", "again"), ("src/1/f001", "again")]
    folder = f"file://{tmp_path}/bundle"
    got = bundle.bundled(spark.createDataFrame(rows, "path string, text string"), F.col("path"), F.col("text"), 5, folder).orderBy("place").collect()
    hand = lambda p, t: f"### File: `{p or ''}`\n\n```{'python' if (p or '').lower().endswith('.py') else 'html' if (p or '').lower().endswith('.html') else ''}\n{t or ''}\n```\n\n"
    whole = "".join(r.section for r in bundle.read_back(spark, folder).orderBy("part", "row").collect()).encode()
    assert sorted(whole.decode().split("### File")) == sorted("".join(hand(p, t) for p, t in rows).split("### File"))
    assert [r.path for r in got] == sorted((p for p, _ in rows), key=lambda p: (p is not None, p)) and [r.place for r in got] == list(range(204))
    for r in got:
        assert whole[r.offset : r.offset + r.bytes].decode().startswith(f"### File: `{r.path or ''}`\n") and whole[r.offset : r.offset + r.bytes].endswith(b"\n```\n\n")
    assert len({r.part for r in got}) > 1
    assert bundle.bundled(spark.createDataFrame([], "path string, text string"), F.col("path"), F.col("text"), 5).count() == 0


def test_bundle_of_a_tree(spark, tmp_path):
    files = {"a/x.py": b"print(1)", "a/y.html": "<p>é</p>".encode(), "skip/z.py": b"no", "b/w.log": b"no", "b/LICENSE": b"no", "b/bad.txt": b"ok\xff\xfe!", "c.txt": b""}
    for name, data in files.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    texts = bundle.texts_of(spark, f"{tmp_path}/in", ["skip"], [".log"], ["LICENSE"])
    assert {tuple(r) for r in texts.collect()} == {("a/x.py", "print(1)"), ("a/y.html", "<p>é</p>"), ("b/bad.txt", "ok!")}
    folder = f"file://{tmp_path}/out"
    got = bundle.bundled(texts, F.col("path"), F.col("text"), 2, folder).orderBy("place").collect()
    assert [r.path for r in got] == ["a/x.py", "a/y.html", "b/bad.txt"]
    whole = "".join(r.section for r in bundle.read_back(spark, folder).orderBy("part", "row").collect())
    assert whole.startswith("### File: `a/x.py`\n\n```python\nprint(1)\n```\n\n### File: `a/y.html`\n\n```html\n<p>é</p>\n```\n\n")


def test_indexed_search(spark):
    pick = random.Random(1)
    texts = ["".join(pick.choices("abcdefgh ", k=300)) for _ in range(1500)]
    texts[777] += " NeedLe äÖx"
    texts[3] = None
    texts[4] = ""
    texts[5] = "ne"
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    index = search.build_index(rows, "id", "text")
    for needle in ("needle", "ÄöX", "abcd", "ab", "", "zzz", "c", "a b", "edle ä"):
        assert sorted(r.id for r in search.holding(spark, index, needle).collect()) == [k for k, t in enumerate(texts) if t is not None and needle.lower() in t.lower()]
    assert scanned(search.holding(spark, index, "needle")) <= 4 * search.BLOCK_ROWS
    empty = search.build_index(rows.limit(0), "id", "text")
    assert search.holding(spark, empty, "needle").count() == 0


def test_blocks_in_any_order_have_their_bits(spark, tmp_path):
    blocks = [2**31 + 7, 2**31 + 8, 3, 3, 5, 4, 600, 2**31 + 6, 9]
    rows = spark.createDataFrame([(b, f"text{k}") for k, b in enumerate(blocks)], "block long, low string").coalesce(1)
    index = search.TrigramIndex("", f"file://{tmp_path}/postings", "", "")
    rows.mapInPandas(search.bitmaps, search.POSTINGS).write.parquet(index.postings)
    for k, b in enumerate(blocks):
        assert b in {r.block for r in search.candidate_blocks(spark, index, f"text{k}").collect()}
    assert {r.block for r in search.candidate_blocks(spark, index, "text").collect()} == set(blocks)


def test_many_blocks_are_joined(spark, monkeypatch):
    monkeypatch.setattr(search, "MAX_BLOCKS", 3)
    rows = spark.createDataFrame([(k, f"text of number {k}") for k in range(300)], "id long, text string")
    assert search.holding(spark, search.build_index(rows, "id", "text"), "number 1").count() == 111


def test_ranges_hold_all_blocks():
    blocks = sorted(random.Random(2).sample(range(10_000), 500))
    for most in (1, 2, 50, 1000):
        got = search.ranges_of(blocks, most)
        assert len(got) <= most and all(any(a <= b <= z for a, z in got) for b in blocks)
    assert search.ranges_of([1, 2, 3, 9], 2) == [(1, 3), (9, 9)]


def test_sketches_of_days_make_months(spark):
    pick = random.Random(3)
    rows = [(dt.datetime(2024, 1 + k % 2, 1 + k % 28), pick.choice("ab"), pick.randrange(5000), pick.lognormvariate(3, 2)) for k in range(40_000)]
    rows += [(None, "a", 1, 2.0), (dt.datetime(2024, 1, 5), "c", None, None), (dt.datetime(2024, 1, 5), None, 7, 1.0)]
    t = spark.createDataFrame(rows, "ts timestamp, k string, caller long, latency double")
    days = sketches.daily(t, "ts", ["k"], "caller", "latency")
    months = sketches.read_out(sketches.rolled_up(days, "k", F.trunc("day", "month").alias("month")), 0.5, 0.99)
    direct = {r.k: r for r in sketches.read_out(sketches.rolled_up(days, "k"), 0.5).collect()}
    for r in months.collect():
        mine = [x for x in rows if x[0] and x[1] == r.k and r.month and x[0].month == r.month.month]
        if not r.month:
            assert r.calls == 1
            continue
        callers, values = {x[2] for x in mine if x[2] is not None}, sorted(x[3] for x in mine if x[3] is not None)
        assert r.calls == len(mine) and abs(r.distinct - len(callers)) <= 0.05 * len(callers)
        assert (r.p50 is None) == (not values)
        for share, value in ((0.5, r.p50), (0.99, r.p99)) if values else ():
            assert abs(sum(v <= value for v in values) / len(values) - share) <= 0.02 + 1 / len(values)
    assert direct["a"].calls == sum(x[1] == "a" for x in rows)


def test_pages(spark):
    rows = [(None if k % 50 == 0 else k // 3, k, f"v{k}") for k in range(1003)]
    t = spark.createDataFrame(rows, "a long, b long, v string")
    folder, pages = paging.paged(t, ["a", "b"], 100, parts=7)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for n in (0, 1, 5, 10, 11, 99):
        assert sorted(str(tuple(r)) for r in paging.page(folder, pages, ["a", "b"], n).collect()) == sorted(map(str, order[n * 100 : n * 100 + 100]))
    last, seen = None, []
    while some := [tuple(r) for r in paging.following(t, ["a", "b"], last, 300).collect()]:
        seen += some
        last = some[-1][:2]
    assert seen == order
    assert paging.page(*paging.paged(t.limit(0), ["a", "b"], 10), ["a", "b"], 0).count() == 0


def test_a_late_page_is_as_cheap_as_the_first(spark):
    t = spark.range(200_000).select((F.col("id") * 7 % 200_003).alias("k"), F.lit("x").alias("v"))
    folder, pages = paging.paged(t, ["k"], 25, parts=20)
    late = paging.page(folder, pages, ["k"], 7900)
    assert late.count() == 25 and scanned(paging.page(folder, pages, ["k"], 7900)) <= 20_000
    assert "Sort" not in plan(late).split("Physical Plan")[1] and "Exchange" not in plan(late).split("Physical Plan")[1]
    assert "TakeOrderedAndProject" in plan(paging.following(t, ["k"], (9,), 25))


def test_variants_of_both_forms(spark):
    bodies = ['{"input":"a"}', '{"input":["a",1,null,{"x":[1]}]}', '{"input":[]}', '{"input":null}', "{}", '{"input":7}', '{"input":{"b":1,"a":2}}', "no json", None, "[1]"]
    rows = variants.parsed(spark.createDataFrame(list(enumerate(bodies)), "id int, body string"), "body")
    got = [(r.id, r["index"], r.input) for r in variants.inputs(rows, "request", "input").orderBy("id", "index").collect()]
    assert got == [(0, 0, "a"), (1, 0, "a"), (1, 1, "1"), (1, 2, "null"), (1, 3, '{"x":[1]}'), (5, 0, "7"), (6, 0, '{"a":2,"b":1}')]
    drift = {(r.kind, r.requests) for r in variants.drift(rows, "request", ["input"]).collect()}
    assert drift == {("string", 1), ("array", 2), ("null", 1), ("missing", 2), ("bigint", 1), ("object", 1)}
    schema = variants.schemas(rows.where("id < 6"), "request").first()
    assert "input: VARIANT" in schema.schema and schema.requests == 6


PAYLOAD = "b struct<y: string, x: array<int>>, a long, ok boolean, m map<string, decimal(10,3)>, s string"


def test_signatures_are_those_of_the_library(spark):
    import decimal

    texts = ["plain", "", 'quote " and \\ slash', "é ü 中", "\U0001f600 and \U00010000", "\x00\x01\x1f\x7f\x80\t\n\r\f\b/", " ￿", None]
    rows = [((t, [1, None, -3]), 2**62, k % 2 == 0, {t or "k": decimal.Decimal("1.500"), "Z": decimal.Decimal("20"), "é": None}, t) for k, t in enumerate(texts)] + [(None, None, None, None, None), (("x", None), 0, True, {}, "y")]
    frame = spark.createDataFrame(rows, PAYLOAD)
    kind = frame.schema
    whole = F.struct(*kind.names)
    for secret in ("s", "long " * 30, b"\x00\xff"):
        got = frame.select("*", signing.canonical_json(whole, kind).alias("text"), signing.signature(whole, kind, secret).alias("sig")).collect()

        def plain(v):
            if isinstance(v, decimal.Decimal):
                return int(v) if v == v.to_integral() else float(v)
            if isinstance(v, dict):
                return {k: plain(x) for k, x in v.items()}
            return v.asDict() if hasattr(v, "asDict") else v

        for r in got:
            text = json.dumps({c: plain(r[c]) for c in kind.names}, sort_keys=True)
            key = secret.encode() if isinstance(secret, str) else secret
            assert r.text == text and r.sig == "sha256=" + hmac.new(key, text.encode(), hashlib.sha256).hexdigest()
    assert frame.select(signing.signature(F.lit(None).cast(kind), kind, "s").alias("x")).first().x is None
    with pytest.raises(TypeError):
        signing.canonical_json(F.lit(1.5), T.DoubleType())
    assert "Python" not in plan(frame.select(signing.signature(whole, kind, "s"))).split("Physical Plan")[1]


def test_bucketed_updates_do_not_move_the_table(spark):
    name = f"t_{uuid.uuid4().hex}"
    rows = spark.range(5000).select("id", (F.col("id") * 2).alias("v"), F.lit("a").alias("w"))
    keyed.create(rows, name, "id", 8)
    changes = spark.createDataFrame([(1, 10, None, 1, False), (1, 11, "b", 2, False), (7000, 5, "n", 1, False), (2, None, None, 1, True), (None, 1, "x", 1, False), (9000, 1, "x", 1, True)], "id long, v long, w string, version int, gone boolean")
    out = keyed.updated(spark, name, changes, "id", version="version", deleted="gone")
    got = {r.id: (r.v, r.w) for r in out.collect()}
    assert len(got) == 5000 and got[1] == (11, "b") and got[7000] == (5, "n") and 2 not in got and got[3] == (6, "a")
    big = spark.range(5000).select("id", F.lit(1).cast("long").alias("v"))
    with_conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in with_conf}
    try:
        for k, v in with_conf.items():
            spark.conf.set(k, v)
        text = keyed.updated(spark, name, big, "id", insert=False)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    scan = text[: text.index("FileScan")] if text.index("FileScan") < text.index("Exchange") else text
    assert "SortMergeJoin" in text and "Bucketed: true" in text and "Exchange" not in scan.split("SortMergeJoin")[1] and text.count("Exchange") == 1
    kept = keyed.updated(spark, name, changes.where("id = 7000"), "id", insert=False)
    assert kept.count() == 5000
    spark.sql(f"DROP TABLE {name}")


def test_update_through_another_column(spark):
    users = spark.createDataFrame([(1, "a@x", "old"), (2, "a@x", "old"), (3, None, "old"), (4, "b@x", "old")], "user_id long, email string, hash string")
    news = spark.createDataFrame([("a@x", "new1"), ("a@x", "new2"), ("c@x", "new"), (None, "new")], "email string, hash string")
    assert {r.user_id: r.hash for r in keyed.update_by(users, news, "email", "user_id", ["hash"]).collect()} == {1: "new2", 2: "old", 3: "old", 4: "old"}


def test_exact_quantiles_lie_by_the_sketched(spark):
    rows = spark.range(10_000).select(F.lit("a").alias("k"), F.rand(1).alias("v"))
    exact, near = metrics.quantiles(rows, ["k"], "v", 0.5).first().p50, metrics.approximate_quantiles(rows, ["k"], "v", 0.5).first().p50
    assert abs(exact - near) < 0.01


def test_made_folders_and_tables_can_be_dropped(spark):
    from meterlake.session import drop_made, exists, new_folder, new_table

    path, name = new_folder(spark, "x"), new_table(spark, "x")
    spark.range(3).write.parquet(path)
    spark.range(3).write.saveAsTable(name)
    assert exists(spark, path) and drop_made(spark) >= 2
    assert not exists(spark, path) and not spark.catalog.tableExists(name) and drop_made(spark) == 0
