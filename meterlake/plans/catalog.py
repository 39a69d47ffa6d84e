"""The query catalogue: every query with the DuckDB statement that gives the same rows.

The driver's tables stand in for the collections: events for request and audit logs (user_id the
tenant, event_type the API, value the latency), customer for users, nation for tenants, supplier for
keys, part for models, orders for jobs and payments, lineitem for usage. The queries of live and stores register as they are imported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions import scalar
from meterlake.operators import gate, metering, metrics, shape, store
from meterlake.plans import live, stores
from meterlake.plans.registry import ORACLE_SQL, QUERIES, query
from meterlake.session import exists, new_folder, table
from meterlake.sources import readers
from meterlake.streaming import jobs

__all__ = ["ORACLE_SQL", "QUERIES", "live", "stores"]


@query("SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 100")
def q01_recent_logs(spark: SparkSession, d: str) -> DataFrame:
    return store.recent(table(spark, d, "events").select("event_id", "ts", "user_id", "event_type"), "ts", "event_id", 100)


@query(
    "SELECT event_id, ts, event_type, value FROM events WHERE event_type IN ('purchase', 'error') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' "
    "ORDER BY ts DESC, event_id LIMIT 25 OFFSET 25"
)
def q02_api_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where(F.col("event_type").isin("purchase", "error") & F.expr("ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-01-20'"))
    return store.page(rows.select("event_id", "ts", "event_type", "value"), [F.col("ts").desc(), F.col("event_id")], number=1)


@query("SELECT * FROM orders WHERE o_orderkey = 77")
def q03_find_one(spark: SparkSession, d: str) -> DataFrame:
    return store.find_one(table(spark, d, "orders"), o_orderkey=77)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def q04_find_eq(spark: SparkSession, d: str) -> DataFrame:
    return store.find_eq(table(spark, d, "orders"), o_orderstatus="P").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier ORDER BY s_suppkey LIMIT 100")
def q05_exclude_projection(spark: SparkSession, d: str) -> DataFrame:
    return store.exclude(table(spark, d, "supplier"), "s_acctbal").orderBy("s_suppkey").limit(100)


@query("SELECT p_brand, p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1")
def q06_first_match(spark: SparkSession, d: str) -> DataFrame:
    return store.first_match(table(spark, d, "part").select("p_brand", "p_partkey", "p_name"), ["p_brand"], ["p_partkey"])


@query(
    "SELECT c_custkey, CASE WHEN c_custkey % 20 = 0 THEN 'disabled' ELSE c_name END AS c_name, c_nationkey, c_acctbal, "
    "CASE WHEN c_custkey % 10 = 0 THEN 'ADMIN' ELSE c_mktsegment END AS c_mktsegment FROM customer"
)
def q07_set_update(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer")
    changes = users.where("c_custkey % 10 = 0").select("c_custkey", F.when(F.col("c_custkey") % 20 == 0, "disabled").alias("c_name"), F.lit("ADMIN").alias("c_mktsegment"))
    return store.set_fields(users, changes, "c_custkey")


@query(
    "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation "
    "UNION ALL SELECT n_nationkey + 100, lower(n_name), n_regionkey FROM nation WHERE n_nationkey < 5"
)
def q08_upsert(spark: SparkSession, d: str) -> DataFrame:
    tenants = table(spark, d, "nation")
    few = tenants.where("n_nationkey < 5").withColumn("n_name", F.lower("n_name"))
    return store.upsert(tenants, few.unionByName(few.withColumn("n_nationkey", (F.col("n_nationkey") + 100).cast("int"))), "n_nationkey")


@query("SELECT * FROM nation WHERE n_regionkey <> 2")
def q09_delete(spark: SparkSession, d: str) -> DataFrame:
    tenants = table(spark, d, "nation")
    return store.delete(tenants, tenants.where("n_regionkey = 2"), "n_nationkey")


#: The secret that keys of the catalogue's queries are made with, so that a statement can give them too; a service has its own.
SECRET = "catalogue"
_PLAIN = f"('mk_' || sha256('{SECRET}:' || {{id}}))"
_KEY = f"('key_' || left(sha256(sha256({_PLAIN})), 10))"


@query(
    f"SELECT o_orderkey AS request_id, {_KEY.format(id='o_orderkey')} AS key_id, s_name AS tenant FROM orders "
    "JOIN supplier ON s_suppkey = o_custkey % 10 + 1 WHERE o_orderstatus = 'P'"
)
def q10_approve_flow(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderstatus") == "P", "pending_approval").otherwise("closed").alias("status"), "o_custkey")
    keys, done = store.approve(asked, "request_id", SECRET)
    # a key_id has 40 bits, so among millions of requests some share one: a request goes with its own key, and once
    made = keys.select(F.col("request_id").alias("_request"), "key_id")
    granted = done.where("status = 'approved'").join(made, F.col("request_id").eqNullSafe(F.col("_request")) & F.col("approved_key_id").eqNullSafe(F.col("key_id")), "left_semi")
    return granted.join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("o_custkey") % 10 + 1).select("request_id", F.col("approved_key_id").alias("key_id"), F.col("s_name").alias("tenant"))


@query("SELECT p_brand AS provider, count(*) AS requests FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 25 GROUP BY p_brand")
def q11_alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    aliases = table(spark, d, "part").where("p_size <= 25").select("p_partkey", F.col("p_brand").alias("provider"))
    found = gate.resolve_alias(table(spark, d, "lineitem").select("l_partkey"), aliases, F.col("l_partkey") == F.col("p_partkey"))
    return metrics.counter(found, "provider")


@query("SELECT l_returnflag, count(*) AS requests FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25) GROUP BY l_returnflag")
def q12_alias_reject(spark: SparkSession, d: str) -> DataFrame:
    aliases = table(spark, d, "part").where("p_size <= 25").select("p_partkey")
    return metrics.counter(gate.unresolved(table(spark, d, "lineitem").select("l_partkey", "l_returnflag"), aliases, F.col("l_partkey") == F.col("p_partkey")), "l_returnflag")


@query(
    "SELECT c_custkey, c_nationkey, coalesce(s.status = 'enabled', true) AS enabled FROM customer LEFT JOIN "
    "(SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'disabled' ELSE 'enabled' END AS status FROM nation WHERE n_nationkey < 20) s ON c_nationkey = n_nationkey"
)
def q13_endpoint_gate(spark: SparkSession, d: str) -> DataFrame:
    flags = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_regionkey") == 1, "disabled").otherwise("enabled").alias("status"))
    return gate.endpoint_gate(table(spark, d, "customer").select("c_custkey", "c_nationkey"), flags, "c_nationkey")


@query(
    "SELECT s_suppkey, (167772160 + s_suppkey * 97)::BIGINT AS ip FROM supplier WHERE (167772160 + s_suppkey * 97) BETWEEN 167772160 AND 167773183 "
    "OR (167772160 + s_suppkey * 97) BETWEEN 167776256 AND 167780351"
)
def q14_cidr_range(spark: SparkSession, d: str) -> DataFrame:
    networks = gate.cidr_bounds(readers.constant(spark, [("10.0.0.0/22",), ("10.0.16.0/20",), ("192.168.0.0/16",)], "cidr string"))
    callers = table(spark, d, "supplier").select("s_suppkey", (F.lit(167772160) + F.col("s_suppkey") * 97).cast("long").alias("ip"))
    return gate.in_networks(callers, "ip", networks)


@query(
    "SELECT s_suppkey, address, CASE WHEN s_suppkey % 7 <> 0 THEN (s_suppkey % 256) * 16777216 + 65536 + 512 + s_suppkey % 200 END::BIGINT AS number, "
    "CASE WHEN s_suppkey % 7 <> 0 THEN (s_suppkey % 256) * 16777216 + 65536 + 512 END::BIGINT AS network "
    "FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN '256.1.1.1' ELSE (s_suppkey % 256) || '.1.2.' || (s_suppkey % 200) END AS address FROM supplier)"
)
def q15_cidr_mask(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("s_suppkey")
    address = F.when(n % 7 == 0, "256.1.1.1").otherwise(F.concat((n % 256).cast("string"), F.lit(".1.2."), (n % 200).cast("string")))
    rows = table(spark, d, "supplier").select("s_suppkey", address.alias("address"))
    return rows.select("s_suppkey", "address", scalar.ipv4_number(F.col("address")).alias("number"), scalar.ipv4_network(F.col("address"), 24).alias("network"))


@query(
    "SELECT conv_id, turn, starts_with(header, 'Bearer ') AND length(trim(replace(header, 'Bearer ', ''), chr(32) || chr(9) || chr(10) || chr(13))) >= 8 AS accepted FROM "
    "(SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Bearer ' || left(text, 5 + (length(text) % 6)::INT) WHEN 'assistant' THEN 'Basic ' || text ELSE 'Bearer Bearer  ' || right(text, 9) || '  ' END AS header FROM conversations)"
)
def q16_bearer_check(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    header = F.when(F.col("role") == "user", F.concat(F.lit("Bearer "), F.substring(text, F.lit(1), 5 + F.length(text) % 6))).when(F.col("role") == "assistant", F.concat(F.lit("Basic "), text))
    header = header.otherwise(F.concat(F.lit("Bearer Bearer  "), F.right(text, F.lit(9)), F.lit("  ")))
    return table(spark, d, "conversations").select("conv_id", "turn", gate.bearer_ok(header).alias("accepted"))


@query(
    "SELECT l_quantity BETWEEN 1 AND 40 AND l_discount BETWEEN 0 AND 0.05 AND l_returnflag IN ('A', 'N') AS valid, count(*) AS requests FROM lineitem GROUP BY 1"
)
def q17_validate_ranges(spark: SparkSession, d: str) -> DataFrame:
    valid = gate.within(F.col("l_quantity"), 1, 40) & gate.within(F.col("l_discount"), 0, 0.05) & F.col("l_returnflag").isin("A", "N")
    return metrics.counter(table(spark, d, "lineitem"), valid.alias("valid"))


@query("SELECT event_type, user_id % 5 AS endpoint, count(*) AS requests FROM events GROUP BY ALL")
def q18_request_counter(spark: SparkSession, d: str) -> DataFrame:
    return metrics.counter(table(spark, d, "events"), "event_type", (F.col("user_id") % 5).alias("endpoint"))


@query(
    "SELECT event_type, le, cumulative, round(total, 4) AS total, n FROM (SELECT event_type, le::DOUBLE AS le, count(*) FILTER (WHERE value <= le) AS cumulative, sum(value) AS total, count(value) AS n "
    "FROM events, (VALUES (5::DOUBLE), (10), (25), (50), (100), (250), (500), ('inf'::DOUBLE)) b(le) GROUP BY event_type, le)"
)
def q19_latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(table(spark, d, "events"), ["event_type"], "value", [5, 10, 25, 50, 100, 250, 500]).withColumn("total", F.round("total", 4))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def q20_latency_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.quantiles(table(spark, d, "events"), ["event_type"], "value", 0.5, 0.95).select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


_MOVES = (
    "SELECT user_id, event_id, ts AS moved, 1 AS delta FROM events UNION ALL SELECT user_id, event_id, ts + INTERVAL 6 HOUR, -1 FROM events"
)


@query(
    f"SELECT user_id, event_id, moved, delta, sum(delta) OVER (PARTITION BY user_id ORDER BY moved, delta, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM ({_MOVES})"
)
def q21_inflight_gauge(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "events").withColumn("done", F.expr("ts + INTERVAL 6 HOURS"))
    return metrics.in_flight(spans, "user_id", "ts", "done", "event_id").withColumnRenamed("at", "moved").withColumn("running", F.col("running").cast("long"))


@query("SELECT count(*) FILTER (WHERE event_id % 7 = 1) AS unauthorized, count(*) FILTER (WHERE event_id % 7 = 2) AS limited, count(*) AS requests FROM events")
def q22_status_counters(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_id") % 7 == 1, 401).when(F.col("event_id") % 7 == 2, 429).otherwise(200)
    return metrics.status_counters(table(spark, d, "events"), status)


@query("SELECT event_type, max(ts) AS last_called, round(avg(value), 4) AS avg_latency, round(count(*) / 2592000.0::DOUBLE, 6) AS rps FROM events GROUP BY event_type")
def q23_alias_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.alias_stats(table(spark, d, "events"), "event_type", "ts", "value", F.lit(2592000.0))


@query(
    "SELECT conv_id, coalesce(sum(n) FILTER (WHERE role <> 'assistant'), 0)::BIGINT AS prompt_tokens, coalesce(sum(n) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS completion_tokens, "
    "sum(n)::BIGINT AS total_tokens FROM (SELECT conv_id, role, (length(text) + 3) // 4 AS n FROM conversations) GROUP BY conv_id"
)
def q24_token_usage(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "role", F.expr("(length(text) + 3) div 4").alias("n"))
    mine = F.col("role") == "assistant"
    sums = turns.groupBy("conv_id").agg(
        F.coalesce(F.sum(F.when(~mine, F.col("n"))), F.lit(0)).cast("long").alias("prompt_tokens"), F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0)).cast("long").alias("completion_tokens")
    )
    return sums.withColumn("total_tokens", scalar.total_tokens(F.col("prompt_tokens"), F.col("completion_tokens")))


@query("SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, user_id, count(*) AS requests FROM events GROUP BY ALL")
def q25_rpm_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return metering.tumbling(table(spark, d, "events"), "ts", "1 minute", "user_id")


@query(
    "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS recent FROM events"
)
def q26_rpm_sliding(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return metering.sliding(table(spark, d, "events"), seconds, 3600, "user_id").select("event_id", "user_id", "recent")


@query(
    "SELECT w AS window_start, user_id, count(*) AS requests FROM (SELECT user_id, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY ALL"
)
def q27_rpm_hop(spark: SparkSession, d: str) -> DataFrame:
    return metering.hopping(table(spark, d, "events"), "ts", "60 minutes", "30 minutes", "user_id")


@query(
    "SELECT strftime(ts, '%Y-%m') AS month, user_id, sum(ceil(value / 15))::BIGINT AS units, "
    "(greatest(sum(ceil(value / 15))::BIGINT - 100, 0) * 150.0000::DECIMAL(12,4))::DECIMAL(24,4)::VARCHAR AS amount FROM events GROUP BY ALL"
)
def q28_metered_billing(spark: SparkSession, d: str) -> DataFrame:
    _, price = metering.PRICES["api_stt"]
    bill = metering.metered_bill(table(spark, d, "events"), F.date_format("ts", "yyyy-MM"), F.ceil(F.col("value") / 15), 100, price, "user_id")
    return bill.withColumn("amount", F.col("amount").cast("string"))


@query(
    "SELECT p_brand, sum(l_quantity::DECIMAL(18,4) * p_retailprice::DECIMAL(18,4))::DECIMAL(38,4)::VARCHAR AS cost FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"
)
def q29_price_join(spark: SparkSession, d: str) -> DataFrame:
    usage, prices = table(spark, d, "lineitem").select("l_partkey", "l_quantity"), table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    return metering.price_by(usage, prices, F.col("l_partkey") == F.col("p_partkey"), "p_brand", "l_quantity", "p_retailprice").withColumn("cost", F.col("cost").cast("string"))


@query(
    "SELECT n_name, c_mktsegment, sum(c_acctbal::DECIMAL(18,2))::DECIMAL(38,2)::VARCHAR AS amount, count(*) AS accounts FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "GROUP BY ROLLUP (n_name, c_mktsegment)"
)
def q30_chargeback(spark: SparkSession, d: str) -> DataFrame:
    accounts = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return metering.chargeback(accounts, ["n_name", "c_mktsegment"], "c_acctbal").withColumn("amount", F.col("amount").cast("string"))


@query("SELECT o_orderpriority AS job_type, o_orderstatus AS status, count(*) AS requests FROM orders GROUP BY ALL")
def q31_job_states(spark: SparkSession, d: str) -> DataFrame:
    return metrics.counter(table(spark, d, "orders"), F.col("o_orderpriority").alias("job_type"), F.col("o_orderstatus").alias("status"))


@query("SELECT toxic AS flagged, count(*) AS requests FROM documents LEFT JOIN labels USING (doc_id) GROUP BY toxic")
def q32_moderation_flags(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", F.col("toxic").alias("flagged"))
    return metrics.counter(table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left"), "flagged")


@query(
    "SELECT conv_id, turn, i - 1 AS index, parts[i] AS input FROM (SELECT conv_id, turn, string_split(text, '. ') AS parts, unnest(range(1, len(string_split(text, '. ')) + 1)) AS i FROM conversations)"
)
def q33_posexplode_inputs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.to_json(F.split("text", r"\. ")).alias("body"))
    return readers.inputs_of(rows, "body").select("conv_id", "turn", F.col("index").cast("long").alias("index"), "input")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, (props->>'$.k')::BIGINT AS v FROM events")
def q34_json_path(spark: SparkSession, d: str) -> DataFrame:
    rows = readers.untyped(table(spark, d, "events").select("event_id", "props"), "props")
    return rows.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.try_variant_get("request", "$.k", "bigint").alias("v"))


@query("SELECT c_custkey, left(c_name, 12) || '...' AS prefix, right(c_name, 10) AS suffix, left(c_name, 4) || repeat('*', 28) AS masked FROM customer")
def q35_key_prefix_mask(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", scalar.key_prefix(key).alias("prefix"), scalar.key_suffix(key).alias("suffix"), scalar.mask_key(key).alias("masked"))


@query("SELECT c_custkey, sha256(c_name) AS hashed FROM customer")
def q36_sha256(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("hashed"))


@query("SELECT event_id, left(strftime(ts, '%Y%m%d%H%M%S%f'), 18) AS log_id FROM events")
def q37_log_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", scalar.log_id(F.col("ts")).alias("log_id"))


@query("SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M') AS created FROM events")
def q38_fmt_minutes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", scalar.minute_text(F.col("ts")).alias("created"))


@query("SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN event_type END, ''), 'default') AS api FROM events")
def q39_coalesce_or(spark: SparkSession, d: str) -> DataFrame:
    given = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.col("event_type"))
    return table(spark, d, "events").select("event_id", scalar.or_default(given, F.lit("default")).alias("api"))


@query("SELECT doc_id, source FROM documents WHERE contains(lower(concat_ws(' ', source, text)), lower('License'))")
def q40_text_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.contains(F.lower(F.concat_ws(" ", "source", "text")), F.lower(F.lit("License")))).select("doc_id", "source")


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS bytes FROM documents")
def q41_octet_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT page_id, string_split(trim(url, '/'), '/')[3] AS host, len(string_split(trim(url, '/'), '/'))::BIGINT AS parts FROM pages")
def q42_url_path(spark: SparkSession, d: str) -> DataFrame:
    parts = scalar.path_parts(F.col("url"))
    return table(spark, d, "pages").select("page_id", parts[2].alias("host"), F.size(parts).cast("long").alias("parts"))


@query(
    "WITH s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM "
    "(SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE)::INT, 1) AS new FROM events)) "
    "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS requests FROM s GROUP BY user_id, k"
)
def q43_session_gap(spark: SparkSession, d: str) -> DataFrame:
    return metering.sessions(table(spark, d, "events"), "ts", "30 minutes", "user_id")


@query(
    "SELECT e.event_id, e.user_id, p.event_id AS last_login FROM (SELECT * FROM events WHERE event_type = 'purchase') e "
    "ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p ON e.user_id = p.user_id AND e.ts >= p.ts"
)
def q44_as_of_join(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    bought, seen = rows.where("event_type = 'purchase'"), rows.where("event_type = 'view'")
    return metering.as_of(bought, seen, ["user_id"], "ts", "event_id", "last_login").select("event_id", "user_id", "last_login")


@query(
    "SELECT label, vec_id, round(list_inner_product(embedding::DOUBLE[], centre), 6) AS score FROM embeddings JOIN "
    "(SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS centre FROM embeddings GROUP BY label) c USING (label)"
)
def q45_vector_scores(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    centre = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("centre"))
    return vectors.join(centre, "label").select("label", "vec_id", F.round(scalar.dot(F.col("embedding"), F.col("centre")), 6).alias("score"))


def _streamed(spark: SparkSession, out: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The rows that a stream has given once all its input is read; with keys, the last that it gave for each."""
    folder = new_folder(spark, "stream")
    rows = f"{folder}/rows"
    sink = out.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if keys is None:
        sink.outputMode("append").format("parquet").option("path", rows).start().awaitTermination()
        return spark.read.schema(out.schema).parquet(rows)
    # updates, not the whole table: the watermark frees state, and a batch that is repeated replaces its folder
    sink.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{rows}/batch={n}")).start().awaitTermination()
    values = [c for c in out.columns if c not in keys]
    if not exists(spark, rows):
        return spark.createDataFrame([], out.schema)
    told = spark.read.parquet(rows).groupBy(*keys).agg(*(F.max_by(c, "batch").alias(c) for c in values))
    return told.select(*out.columns)


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    """events.parquet as a stream; the folder holds other tables, hence the filter by name."""
    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT date_trunc('hour', ts) AS window_start, user_id, count(*) AS requests FROM events GROUP BY ALL")
def q46_stream_rpm(spark: SparkSession, d: str) -> DataFrame:
    out = _streamed(spark, jobs.windowed_rate(_event_stream(spark, d), "ts", "10 minutes", "1 hour", "user_id"), ["window_start", "user_id"])
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT DISTINCT event_id // 2 AS job_key FROM events")
def q47_stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = _event_stream(spark, d).withColumn("job_key", F.expr("event_id div 2"))
    return _streamed(spark, jobs.once(rows, "job_key", "ts", "2 days").select("job_key"))


@query(
    "SELECT user_id, window_start, requests, user_id % 3 + 1 AS rpm_limit FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, user_id, count(*) AS requests FROM events GROUP BY ALL) "
    "WHERE requests > user_id % 3 + 1"
)
def q48_quota_breaches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    limits = rows.select("user_id").distinct().withColumn("rpm_limit", F.col("user_id") % 3 + 1)
    return metering.breaches(metering.tumbling(rows, "ts", "1 hour", "user_id"), limits, "user_id", "rpm_limit").select("user_id", "window_start", "requests", "rpm_limit")


@query(
    "SELECT 2 AS section, 'http_requests_total{event_type=\"' || event_type || '\",endpoint=\"' || (user_id % 5) || '\"} ' || count(*) AS line FROM events GROUP BY event_type, user_id % 5 "
    "UNION ALL SELECT 0, '# HELP http_requests_total Requests by type and endpoint.' UNION ALL SELECT 1, '# TYPE http_requests_total counter'"
)
def q49_exposition(spark: SparkSession, d: str) -> DataFrame:
    counts = q18_request_counter(spark, d)
    return metrics.exposition(counts, "http_requests_total", ["event_type", "endpoint"], "requests", "Requests by type and endpoint.")


@query("SELECT page_id, url FROM pages WHERE NOT starts_with(url, 'https') ")
def q50_maintenance_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", "url", F.when(F.col("url").startswith("https"), "/admin/x").otherwise("/v1/x").alias("path"))
    return gate.maintenance_gate(rows, True).select("page_id", "url")


@query(
    "SELECT o_orderkey AS job_id, 'jobs.' || o_orderpriority AS key, '{\"job_id\":\"' || o_orderkey || '\",\"job_type\":\"' || o_orderpriority || '\",\"payload\":' || o_custkey || '}' AS value FROM orders WHERE o_orderstatus = 'O'"
)
def q51_job_messages(spark: SparkSession, d: str) -> DataFrame:
    from meterlake.sources import sinks

    queued = store.find_eq(table(spark, d, "orders"), o_orderstatus="O")
    rows = queued.select(F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_orderpriority").alias("job_type"), F.col("o_custkey").alias("payload"))
    return sinks.envelopes(rows).select(F.get_json_object("value", "$.job_id").cast("long").alias("job_id"), "key", "value")


@query("SELECT p_partkey, list_contains(names, 'ring') OR list_contains(names, '*') AS allowed FROM (SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN ['*'] ELSE string_split(p_name, ' ') END AS names FROM part)")
def q52_alias_allowed(spark: SparkSession, d: str) -> DataFrame:
    listed = F.when(F.col("p_type") == "ECONOMY", F.array(F.lit("*"))).otherwise(F.split("p_name", " "))
    return table(spark, d, "part").select("p_partkey", gate.alias_allowed(listed, F.lit("ring")).alias("allowed"))


@query(
    "SELECT page_id, NOT starts_with(path, '/v1/') OR starts_with(path, '/v1/auth/') OR starts_with(path, '/v1/mcp') AS open FROM "
    "(SELECT page_id, replace(replace(regexp_extract(url, '^[^/]*//[^/]*(/[^?#]*)', 1), '/en/', '/v1/auth/'), '/de/', '/v1/') AS path FROM pages)"
)
def q53_open_paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.replace(F.replace(F.regexp_extract("url", "^[^/]*//[^/]*(/[^?#]*)", 1), F.lit("/en/"), F.lit("/v1/auth/")), F.lit("/de/"), F.lit("/v1/"))
    return table(spark, d, "pages").select("page_id", gate.is_open(path).alias("open"))


@query("SELECT l_orderkey, l_linenumber, unnest(range(l_quantity::INT % 5))::BIGINT AS index FROM lineitem")
def q54_expand_images(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") % 5).alias("n"))
    return shape.times(rows, "n").select("l_orderkey", "l_linenumber", F.col("index").cast("long").alias("index"))


@query(
    "SELECT conv_id, turn, conv_id::VARCHAR AS id, CASE WHEN role = 'system' THEN 'ready' WHEN role = 'user' AND contains(text, 'e') THEN 'Safe: ' || left(text, 30) END AS result, "
    "CASE WHEN role = 'assistant' OR role = 'user' AND NOT contains(text, 'e') THEN -32601 END AS error_code FROM conversations"
)
def q55_rpc_dispatch(spark: SparkSession, d: str) -> DataFrame:
    tool = F.when(F.contains("text", F.lit("e")), "moderate").otherwise("no_such_tool")
    method = F.when(F.col("role") == "system", "initialize").when(F.col("role") == "user", "tools/call").otherwise("no/such")
    body = F.to_json(F.struct(F.col("conv_id").alias("id"), method.alias("method"), F.struct(tool.alias("name"), F.struct("text").alias("arguments")).alias("params")))
    calls = table(spark, d, "conversations").select("conv_id", "turn", body.alias("body"))
    safe = F.concat(F.lit("Safe: "), F.substring(F.get_json_object("body", "$.params.arguments.text"), 1, 30))
    return shape.dispatched(calls, "body", {"initialize": F.lit("ready")}, {"moderate": safe}).select("conv_id", "turn", "id", "result", "error_code")


@query(
    "SELECT DISTINCT o_orderdate::DATE::VARCHAR AS day, dayofweek(date_trunc('month', o_orderdate))::INT AS first_weekday, day(last_day(o_orderdate::DATE))::INT AS month_days, "
    "(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DATE::VARCHAR AS next_month FROM orders"
)
def q56_calendar(spark: SparkSession, d: str) -> DataFrame:
    return shape.calendar(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct(), "day").withColumns({c: F.col(c).cast("string") for c in ("day", "next_month")})


@query("SELECT c_custkey, c_custkey % 2 = 0 AS chat, c_custkey % 3 = 0 AS speech, true AS embed FROM customer")
def q57_enabled_apis(spark: SparkSession, d: str) -> DataFrame:
    old = F.create_map(F.lit("chat"), F.lit(False), F.lit("embed"), F.lit(True))
    new = F.create_map(F.lit("chat"), F.col("c_custkey") % 2 == 0, F.lit("speech"), F.col("c_custkey") % 3 == 0)
    both = table(spark, d, "customer").select("c_custkey", shape.merged_maps(old, new).alias("apis"))
    return both.select("c_custkey", *(F.col("apis")[k].alias(k) for k in ("chat", "speech", "embed")))


@query("SELECT source, count(*) AS files, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY source")
def q58_file_totals(spark: SparkSession, d: str) -> DataFrame:
    return shape.file_totals(table(spark, d, "documents").select("source", F.octet_length("text").alias("length")), ["source"])


@query(
    "SELECT 'job_' || upper(left(sha256(o_orderkey::VARCHAR), 12)) AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'cancelled' ELSE 'queued' END AS state, 0::BIGINT AS progress FROM orders"
)
def q59_jobs(spark: SparkSession, d: str) -> DataFrame:
    made = shape.job_records(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", F.expr("TIMESTAMP '2024-01-01'"))
    done = shape.cancelled(made, made.where("o_orderkey % 3 = 0"), F.expr("TIMESTAMP '2024-01-02'"))
    return shape.shaped(done, {"job_id": "id", "status": "state", "progress": "progress"})


@query("SELECT user_id, event_id, moved AS started, running FROM (SELECT user_id, event_id, moved, delta, sum(delta) OVER (PARTITION BY user_id ORDER BY moved, delta, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM (" + _MOVES + ")) WHERE delta = 1 AND running - 1 >= 2")
def q60_over_concurrency(spark: SparkSession, d: str) -> DataFrame:
    moves = q21_inflight_gauge(spark, d).where("delta = 1").withColumn("before", F.col("running") - 1).withColumn("allowed", F.lit(2))
    return gate.over_concurrency(moves, "before", "allowed").select("user_id", "event_id", F.col("moved").alias("started"), "running")


@query(
    "SELECT user_id, window_start, requests, tokens, 200 AS tpm_limit FROM (SELECT user_id, time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, count(*) AS requests, sum(ceil(value))::BIGINT AS tokens "
    "FROM events GROUP BY ALL) WHERE tokens > 200"
)
def q61_token_breaches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    limits = rows.select("user_id").distinct().withColumn("tpm_limit", F.lit(200))
    rates = metering.tumbling(rows, "ts", "1 minute", "user_id", tokens=F.ceil("value"))
    return metering.breaches(rates, limits, "user_id", "tpm_limit", "tokens").select("user_id", "window_start", "requests", "tokens", "tpm_limit")


_TOKENS = "SELECT conv_id % 3 AS tenant, turn % 2 AS m, (length(text) + 3) // 4 AS tokens, length(text) AS chars FROM conversations"


@query(
    f"SELECT 'm' || m AS month, tenant, sum(chars)::BIGINT AS units, (greatest(sum(chars)::BIGINT - 100000, 0) * 1::DECIMAL(12,4))::DECIMAL(24,4)::VARCHAR AS amount FROM ({_TOKENS}) GROUP BY m, tenant"
)
def q62_speech_bill(spark: SparkSession, d: str) -> DataFrame:
    usage = table(spark, d, "conversations").select((F.col("conv_id") % 3).alias("tenant"), (F.col("turn") % 2).alias("m"), F.length("text").alias("chars"))
    bill = metering.monthly_bill(usage, "api_tts", F.concat(F.lit("m"), F.col("m").cast("string")), F.col("chars"), "tenant")
    return bill.withColumn("amount", F.col("amount").cast("string"))


@query(
    f"SELECT 'm' || m AS month, tenant, sum(tokens)::BIGINT AS units, (greatest(sum(tokens)::BIGINT - 50000, 0) * 0.0100::DECIMAL(12,4))::DECIMAL(24,4)::VARCHAR AS amount FROM ({_TOKENS}) GROUP BY m, tenant"
)
def q63_language_bill(spark: SparkSession, d: str) -> DataFrame:
    usage = table(spark, d, "conversations").select((F.col("conv_id") % 3).alias("tenant"), (F.col("turn") % 2).alias("m"), F.expr("(length(text) + 3) div 4").alias("tokens"))
    bill = metering.monthly_bill(usage, "api_llm", F.concat(F.lit("m"), F.col("m").cast("string")), F.col("tokens"), "tenant")
    return bill.withColumn("amount", F.col("amount").cast("string"))


@query(
    "SELECT p_brand, round((sum(l_quantity::DECIMAL(18,4) * p_size::DECIMAL(16,6)) + sum(l_linenumber::DECIMAL(18,4) * p_retailprice::DECIMAL(16,6)))::DOUBLE / 1000, 4) AS cost "
    "FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"
)
def q64_two_price_cost(spark: SparkSession, d: str) -> DataFrame:
    usage = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_linenumber")
    models = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    cost = metering.two_price_cost(usage, models, F.col("l_partkey") == F.col("p_partkey"), "p_brand", "l_quantity", "l_linenumber", "p_size", "p_retailprice")
    return cost.withColumn("cost", F.round(F.col("cost").cast("double"), 4))


@query(
    "SELECT event_type, count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-15' AND ts + INTERVAL 6 HOUR > TIMESTAMP '2024-01-15') AS in_flight FROM events GROUP BY ROLLUP (event_type)"
)
def q65_inflight_totals(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "events").withColumn("done", F.expr("ts + INTERVAL 6 HOURS"))
    return metrics.in_flight_totals(spans, "event_type", "ts", "done", F.expr("TIMESTAMP_NTZ '2024-01-15'"))


@query("SELECT least(26, count(*)) AS first_row, least(50, count(*)) AS last_row, count(*) AS total FROM nation")
def q66_page_label(spark: SparkSession, d: str) -> DataFrame:
    return metrics.page_label(table(spark, d, "nation"), 1, 25)


@query("SELECT c_custkey, coalesce(n_name, 'Default') AS project_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def q67_project_names(spark: SparkSession, d: str) -> DataFrame:
    projects = table(spark, d, "nation").where("n_nationkey < 20").select("n_nationkey", "n_name")
    keys = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return keys.join(projects, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("Default")).alias("project_name"))


@query("SELECT o_orderkey::VARCHAR AS job_id, 'completed' AS status, 'jobs/' || o_orderkey || '.png' AS url FROM orders WHERE o_orderstatus = 'P'")
def q68_consume_jobs(spark: SparkSession, d: str) -> DataFrame:
    from meterlake.sources import sinks

    topic = new_folder(spark, "topic")
    queued = store.find_eq(table(spark, d, "orders"), o_orderstatus="P")
    sinks.publish(queued.select(F.col("o_orderkey").cast("string").alias("job_id"), F.lit("image").alias("job_type"), F.col("o_custkey").cast("string").alias("payload")), topic)
    done = jobs.finished(readers.job_topic(spark, topic), F.concat(F.lit("jobs/"), F.col("job_id"), F.lit(".png")))
    return _streamed(spark, done.select("job_id", "status", F.col("result_urls")[0].alias("url")))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate IS NULL OR o_orderdate > TIMESTAMP '1996-01-01'")
def q69_unexpired_keys(spark: SparkSession, d: str) -> DataFrame:
    return gate.unexpired(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.expr("TIMESTAMP_NTZ '1996-01-01'"), "o_orderdate").select("o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def q70_find_by_two(spark: SparkSession, d: str) -> DataFrame:
    return store.find_eq(table(spark, d, "customer"), c_mktsegment="BUILDING", c_nationkey=3).select("c_custkey", "c_name")


_ASKED = (
    "SELECT o_orderkey AS request_id, CASE WHEN o_orderstatus = 'P' THEN 'pending_approval' WHEN o_orderkey % 2 = 0 THEN 'approved' ELSE 'rejected' END AS status, "
    "CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 2 = 0 THEN 'key_old' END AS approved_key_id, CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 2 = 1 THEN 'old reason' END AS rejection_reason, "
    "'t' || (o_custkey % 5) AS tenant_id FROM orders"
)


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Key requests, some pending, some decided before."""
    pending, even = F.col("o_orderstatus") == "P", F.col("o_orderkey") % 2 == 0
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.when(pending, "pending_approval").when(even, "approved").otherwise("rejected").alias("status"),
        F.when(~pending & even, "key_old").alias("approved_key_id"), F.when(~pending & ~even, "old reason").alias("rejection_reason"), F.concat(F.lit("t"), (F.col("o_custkey") % 5).cast("string")).alias("tenant_id"),
    )


@query(
    f"SELECT request_id, CASE status WHEN 'pending_approval' THEN 'approved' ELSE status END AS status, CASE status WHEN 'pending_approval' THEN {_KEY.format(id='request_id')} ELSE approved_key_id END AS approved_key_id, "
    f"rejection_reason, CASE status WHEN 'pending_approval' THEN TIMESTAMP '2024-02-01' END AS updated_at FROM ({_ASKED})"
)
def q71_approve_keeps_old(spark: SparkSession, d: str) -> DataFrame:
    _, done = store.approve(_asked(spark, d), "request_id", SECRET, now=F.expr("TIMESTAMP_NTZ '2024-02-01'"))
    return done.select("request_id", "status", "approved_key_id", "rejection_reason", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query(
    f"SELECT {_KEY.format(id='request_id')} AS key_id, tenant_id, left({_PLAIN.format(id='request_id')}, 12) || '...' AS prefix, sha256({_PLAIN.format(id='request_id')}) AS hashed_key, "
    f"60::BIGINT AS rpm_limit, 100000::BIGINT AS tpm_limit, 5::BIGINT AS concurrency_limit, 'enabled' AS status FROM ({_ASKED}) WHERE status = 'pending_approval'"
)
def q72_new_keys(spark: SparkSession, d: str) -> DataFrame:
    return store.approve(_asked(spark, d), "request_id", SECRET)[0].drop("request_id", "created_at")


@query(
    "SELECT request_id, CASE WHEN request_id % 4 = 0 THEN 'rejected' ELSE status END AS status, CASE WHEN request_id % 4 = 0 THEN 'no budget' ELSE rejection_reason END AS rejection_reason, "
    f"CASE WHEN request_id % 4 = 0 THEN TIMESTAMP '2024-02-01' END AS updated_at FROM ({_ASKED})"
)
def q73_reject_keeps_old(spark: SparkSession, d: str) -> DataFrame:
    rows = _asked(spark, d)
    refused = rows.where("request_id % 4 = 0").select("request_id", F.lit("no budget").alias("rejection_reason"))
    return store.reject(rows, refused, "request_id", F.expr("TIMESTAMP_NTZ '2024-02-01'")).select("request_id", "status", "rejection_reason", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query(
    "SELECT s_suppkey, host, CASE s_suppkey % 5 WHEN 0 THEN true WHEN 1 THEN (s_suppkey % 256) BETWEEN 8 AND 11 WHEN 2 THEN (s_suppkey % 16) BETWEEN 4 AND 7 ELSE false END AS admitted FROM (SELECT s_suppkey, CASE s_suppkey % 5 "
    "WHEN 0 THEN 'localhost' WHEN 1 THEN (s_suppkey % 256) || '.0.0.9' WHEN 2 THEN '2001:db8:' || substr('0123456789abcdef', (s_suppkey % 16 + 1)::BIGINT, 1) || '000::1' WHEN 3 THEN 'no address' END AS host FROM supplier)"
)
def q74_admitted_hosts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("s_suppkey")
    digit = F.lower(F.hex(n % 16))
    host = F.when(n % 5 == 0, "localhost").when(n % 5 == 1, F.concat((n % 256).cast("string"), F.lit(".0.0.9"))).when(n % 5 == 2, F.concat(F.lit("2001:db8:"), digit, F.lit("000::1"))).when(n % 5 == 3, "no address")
    networks = readers.constant(spark, [("8.0.0.0/6",), ("2001:db8:4000::/34",)], "cidr string")
    return gate.admitted(table(spark, d, "supplier").select("s_suppkey", host.alias("host")), "host", networks)


@query("SELECT page_id, array_to_string(string_split(trim(regexp_extract(url, '^[^/]*//[^/]*([^?#]*)', 1), '/'), '/'), '|') AS parts FROM pages")
def q75_path_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.array_join(scalar.path_parts(F.regexp_extract("url", "^[^/]*//[^/]*([^?#]*)", 1)), "|").alias("parts"))
