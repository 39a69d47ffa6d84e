"""Queries over requests, files, indexes, sketches, pages and keyed tables that are built on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions import scalar, signing
from meterlake.operators import gate, keyed, metrics, paging, search, shape, sketches
from meterlake.plans.registry import query
from meterlake.session import new_folder, new_table, table
from meterlake.sources import bundle, intake, readers, sinks, variants

#: A request as the queries below read it from lineitem; every seventh line is cut off and is no JSON.
_BODY = "model STRING, temperature DOUBLE, top_p DOUBLE, n BIGINT, max_tokens BIGINT"


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    body = F.to_json(
        F.struct(
            F.when(F.col("l_returnflag") != "R", F.concat(F.lit("m"), F.col("l_suppkey").cast("string"))).alias("model"), (F.round(F.col("l_discount") * 30, 2)).alias("temperature"),
            F.round(F.col("l_tax") * 15, 2).alias("top_p"), (F.col("l_quantity") % 9).cast("long").alias("n"), (F.col("l_quantity").cast("long") - 2).alias("max_tokens"),
        )
    )
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.when(F.col("l_linenumber") == 7, F.substring(body, 1, 20)).otherwise(body).alias("body"))


_CHECKED = (
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN ['malformed'] ELSE list_filter([CASE WHEN l_returnflag = 'R' THEN 'missing model' END, CASE WHEN round(l_discount * 30, 2) > 2 THEN 'temperature' END, "
    "CASE WHEN round(l_tax * 15, 2) > 1 THEN 'top_p' END, CASE WHEN (l_quantity % 9)::BIGINT NOT BETWEEN 1 AND 5 THEN 'n' END, CASE WHEN l_quantity::BIGINT - 2 < 1 THEN 'max_tokens' END], lambda x: x IS NOT NULL) END AS reasons FROM lineitem"
)


def _checked(spark: SparkSession, d: str):
    r = lambda c: F.col(f"request.{c}")
    checks = {"temperature": gate.within(r("temperature"), 0, 2), "top_p": gate.within(r("top_p"), 0, 1), "n": gate.within(r("n"), 1, 5), "max_tokens": r("max_tokens") >= 1}
    return intake.routed(_bodies(spark, d), "body", _BODY, checks, ("model",))


@query(
    f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, len(reasons) = 0 AS accepted, array_to_string(reasons, ',') AS reasons FROM ({_CHECKED})"
)
def q81_checked_requests(spark: SparkSession, d: str) -> DataFrame:
    good, dead, _ = _checked(spark, d)
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return good.select(*keys, F.lit(True).alias("accepted"), F.lit("").alias("reasons")).unionByName(dead.select(*keys, F.lit(False).alias("accepted"), F.array_join("reasons", ",").alias("reasons")))


@query(f"SELECT reason, count(*) AS requests FROM (SELECT unnest(reasons) AS reason FROM ({_CHECKED})) GROUP BY reason UNION ALL SELECT 'accepted', count(*) FROM ({_CHECKED}) WHERE len(reasons) = 0")
def q82_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    good, dead, counts = _checked(spark, d)
    refused = dead.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("requests"))
    return refused.unionByName(readers.constant(spark, [("accepted", counts["accepted"])], "reason string, requests long"))


_NAME = "coalesce(source, 'none') || '/' || lang || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.py' WHEN doc_id % 3 = 1 THEN '.html' ELSE '.txt' END"


@query(
    "SELECT place, path, offset_, bytes FROM (SELECT path, bytes, row_number() OVER (ORDER BY path) - 1 AS place, coalesce(sum(bytes) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_ FROM ("
    f"SELECT {_NAME} AS path, octet_length(encode('### File: `' || {_NAME} || '`' || chr(10) || chr(10) || '```' || CASE WHEN doc_id % 3 = 0 THEN 'python' WHEN doc_id % 3 = 1 THEN 'html' ELSE '' END || chr(10) || coalesce(text, '') || chr(10) || '```' || chr(10) || chr(10)))::BIGINT AS bytes FROM documents))"
)
def q83_bundle(spark: SparkSession, d: str) -> DataFrame:
    ending = F.when(F.col("doc_id") % 3 == 0, ".py").when(F.col("doc_id") % 3 == 1, ".html").otherwise(".txt")
    files = table(spark, d, "documents").select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), ending).alias("path"), "text")
    return bundle.bundled(files, F.col("path"), F.col("text")).select("place", "path", F.col("offset").alias("offset_"), "bytes")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), lower('License'))")
def q84_indexed_search(spark: SparkSession, d: str) -> DataFrame:
    index = search.build_index(table(spark, d, "documents"), "doc_id", "text")
    return search.holding(spark, index, "License")


@query(
    "SELECT event_type, strftime(ts, '%Y-%m') AS month, count(*) AS calls, count(DISTINCT user_id) AS users, true AS users_near, true AS p50_near, true AS p95_near FROM events GROUP BY ALL"
)
def q85_rolled_up_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Monthly figures from daily sketches, held against the exact ones: within 5 % of callers and 2 % of ranks."""
    events = table(spark, d, "events")
    months = sketches.rolled_up(sketches.daily(events, "ts", ["event_type"], "user_id", "value"), "event_type", F.date_format("day", "yyyy-MM").alias("month"))
    told = sketches.read_out(months, 0.5, 0.95)
    exact = events.select("event_type", F.date_format("ts", "yyyy-MM").alias("month"), "user_id", "value").join(told, ["event_type", "month"])
    near = lambda share, c: F.abs(F.count_if(F.col("value") <= F.col(c)) / F.count("value") - share) <= 0.02
    sums = exact.groupBy("event_type", "month", "calls", "distinct").agg(F.count_distinct("user_id").alias("users"), near(0.5, "p50").alias("p50_near"), near(0.95, "p95").alias("p95_near"))
    return sums.select("event_type", "month", "calls", "users", (F.abs(F.col("distinct") - F.col("users")) <= 0.05 * F.col("users") + 0.5).alias("users_near"), "p50_near", "p95_near")


@query("SELECT ts, event_id, user_id, event_type FROM events ORDER BY ts, event_id LIMIT 25 OFFSET (SELECT 25 * ((count(*) // 25) - 2) FROM events)")
def q86_late_page(spark: SparkSession, d: str) -> DataFrame:
    folder, pages = paging.paged(table(spark, d, "events").select("ts", "event_id", "user_id", "event_type"), ["ts", "event_id"], 25)
    last = table(spark, d, "events").count() // 25 - 2
    return paging.page(folder, pages, ["ts", "event_id"], last)


@query(
    "SELECT conv_id, turn, i - 1 AS index, parts[i] AS input FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN NULL WHEN turn % 2 = 0 THEN [text] ELSE string_split(text, '. ') END AS parts, "
    "unnest(range(1, len(CASE WHEN turn % 3 = 2 THEN NULL WHEN turn % 2 = 0 THEN [text] ELSE string_split(text, '. ') END) + 1)) AS i FROM conversations)"
)
def q87_scalar_or_list(spark: SparkSession, d: str) -> DataFrame:
    return variants.inputs(_untyped(spark, d), "request", "input").select("conv_id", "turn", F.col("index").cast("long").alias("index"), "input")


def _untyped(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as bodies whose input is a string, a list of strings, or not there."""
    one, many = F.to_json(F.struct(F.col("text").alias("input"), F.col("role"))), F.to_json(F.struct(F.split("text", r"\. ").alias("input"), F.col("turn").alias("role")))
    body = F.when(F.col("turn") % 3 == 2, F.to_json(F.struct("role"))).when(F.col("turn") % 2 == 0, one).otherwise(many)
    return variants.parsed(table(spark, d, "conversations").select("conv_id", "turn", body.alias("body")), "body")


@query(
    "SELECT field, kind, count(*) AS requests FROM (SELECT unnest(['input', 'role']) AS field, unnest([CASE WHEN turn % 3 = 2 THEN 'missing' WHEN turn % 2 = 0 THEN 'string' ELSE 'array' END, "
    "CASE WHEN turn % 3 <> 2 AND turn % 2 = 1 THEN 'bigint' ELSE 'string' END]) AS kind FROM conversations) GROUP BY ALL"
)
def q88_schema_drift(spark: SparkSession, d: str) -> DataFrame:
    return variants.drift(_untyped(spark, d), "request", ["input", "role"])


@query(
    "SELECT event_type, 'OBJECT<k: BIGINT>' AS schema, count(*) AS requests, 0::BIGINT AS unreadable FROM events GROUP BY event_type"
)
def q89_variant_schemas(spark: SparkSession, d: str) -> DataFrame:
    return variants.schemas(variants.parsed(table(spark, d, "events"), "props"), "request", "event_type")


def _xored(pad: int, secret: bytes = b"catalogue") -> str:
    return bytes(b ^ pad for b in secret.ljust(64, b"\0")).hex()


_SIGNED = (
    '\'{"customer": \' || o_custkey || \', "event": "order.\' || lower(o_orderstatus) || \'", "order": \' || o_orderkey || \', "tags": ["\' || o_orderpriority || \'", null]}\''
)


@query(
    f"SELECT o_orderkey, 'sha256=' || sha256(unhex('{_xored(0x5C)}') || unhex(sha256(unhex('{_xored(0x36)}') || encode({_SIGNED})))) AS signature FROM orders"
)
def q90_signatures(spark: SparkSession, d: str) -> DataFrame:
    payload = F.struct(
        F.col("o_orderkey").alias("order"), F.concat(F.lit("order."), F.lower("o_orderstatus")).alias("event"), F.col("o_custkey").alias("customer"), F.array("o_orderpriority", F.lit(None).cast("string")).alias("tags")
    )
    rows = table(spark, d, "orders").select("o_orderkey", payload.alias("payload"))
    return rows.select("o_orderkey", signing.signature(F.col("payload"), rows.schema["payload"].dataType, "catalogue").alias("signature"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 100 <> 5 "
    "UNION ALL SELECT -1 - o_orderkey, o_totalprice + 1, CASE WHEN o_orderkey % 10 = 0 THEN 'X' END FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 100 <> 5"
)
def q91_bucketed_update(spark: SparkSession, d: str) -> DataFrame:
    name = new_table(spark, "orders")
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    keyed.create(orders, name, "o_orderkey", 16)
    news = orders.where("o_orderkey % 5 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.when(F.col("o_orderkey") % 10 == 0, "X").alias("o_orderstatus"), (F.col("o_orderkey") % 100 == 5).alias("gone"))
    more = news.withColumn("o_orderkey", -1 - F.col("o_orderkey"))
    return keyed.updated(spark, name, news.unionByName(more), "o_orderkey", deleted="gone")


@query(
    "SELECT c_custkey, c_name, CASE WHEN c_custkey = first AND c_nationkey < 10 THEN 'RESET' ELSE c_mktsegment END AS c_mktsegment FROM (SELECT *, min(c_custkey) OVER (PARTITION BY c_mktsegment, c_nationkey) AS first FROM customer)"
)
def q92_update_by_email(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").withColumn("email", F.concat(F.lower("c_mktsegment"), F.lit("@"), F.col("c_nationkey").cast("string")))
    asked = users.where("c_nationkey < 10").select("email").distinct().withColumn("c_mktsegment", F.lit("RESET"))
    return keyed.update_by(users, asked, "email", "c_custkey", ["c_mktsegment"]).select("c_custkey", "c_name", "c_mktsegment")


@query(
    "SELECT source, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS bytes, round(sum(octet_length(encode(coalesce(text, ''))) + 1) / 1024.0::DOUBLE, 3) AS kib FROM documents WHERE lang <> 'fr' GROUP BY source"
)
def q93_tree_totals(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of a tree of text files by folder, without some folders, endings and names; texts are the files' lines."""
    folder = new_folder(spark, "tree")
    texts = table(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("value"), F.coalesce("source", F.lit("none")).alias("source"), "lang")
    texts.write.partitionBy("source", "lang").text(folder)
    files = readers.tree(spark, folder, without_dirs=["lang=fr"], without_ends=[".crc"], without_names=["_SUCCESS"])
    sums = shape.file_totals(files.withColumn("source", F.regexp_extract("path", "/source=([^/]*)/", 1)), ["source"])
    return sums.select("source", "bytes", F.round(F.col("bytes") / 1024, 3).alias("kib"))


@query(
    "SELECT 'log_' || event_id AS log_id, event_type AS action, CASE WHEN event_type = 'error' THEN TIMESTAMP '2024-03-01' ELSE ts END AS logged_at FROM events WHERE event_id % 2 = 0 "
    "UNION ALL SELECT 'log_' || event_id, event_type, CASE WHEN event_type = 'error' THEN TIMESTAMP '2024-03-01' ELSE ts END FROM events WHERE event_type = 'error'"
)
def q94_appended_logs(spark: SparkSession, d: str) -> DataFrame:
    """Two appends to one table; a log without a time gets the time of its append, here a given one."""
    folder = new_folder(spark, "logs")
    logs = table(spark, d, "events").select(
        F.concat(F.lit("log_"), F.col("event_id").cast("string")).alias("log_id"), F.col("event_type").alias("action"), F.when(F.col("event_type") != "error", F.col("ts")).alias("logged_at"), "event_id"
    )
    now = F.expr("TIMESTAMP_NTZ '2024-03-01'")
    sinks.append(logs.where("event_id % 2 = 0").drop("event_id"), folder, "logged_at", now)
    sinks.append(logs.where("action = 'error'").drop("event_id"), folder, "logged_at", now)
    return spark.read.parquet(folder)


@query("SELECT event_type, user_id, requests::BIGINT AS requests FROM (SELECT event_type, user_id, count(*) AS requests FROM events GROUP BY ALL) ORDER BY requests DESC, event_type, user_id LIMIT 100")
def q95_csv_report(spark: SparkSession, d: str) -> DataFrame:
    folder = new_folder(spark, "report")
    top = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("requests")).orderBy(F.col("requests").desc(), "event_type", "user_id").limit(100)
    sinks.report_csv(top, folder)
    return spark.read.schema(top.schema).option("header", "true").csv(folder)


@query(
    "WITH p AS (SELECT regexp_extract(url, '^[^/]*//[^/]*(/[^?#]*)', 1) AS path, regexp_extract(url, '^([a-z]+):', 1) AS method, page_id FROM pages) "
    "SELECT page_id, CASE WHEN string_split(trim(path, '/'), '/')[1] = '' THEN 'root' ELSE string_split(trim(path, '/'), '/')[1] END AS folder, path, upper(method) AS method, CASE WHEN page_id % 2 = 0 THEN 'Page ' || page_id ELSE path END AS name FROM p"
)
def q96_api_collection(spark: SparkSession, d: str) -> DataFrame:
    """A row per path and method of API descriptions: one for each page, by the path of its url."""
    path, method = F.regexp_extract("url", "^[^/]*//[^/]*(/[^?#]*)", 1), F.regexp_extract("url", "^([a-z]+):", 1)
    summary = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("Page "), F.col("page_id").cast("string")))
    pages = table(spark, d, "pages").select("page_id", F.create_map(path, F.create_map(method, summary)).alias("paths"))
    return shape.flattened(pages, "paths", "page_id")


@query(
    "SELECT c_custkey, array_to_string(list_transform(regexp_extract_all(lower(c_mktsegment) || '_' || c_custkey || 'nd.o''neil', '[a-zA-Z]+|[^a-zA-Z]+'), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '') AS full_name FROM customer"
)
def q97_default_names(spark: SparkSession, d: str) -> DataFrame:
    email = F.concat(F.lower("c_mktsegment"), F.lit("_"), F.col("c_custkey").cast("string"), F.lit("nd.o'neil@"), F.lower("c_name"))
    return table(spark, d, "customer").select("c_custkey", scalar.name_from_email(email).alias("full_name"))


@query(
    "SELECT a.event_id // 2 AS request, (epoch_us(b.ts) - epoch_us(a.ts)) / 1e6::DOUBLE AS seconds, (epoch_us(b.ts) - epoch_us(a.ts)) // 1000 AS millis FROM events a JOIN events b ON a.event_id + 1 = b.event_id WHERE a.event_id % 2 = 0"
)
def q98_latencies(spark: SparkSession, d: str) -> DataFrame:
    """How long a request takes, from the times of its start and end."""
    moves = table(spark, d, "events").select(F.expr("event_id div 2").alias("request"), (F.col("event_id") % 2 == 0).alias("starts"), "ts")
    spans = moves.groupBy("request").agg(F.min(F.when(F.col("starts"), F.col("ts"))).alias("started"), F.max(F.when(~F.col("starts"), F.col("ts"))).alias("ended"))
    spans = spans.where("started IS NOT NULL AND ended IS NOT NULL")
    return spans.select("request", scalar.latency_seconds(F.col("started"), F.col("ended")).alias("seconds"), F.expr("timestampdiff(MICROSECOND, started, ended) div 1000").alias("millis"))


@query(
    "WITH r AS (SELECT event_id, ts, event_type, CASE event_type WHEN 'error' THEN 500 + user_id % 4 WHEN 'signup' THEN 400 + user_id % 30 ELSE 200 END AS status FROM events) "
    "SELECT event_id, event_type, status FROM r WHERE status // 100 = 4 AND event_type IN ('signup', 'error') AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-21' "
    "UNION ALL SELECT event_id, event_type, status FROM r WHERE status // 100 = 5 AND ts >= TIMESTAMP '2024-01-25'"
)
def q99_status_report(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", 500 + F.col("user_id") % 4).when(F.col("event_type") == "signup", 400 + F.col("user_id") % 30).otherwise(200)
    rows = table(spark, d, "events").select("event_id", "ts", "event_type", "user_id", status.alias("status"))
    month = metrics.report(rows, "ts", "event_type", "status", status_class="4xx", apis=["signup", "error"], first="2024-01-10", last="2024-01-20")
    return month.unionByName(metrics.report(rows, "ts", "event_type", "status", status_class="5xx", first="2024-01-25")).select("event_id", "event_type", "status")


@query(
    "SELECT o_orderkey AS payment, c_name AS project, n_name AS tenant, r_name AS owner FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey "
    "LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 100000"
)
def q100_owners(spark: SparkSession, d: str) -> DataFrame:
    """Payments with their projects, tenants and owners; what a key no longer names is null."""
    payments = table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("payment"), "o_custkey")
    projects = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", F.col("c_name").alias("project"), "c_nationkey")
    tenants = table(spark, d, "nation").where("n_nationkey < 20").select("n_nationkey", F.col("n_name").alias("tenant"), "n_regionkey")
    owners = table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("owner"))
    found = shape.with_parents(payments, [(projects, "o_custkey", "c_custkey"), (tenants, "c_nationkey", "n_nationkey"), (owners, "n_regionkey", "r_regionkey")])
    return found.select("payment", "project", "tenant", "owner")


@query(
    "SELECT s_suppkey, host, CASE WHEN s_suppkey % 4 = 0 THEN false WHEN s_suppkey % 4 = 3 THEN s_suppkey % 8 = 7 ELSE s_nationkey BETWEEN 8 AND 11 END AS admitted FROM (SELECT s_suppkey, s_nationkey, CASE s_suppkey % 4 WHEN 0 THEN '0' || s_nationkey || '.1.2.3' "
    "WHEN 1 THEN '::ffff:' || s_nationkey || '.1.2.3' WHEN 2 THEN s_nationkey || '.1.2.3' WHEN 3 THEN CASE WHEN s_suppkey % 8 = 7 THEN 'fe80::' || s_nationkey || '%eth0' ELSE 'fe80::' || s_nationkey || '%' END END AS host FROM supplier)"
)
def q101_address_forms(spark: SparkSession, d: str) -> DataFrame:
    """Octets with leading zeros, dotted ends of version 6, zones; networks with netmasks."""
    n, k = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    host = F.when(n % 4 == 0, F.concat(F.lit("0"), k, F.lit(".1.2.3"))).when(n % 4 == 1, F.concat(F.lit("::ffff:"), k, F.lit(".1.2.3"))).when(n % 4 == 2, F.concat(k, F.lit(".1.2.3")))
    host = host.otherwise(F.concat(F.lit("fe80::"), k, F.when(n % 8 == 7, "%eth0").otherwise("%")))
    networks = readers.constant(spark, [("8.0.0.0/252.0.0.0",), ("::ffff:8.0.0.0/102",), (" fe80::/64 ",), ("not a network",)], "cidr string")
    return gate.admitted(table(spark, d, "supplier").select("s_suppkey", host.alias("host")), "host", networks)


@query(
    "WITH p AS (SELECT page_id, regexp_extract(url, '^[^/]*//[^/]*(/[^?#]*)', 1) AS path, upper(regexp_extract(url, '^([a-z]+):', 1)) AS method FROM pages) "
    "SELECT page_id, method, '{{base_url}}' || path AS raw, len(string_split(trim(path, '/'), '/'))::BIGINT AS depth, string_split(trim(path, '/'), '/')[1] AS first FROM p"
)
def q102_collection_files(spark: SparkSession, d: str) -> DataFrame:
    """API requests as JSON items in files, one folder a method, and read again as they are typed."""
    folder = new_folder(spark, "collection")
    rows = q96_api_collection(spark, d)
    where = F.struct(F.concat(F.lit("{{base_url}}"), F.col("path")).alias("raw"), scalar.path_parts(F.col("path")).alias("path"))
    items = rows.select("page_id", "name", "method", F.struct("method", where.alias("url")).alias("request"))
    sinks.write_json(items, folder, by="method")
    back = spark.read.schema("page_id LONG, name STRING, request STRUCT<method: STRING, url: STRUCT<raw: STRING, path: ARRAY<STRING>>>").json(folder)
    url = F.col("request.url")
    return back.select("page_id", F.col("request.method").alias("method"), url["raw"].alias("raw"), F.size(url["path"]).cast("long").alias("depth"), url["path"][0].alias("first"))
