"""Checks on the path of a request, for whole tables of requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.scalar import address_hex, ipv4_number, mask_bits

#: Below the first prefix a key is needed, but not below the others: fixed values of the routing rule.
KEYED_PREFIX, OPEN_PREFIXES = "/v1/", ("/v1/auth/", "/v1/mcp")


def bearer_key(header: Column) -> Column:
    """The key of an Authorization header; every 'Bearer ' is taken out, then white space at the ends."""
    return F.btrim(F.replace(header, F.lit("Bearer "), F.lit("")), F.lit(" \t\n\r\x0b\x0c"))


def bearer_ok(header: Column) -> Column:
    """Present, of the Bearer kind, and with a key of eight characters or more."""
    return F.coalesce(F.startswith(header, F.lit("Bearer ")) & (F.length(bearer_key(header)) >= 8), F.lit(False))


def is_open(path: Column) -> Column:
    """Whether a path is served without a key; one that is not known is not."""
    out = ~path.startswith(KEYED_PREFIX)
    for prefix in OPEN_PREFIXES:
        out = out | path.startswith(prefix)
    return F.coalesce(out, F.lit(False))


def endpoint_gate(requests: DataFrame, flags: DataFrame, path: str) -> DataFrame:
    """requests with enabled: the endpoint's flag; a path without one is enabled."""
    known = flags.select(path, (F.col("status") == "enabled").alias("_on"))
    return requests.join(known, path, "left").withColumn("enabled", F.coalesce("_on", F.lit(True))).drop("_on")


def resolve_alias(requests: DataFrame, aliases: DataFrame, on: Column) -> DataFrame:
    """Requests joined to the alias that they name. Spark broadcasts the aliases if they are small."""
    return requests.join(aliases, on)


def unresolved(requests: DataFrame, aliases: DataFrame, on: Column) -> DataFrame:
    """Requests that name no alias: the 404s."""
    return requests.join(aliases, on, "left_anti")


def maintenance_gate(requests: DataFrame, active: bool, path: str = "path") -> DataFrame:
    """Requests that a maintenance window turns away."""
    return requests.where(F.lit(active) & ~F.col(path).startswith("/admin") & ~F.col(path).isin("/health", "/status"))


def in_networks(requests: DataFrame, ip: str, networks: DataFrame) -> DataFrame:
    """Requests whose IPv4 number lies in a network (lo, hi).

    A network is cut along the /8 blocks that it touches and joined by block, so that the join has an
    equality to hash on and long network lists do not become a nested loop.
    """
    blocks = networks.select("lo", "hi", F.explode(F.sequence(F.shiftright("lo", 24), F.shiftright("hi", 24))).alias("_block"))
    keyed = requests.withColumn("_block", F.shiftright(ip, 24))
    hit = (keyed["_block"] == blocks["_block"]) & keyed[ip].between(blocks["lo"], blocks["hi"])
    return keyed.join(blocks, hit, "left_semi").drop("_block")


#: Hosts that pass the address check as they are: fixed values of the gateway.
LITERAL_HOSTS = ("testclient", "127.0.0.1", "localhost", "::1")


def admitted(requests: DataFrame, host: str, networks: DataFrame, cidr: str = "cidr") -> DataFrame:
    """requests with admitted: a literal host, or an address of either version in one of the networks; all if no network can be read.

    An address is a version and hexadecimal digits, and a network a few beginnings of such: one for
    each value of a last digit that it fixes in part. Beginnings are joined by equality, so a long list
    of networks is no nested loop. At most 42 lengths of beginnings come to the driver.
    """
    beginnings = cidr_prefixes(networks, cidr)
    lengths = sorted(r.digits for r in beginnings.select("digits").distinct().collect())
    fixed = F.coalesce(F.col(host).isin(*LITERAL_HOSTS), F.lit(False))
    if not lengths:
        return requests.withColumn("admitted", fixed | F.lit(True))
    asked = requests.select(F.col(host).alias("_host")).distinct().withColumn("_bits", address_hex(F.col("_host"))).where("_bits IS NOT NULL")
    asked = asked.select("_host", F.explode(F.array_distinct(F.array(*(F.substring("_bits", 1, n) for n in lengths)))).alias("prefix"))
    inside = asked.join(beginnings.select("prefix").distinct(), "prefix").select("_host", F.lit(True).alias("_hit")).distinct()
    return requests.join(inside, F.col(host) == F.col("_host"), "left").withColumn("admitted", fixed | F.coalesce("_hit", F.lit(False))).drop("_host", "_hit")


def cidr_prefixes(networks: DataFrame, cidr: str = "cidr") -> DataFrame:
    """(prefix, digits): the beginnings, as address_hex writes them, of a network's addresses; none for what is no network."""
    text = F.trim(cidr)
    rows = networks.select(address_hex(F.substring_index(text, "/", 1)).alias("bits"), F.when(text.contains("/"), F.substring(text, F.instr(text, "/") + 1, F.length(text))).alias("mask"))
    rows = rows.withColumn("most", (F.length("bits") - 1) * 4)
    rows = rows.withColumn("n", F.when(F.col("mask").isNull(), F.col("most")).otherwise(mask_bits(F.col("mask"), F.col("most")))).where("n >= 0")
    rows = rows.withColumn("digits", 1 + F.ceil(F.col("n") / 4).cast("int")).withColumn("free", F.pow(F.lit(2), (F.col("digits") - 1) * 4 - F.col("n")).cast("int"))
    last = F.conv(F.substring(F.col("bits"), F.col("digits"), F.lit(1)), 16, 10).cast("int")
    low = F.floor(last / F.col("free")).cast("int") * F.col("free")
    some = rows.withColumn("last", F.explode(F.when(F.col("n") > 0, F.sequence(low, low + F.col("free") - 1)).otherwise(F.array(F.lit(0)))))
    end = F.when(F.col("n") > 0, F.lower(F.hex("last"))).otherwise("")
    return some.select(F.concat(F.substring(F.col("bits"), F.lit(1), F.greatest(F.col("digits") - 1, F.lit(1))), end).alias("prefix"), "digits")


def cidr_bounds(networks: DataFrame, cidr: str = "cidr") -> DataFrame:
    """networks with lo and hi, the first and last IPv4 number of the CIDR block."""
    parts = F.split(cidr, "/")
    size = F.pow(F.lit(2), 32 - F.coalesce(F.try_element_at(parts, F.lit(2)).cast("int"), F.lit(32))).cast("long")
    base = ipv4_number(parts[0])
    return networks.withColumn("lo", F.floor(base / size).cast("long") * size).withColumn("hi", F.col("lo") + size - 1)


def alias_allowed(allowed: Column, alias: Column) -> Column:
    """Whether an allow-list holds the alias or a star."""
    return F.array_contains(allowed, "*") | F.array_contains(allowed, alias)


def unexpired(keys: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Keys without an expiry or with one to come."""
    return keys.where(F.col(expires).isNull() | (F.col(expires) > now))


def within(value: Column, low: float, high: float) -> Column:
    """Null, or in the closed range."""
    return value.isNull() | value.between(low, high)


def over_concurrency(requests: DataFrame, running: str, limit: str) -> DataFrame:
    """Requests that start when their tenant already runs as many as allowed."""
    return requests.where(F.col(running) >= F.col(limit))
