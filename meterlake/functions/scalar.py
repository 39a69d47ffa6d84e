"""Scalar functions of the request path. Python is used only where Spark has no such function."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def key_prefix(key: Column, n: int = 12) -> Column:
    """The first characters and an ellipsis."""
    return F.concat(F.substring(key, 1, n), F.lit("..."))


def key_suffix(key: Column, n: int = 10) -> Column:
    """The last characters."""
    return F.right(key, F.lit(n))


def mask_key(key: Column) -> Column:
    """The first four characters and 28 stars."""
    return F.concat(F.substring(key, 1, 4), F.repeat(F.lit("*"), 28))


def or_default(value: Column, default: Column) -> Column:
    """The default for null and for the empty string."""
    return F.coalesce(F.nullif(value, F.lit("")), default)


def minute_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy/MM/dd HH:mm")


def log_id(ts: Column) -> Column:
    """Digits of a time down to 0.1 ms."""
    return F.date_format(ts, "yyyyMMddHHmmssSSSS")


def title_case(text: Column) -> Column:
    """Upper case after anything that is no letter, lower case after a letter, as Python's title()."""
    letters = F.split(text, "")
    lifted = F.transform(letters, lambda c, i: F.when((i == 0) | ~F.element_at(letters, F.when(i == 0, 1).otherwise(i)).rlike(r"\p{L}"), F.upper(c)).otherwise(F.lower(c)))
    return F.array_join(lifted, "")


def name_from_email(email: Column) -> Column:
    """The default full name: what stands before the @, in title case."""
    return title_case(F.substring_index(email, "@", 1))


def path_parts(path: Column) -> Column:
    return F.split(F.btrim(path, F.lit("/")), "/")


def ipv4_number(address: Column) -> Column:
    """A dotted quad as a number; null if it is none. Octets are digits without leading zeros, up to 255."""
    valid = address.rlike(r"\A((0|[1-9][0-9]{0,2})\.){3}(0|[1-9][0-9]{0,2})\z")
    octets = F.transform(F.split(address, r"\."), lambda x: F.try_to_number(x, F.lit("999")).cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    return F.when(valid & ~F.exists(octets, lambda x: x > 255), number)


def ipv4_network(address: Column, bits: int) -> Column:
    """The number of the network of that many leading bits."""
    return ipv4_number(address).bitwiseAND(F.lit((2**32 - 1) ^ (2 ** (32 - bits) - 1)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it: long expressions stay short."""
    return F.element_at(F.transform(F.array(value), use), 1)


def address_hex(address: Column) -> Column:
    """An address as its version (4 or 6) and 8 or 32 hexadecimal digits; null if it is none.

    The last 32 bits of version 6 may be a dotted quad; a zone behind % is left out.
    """
    four = F.concat(F.lit("4"), F.lower(F.lpad(F.hex(ipv4_number(address)), 8, "0")))
    zoneless = F.when(address.contains(":"), F.regexp_replace(address, r"(?s)\A([^%/]*)%[^%/]+\z", "$1")).otherwise(address)
    return F.coalesce(four, let(let(zoneless, _undotted), lambda text: let(F.split(text, "::"), lambda halves: _grouped(text, halves))))


def _undotted(text: Column) -> Column:
    """A dotted end as two groups; one that is no quad stays, and makes the whole no address. In small letters."""
    end = F.regexp_extract(text, r"\A[0-9A-Fa-f:]*:([0-9.]*\.[0-9.]*)\z", 1)
    groups = lambda n: F.concat(F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(F.lit(65535))))
    whole = lambda e, n: F.lower(F.when(n.isNotNull(), F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(e)), groups(n))).otherwise(text))
    return let(end, lambda e: let(ipv4_number(e), lambda n: whole(e, n)))


def _grouped(text: Column, halves: Column) -> Column:
    """Version 6 from its text and what stands before and behind '::'."""
    groups = lambda k: F.filter(F.split(F.coalesce(F.try_element_at(halves, F.lit(k)), F.lit("")), ":"), lambda x: x != "")

    def joined(left: Column, right: Column) -> Column:
        missing = 8 - F.size(left) - F.size(right)
        full = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
        shaped = text.rlike(r"\A[0-9a-f:]*:[0-9a-f:]*\z") & ~text.rlike(r":::|\A:[^:]|[^:]:\z") & ~F.exists(full, lambda x: F.length(x) > 4)
        sized = ((F.size(halves) == 1) & (missing == 0)) | ((F.size(halves) == 2) & (missing >= 1))
        return F.when(shaped & sized, F.concat(F.lit("6"), F.array_join(F.transform(full, lambda x: F.lpad(x, 4, "0")), "")))

    return let(groups(1), lambda left: let(groups(2), lambda right: joined(left, right)))


def mask_bits(mask: Column, most: Column) -> Column:
    """How many leading bits a network fixes: a number of digits up to most, or, for version 4, a dotted netmask or its complement; null for anything else."""
    number = ipv4_number(mask)
    ones = F.bit_count(number)
    turned = F.lit(2**32 - 1) - number
    netmask = turned.bitwiseAND(turned + 1) == 0
    hostmask = number.bitwiseAND(number + 1) == 0
    dotted = F.when(netmask, ones).when(hostmask, 32 - ones)
    digits = F.when(mask.rlike(r"\A[0-9]{1,9}\z"), mask.cast("int"))
    n = F.coalesce(digits, F.when(most == 32, dotted))
    return F.when(n <= most, n)


def signature(secret: str):
    """A column function: sha256= and the HMAC of a JSON text with sorted keys, as webhooks are signed."""

    @F.pandas_udf("string")
    def sign(payloads: pd.Series) -> pd.Series:
        def one(p: str | None) -> str | None:
            if p is None:
                return None
            body = json.dumps(json.loads(p), sort_keys=True)
            return "sha256=" + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()

        return payloads.map(one)

    return sign


def latency_seconds(start: Column, end: Column) -> Column:
    """Seconds from start to end, to the microsecond."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return (micros(end) - micros(start)) / F.lit(1e6)


def total_tokens(prompt: Column, completion: Column) -> Column:
    return F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
