"""Canonical JSON and HMAC-SHA256 as column expressions: no row leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 64
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Characters that JSON writes in a short form, besides quotes and backslashes.
SHORT = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}


def hmac_sha256(message: Column, secret: str | bytes) -> Column:
    """The HMAC-SHA256 of a binary or string column (as UTF-8) in lower-case hexadecimal digits; null for null."""
    import hashlib

    key = secret.encode() if isinstance(secret, str) else secret
    key = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def json_string(text: Column) -> Column:
    """A string as JSON in ASCII: characters outside it as \\u and four digits, those beyond U+FFFF as two of these."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def shown(c: Column) -> Column:
        # ascii() gives the code point of the first character
        n = F.ascii(c)
        high = n - 65536
        out = F.when(c == '"', F.lit('\\"')).when(c == "\\", F.lit("\\\\"))
        for code, letter in SHORT.items():
            out = out.when(n == code, F.lit(f"\\{letter}"))
        pair = F.concat(unit(F.shiftright(high, 10) + 55296), unit(high.bitwiseAND(F.lit(1023)) + 56320))
        return out.when(n > 65535, pair).when((n < 32) | (n > 126), unit(n)).otherwise(c)

    # most texts have nothing to escape, and are taken whole
    plain = text.rlike(r'\A[\x20\x21\x23-\x5b\x5d-\x7e]*\z')
    escaped = F.array_join(F.transform(F.split(text, ""), shown), "")
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(escaped), F.lit('"'))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """A typed value as JSON with sorted keys, ', ' and ': ' between, and ASCII only: the text that is signed.

    Null fields are written as null. Keys of structs are sorted when the expression is built, those of maps for each
    row. Fractions have no one text, so fields of float and double are refused; give decimals, which are written without trailing zeros, or strings.
    """
    null = F.lit("null")
    if isinstance(kind, T.StructType):
        fields = [F.concat(json_string(F.lit(f.name)), F.lit(": "), canonical_json(value[f.name], f.dataType)) for f in sorted(kind, key=lambda f: f.name)]
        body = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        body = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise TypeError("keys of JSON objects are strings")
        entries = F.transform(F.array_sort(F.map_entries(value)), lambda e: F.concat(json_string(e.key), F.lit(": "), canonical_json(e.value, kind.valueType)))
        body = F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))
    elif isinstance(kind, T.StringType):
        body = json_string(value)
    elif isinstance(kind, T.BooleanType):
        body = F.when(value, "true").otherwise("false")
    elif isinstance(kind, WHOLE):
        body = value.cast("string")
    elif isinstance(kind, T.DecimalType):
        text = value.cast("string")
        body = F.when(text.contains("."), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)
    else:
        raise TypeError(f"{kind.simpleString()} has no canonical JSON")
    return F.when(value.isNull(), null).otherwise(body)


def signature(payload: Column, kind: T.DataType, secret: str) -> Column:
    """sha256= and the HMAC of a typed payload's canonical JSON; null for a null payload."""
    return F.when(payload.isNotNull(), F.concat(F.lit("sha256="), hmac_sha256(canonical_json(payload, kind), secret)))
