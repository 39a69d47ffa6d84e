"""Untyped JSON bodies: which schemas occur, which fields drift between types, and typed branches for either form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(rows: DataFrame, body: str, out: str = "request") -> DataFrame:
    """rows with the body as a variant; null where it is null or no JSON."""
    return rows.withColumn(out, F.try_parse_json(body))


def schemas(rows: DataFrame, request: str, *keys: str) -> DataFrame:
    """keys, schema (one that all variants of the keys fit), requests, unreadable: schemas are merged by each task before they are shuffled."""
    return rows.groupBy(*keys).agg(F.schema_of_variant_agg(request).alias("schema"), F.count(request).alias("requests"), F.count_if(F.col(request).isNull()).alias("unreadable"))


def kind(value: Column) -> Column:
    """The form of a variant: array, object, null, missing, or the type of a scalar in small letters."""
    schema = F.schema_of_variant(value)
    return F.when(value.isNull(), "missing").when(F.is_variant_null(value), "null").when(schema.startswith("ARRAY<"), "array").when(schema.startswith("OBJECT<"), "object").otherwise(F.lower(F.regexp_extract(schema, "^[A-Za-z]+", 0)))


def drift(rows: DataFrame, request: str, fields: Sequence[str]) -> DataFrame:
    """field, kind, requests: in how many requests each field of a list has each form, missing ones included. A field with more than one form besides missing and null drifts.

    All fields are counted in one pass.
    """
    forms = F.array(*(F.struct(F.lit(f).alias("field"), kind(F.try_variant_get(request, f"$.{f}", "variant")).alias("kind")) for f in fields))
    return rows.where(F.col(request).isNotNull()).select(F.explode(forms).alias("f")).groupBy("f.field", "f.kind").agg(F.count("*").alias("requests"))


def listed(value: Column) -> Column:
    """A variant that is a string or a list of strings as an array: one of one element for a scalar, none for null and missing."""
    form = kind(value)
    # an element is a scalar of any type, as text; a nested list or object as its JSON
    elements = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)))
    scalar = F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))
    return F.when(form == "array", elements).when(form.isin("null", "missing"), F.array().cast("array<string>")).otherwise(F.array(scalar))


def inputs(rows: DataFrame, request: str, field: str) -> DataFrame:
    """A row for each input of a request, with its index, whether field holds one or a list."""
    return rows.select("*", F.posexplode(listed(F.try_variant_get(request, f"$.{field}", "variant"))).alias("index", "input"))
