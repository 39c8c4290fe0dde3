"""Reading JSON variants by their types: what isn't of the type that is asked for is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def type_of(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DOUBLE, BOOLEAN or VOID (decimals and other numbers as they are named); null if there is nothing."""
    return F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)


def string(v: Column) -> Column:
    return F.when(type_of(v) == "STRING", F.try_variant_get(v, "$", "string"))


def flag(v: Column) -> Column:
    return F.when(type_of(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))


def obj(v: Column) -> Column:
    return F.when(type_of(v) == "OBJECT", v)


def elements(v: Column) -> Column:
    """An array's elements; none if it isn't one."""
    none = F.array().cast("array<variant>")
    return F.when(type_of(v) == "ARRAY", F.coalesce(F.try_variant_get(v, "$", "array<variant>"), none)).otherwise(none)


def scalar(v: Column) -> Column:
    """The text of a string or number."""
    kind = type_of(v)
    return F.when(kind.isin("STRING", "BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), F.try_variant_get(v, "$", "string"))


def name(v: Column) -> Column:
    """As scalar, null if it is empty or 0, so that another name can take its place."""
    return F.when(~scalar(v).isin("", "0"), scalar(v))


def first(*vs: Column) -> Column:
    """The first of the variants that is there, a JSON null included."""
    return F.coalesce(*vs)


def said(v: Column) -> Column:
    """JSON text, null for nothing and for null."""
    return F.when(type_of(v) != "VOID", F.to_json(v))
