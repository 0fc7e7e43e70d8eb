"""Loosely typed JSON values, coerced as script languages do: absent, null and text are different things."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def path(key: str) -> str:
    return f"$['{key}']"


def member(properties: Column, key: str) -> Column:
    """The member as a VARIANT: NULL if absent, a variant null if it is JSON null."""
    return F.try_variant_get(properties, path(key), "variant")


def present(v: Column) -> Column:
    return v.isNotNull()


def unless_null(v: Column) -> Column:
    """v, but NULL for JSON null too (the ?? operator's view)."""
    return F.when(v.isNotNull() & ~F.is_variant_null(v), v)


def kind(v: Column) -> Column:
    """VOID, BOOLEAN, STRING, a number type, ARRAY<..> or OBJECT<..>; NULL if absent."""
    return F.schema_of_variant(v)


def text(v: Column) -> Column:
    """A string member's text; NULL for anything else."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once: expressions that repeat it would grow beyond what can be compiled."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once a row: projections and filters above can't take it apart or repeat it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def number(v: Column) -> Column:
    """Number(v): null and blank text are 0, booleans 0 and 1, text in decimal, 0x, 0o or 0b notation its value.

    Everything else is NaN; an absent member gives NULL.
    """
    def of_text(s: Column) -> Column:
        digits = F.lower(F.substring(s, 3, 64))
        by_base = F.when(s.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(digits, 16, 10)).when(s.rlike("^0[oO][0-7]+$"), F.conv(digits, 8, 10)).when(s.rlike("^0[bB][01]+$"), F.conv(digits, 2, 10))
        return F.when(s == "", 0.0).when(s.rlike(DECIMAL), s.try_cast("double")).when(s.isin("Infinity", "+Infinity"), float("inf")).when(s == "-Infinity", float("-inf")).otherwise(F.coalesce(by_base.try_cast("double"), F.lit(float("nan"))))

    def of_kind(t: Column) -> Column:
        k = t["k"]
        return F.when(k == "VOID", 0.0).when(k == "STRING", let(F.trim(t["s"]), of_text)).when(k == "BOOLEAN", (t["s"] == "true").cast("double")).otherwise(F.coalesce(F.when(~k.rlike("^(ARRAY|OBJECT)"), t["s"].try_cast("double")), F.lit(float("nan"))))

    return F.when(v.isNull(), F.lit(None).cast("double")).otherwise(let(F.struct(kind(v).alias("k"), F.try_variant_get(v, "$", "string").alias("s")), of_kind))


def finite(v: Column) -> Column:
    """number(v) where it is finite, else NULL."""
    return let(number(v), lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x))
