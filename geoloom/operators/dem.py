"""Elevation tiles: decoding, statistics, resampling and seams, as stateless expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def height(r: Column, g: Column, b: Column) -> Column:
    """Metres from the three bytes of an elevation pixel."""
    return F.lit(-10000.0) + (r * 65536.0 + g * 256.0 + b) * F.lit(0.1)


def stats(pixels: DataFrame, keys: list[str], value: str = "h") -> DataFrame:
    """min_h and max_h by tile."""
    return pixels.groupBy(*keys).agg(F.min(value).alias("min_h"), F.max(value).alias("max_h"))


def lowest(stats: DataFrame) -> DataFrame:
    """One row: the lowest height of all tiles so far, over a table as over a stream (complete mode: it is never reset)."""
    return stats.agg(F.min("min_h").alias("lowest"))


def sample_index(k: Column, precision: int, size: Column) -> Column:
    """Pixel number that vertex k of precision + 1 takes, of size pixels."""
    return F.floor(k / F.lit(float(precision)) * (size - 1)).cast("int")


def resample(tiles: DataFrame, precision: int, scale: float = 1.0) -> DataFrame:
    """z, x, y, row, col and h of (precision + 1)² vertices of each tile, from dem ARRAY<DOUBLE> of width x height."""
    if precision <= 0:
        raise ValueError("precision must be positive")
    vertices = tiles.select("z", "x", "y", "dem", "width", "height", F.explode(F.sequence(F.lit(0), F.lit(precision))).alias("row"))
    vertices = vertices.select("*", F.explode(F.sequence(F.lit(0), F.lit(precision))).alias("col"))
    at = sample_index(F.col("row"), precision, F.col("height")) * F.col("width") + sample_index(F.col("col"), precision, F.col("width"))
    return vertices.select("z", "x", "y", "row", "col", (F.get("dem", at) * F.lit(float(scale))).alias("h"))


def fix_seams(vertices: DataFrame, precision: int) -> DataFrame:
    """Vertices with h taken from the neighbours on the north row, the east column and their corner.

    North-east before east before north before own. Missing neighbours leave the own height. Only the vertices of the
    edges are joined; the others pass through.
    """
    p = precision
    # What a neighbour lends: its last row to the south, its first column to the west, its corner to the south-west.
    lent = vertices.filter(f"row = {p} OR col = 0").select(
        "z",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("row") == p, F.struct(F.col("x").alias("x"), (F.col("y") + 1).alias("y"), F.lit(0).alias("row"), F.col("col").alias("col"), F.lit(3).alias("rank"))),
                    F.when(F.col("col") == 0, F.struct((F.col("x") - 1).alias("x"), F.col("y").alias("y"), F.col("row").alias("row"), F.lit(p).alias("col"), F.lit(2).alias("rank"))),
                    F.when((F.col("row") == p) & (F.col("col") == 0), F.struct((F.col("x") - 1).alias("x"), (F.col("y") + 1).alias("y"), F.lit(0).alias("row"), F.lit(p).alias("col"), F.lit(1).alias("rank"))),
                )
            )
        ).alias("t"),
        "h",
    )
    best = lent.select("z", "t.*", "h").groupBy("z", "x", "y", "row", "col").agg(F.min_by("h", "rank").alias("lent"))
    edge = f"row = 0 OR col = {p}"
    fixed = vertices.filter(edge).join(best, ["z", "x", "y", "row", "col"], "left").select("z", "x", "y", "row", "col", F.coalesce("lent", "h").alias("h"))
    return fixed.unionByName(vertices.filter(f"NOT ({edge})").select("z", "x", "y", "row", "col", "h"))
