"""Missing values filled from similar records by sequential hot deck.

Rows are sorted once by group (coarse to fine), time and id, in ranges of about equal size, so that no group, however
hot, ends up in one task. Each missing value takes the nearest observed donor before or after it in that order: one
of the same finest group if there is one, else of the coarser group, else the next at all; among equals the nearer in
time. Donors beyond a range's ends are carried over from a table with one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators import units as U
from geoloom.session import scratch


def spread(df: DataFrame, keys: list[str], ranges: int) -> DataFrame:
    """df in ranges of the sort order, with the range's number in __pid, written once to the shared folder.

    The order of the ranges has to be the same for all later readers, but a range partitioning is sampled anew by
    each execution; hence the table.
    """
    at = f"{scratch(df.sparkSession, 'hotdeck')}/rows"
    df.repartitionByRange(ranges, *keys).withColumn("__pid", F.spark_partition_id()).write.parquet(at)
    return df.sparkSession.read.parquet(at)


def hot_deck(df: DataFrame, fields: list[str], groups: list[str], time: str, row_id: str, ranges: int | None = None) -> DataFrame:
    """df's row_id and, for each field f: f (filled), f_was_missing, f_donor, f_donor_gap and f_donor_level.

    groups go from coarse to fine; a null group value is a value of its own. Rows without a time come first in their
    group. f_donor is the donor's row_id (null: observed, or no donor in the whole table: f stays null), f_donor_gap
    the seconds between the two rows (null without times), f_donor_level how many of groups donor and row share.
    Ties go to the row before. Repeated rows are rows like any other, and a repeated id is harmless. Columns are
    renamed within, so clashing names don't matter.
    """
    keys = [f"__g{i}" for i in range(len(groups))]
    own = df.select(F.col(row_id).alias("__id"), F.col(time).cast("timestamp").cast("double").alias("__t"), *(F.col(g).cast("string").alias(k) for g, k in zip(groups, keys, strict=True)), *(F.col(f).cast("double").alias(f"__f{i}") for i, f in enumerate(fields)))
    order = [*keys, "__t", "__id"]
    n = ranges or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    base = spread(own, order, n)

    cards = range(len(fields))
    donor = lambda i: F.when(F.col(f"__f{i}").isNotNull(), F.struct(F.col(f"__f{i}").alias("value"), *keys, "__t", "__id"))
    position = F.struct(*order)
    # One row a range: its last and first donors of each field, then those of the ranges before and after.
    ends = base.groupBy("__pid").agg(*(F.max_by(donor(i), F.when(F.col(f"__f{i}").isNotNull(), position)).alias(f"last{i}") for i in cards), *(F.min_by(donor(i), F.when(F.col(f"__f{i}").isNotNull(), position)).alias(f"first{i}") for i in cards))
    before, after = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("__pid").asc(), F.col("__pid").desc()))
    carried = ends.select("__pid", *(F.last(f"last{i}", ignorenulls=True).over(before).alias(f"in{i}") for i in cards), *(F.last(f"first{i}", ignorenulls=True).over(after).alias(f"out{i}") for i in cards))

    up = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("__pid").orderBy(*(F.col(c).desc() for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    near = base.select("*", *(F.last(donor(i), ignorenulls=True).over(up).alias(f"p{i}") for i in cards))
    near = near.select("*", *(F.last(donor(i), ignorenulls=True).over(down).alias(f"n{i}") for i in cards))
    near = near.join(carried, "__pid", "left")

    def shared(d: Column) -> Column:
        level = F.lit(0)
        same = F.lit(True)
        for k in keys:
            same = same & d[k].eqNullSafe(F.col(k))
            level = level + F.when(same, 1).otherwise(0)
        return level

    out = [F.col("__id").alias(row_id)]
    for i, f in enumerate(fields):
        prev, nxt = F.coalesce(f"p{i}", f"in{i}"), F.coalesce(f"n{i}", f"out{i}")
        gap = lambda d: F.abs(F.col("__t") - d["__t"])
        far = F.lit(float("inf"))
        take_next = nxt.isNotNull() & (prev.isNull() | (shared(nxt) > shared(prev)) | ((shared(nxt) == shared(prev)) & (F.coalesce(gap(nxt), far) < F.coalesce(gap(prev), far))))
        d = F.when(take_next, nxt).otherwise(prev)
        missing = F.col(f"__f{i}").isNull()
        out += [
            F.when(missing, d["value"]).otherwise(F.col(f"__f{i}")).alias(f),
            missing.alias(f"{f}_was_missing"),
            F.when(missing, d["__id"]).alias(f"{f}_donor"),
            F.when(missing, gap(d)).alias(f"{f}_donor_gap"),
            F.when(missing & d.isNotNull(), shared(d)).alias(f"{f}_donor_level"),
        ]
    return near.select(*out)


BUILDINGS = ("Polygon", "MultiPolygon")


def measured_buildings(features: DataFrame, providers: DataFrame) -> DataFrame:
    """Polygon rows with height_m, levels_n and roof_m, null where the field holds no measurement."""
    b = features.filter(F.col("geometry_type").isin(*BUILDINGS))
    q = b.select("row_id", "provider", "district", "building_type", F.coalesce("observed_at", "loaded_at").alias("at"), *(U.quantity(c).alias(f"{c}_q") for c in ("height", "levels", "roof_height")), *(U.stand_in(F.col(c)).alias(f"{c}_stand_in") for c in ("height", "levels", "roof_height")))
    units = U.bare_units(b.select("provider", U.quantity("height").alias("height_q"), U.stand_in(F.col("height")).alias("height_stand_in")), providers)
    length = F.array(*map(F.lit, U.LENGTH))
    bare = lambda c: F.col(f"{c}_q.unit") == ""
    height = F.col("height_q.value") * F.when(bare("height"), F.coalesce("bare_scale", F.lit(1.0))).otherwise(1.0)
    storeys = F.when(F.col("levels_q.dims") == length, F.greatest(F.lit(1.0), F.round(F.col("levels_q.value") / U.STOREY_M))).otherwise(F.col("levels_q.value"))
    roof = F.col("roof_height_q.value")
    fits = lambda c, dims: ~F.col(f"{c}_stand_in") & (bare(c) | F.col(f"{c}_q.dims").isin(*dims))
    return q.join(units, "provider", "left").select(
        "row_id", "district", "building_type", "at",
        F.when(fits("height", [length]) & (height > 0) & (height <= U.MOST_METRES), height).alias("height"),
        F.when(fits("levels", [length, F.array(*map(F.lit, U.STOREY))]) & (storeys > 0) & (storeys <= U.MOST_STOREYS), storeys).alias("levels"),
        F.when(fits("roof_height", [length]) & (roof >= 0) & (roof <= U.MOST_ROOF), roof).alias("roof_height"),
    )


FIELDS = ["height", "levels", "roof_height"]


def fill_buildings(features: DataFrame, providers: DataFrame) -> DataFrame:
    """Heights, levels and roof heights of all buildings, filled from the district and building type, by time."""
    return hot_deck(measured_buildings(features, providers), FIELDS, ["district", "building_type"], "at", "row_id")


def filled_values(filled: DataFrame) -> DataFrame:
    """row_id and field of each value that was missing."""
    stack = ", ".join(f"'{f}', {f}_was_missing" for f in FIELDS)
    return filled.select("row_id", F.expr(f"stack({len(FIELDS)}, {stack}) AS (field, was_missing)")).filter("was_missing").select("row_id", "field")
