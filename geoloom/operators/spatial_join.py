"""Spatial joins as equi-joins on grid cells, with the exact test behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.session import cut


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size).cast("bigint"), F.floor(hi / size).cast("bigint"))


def _visited(segments: DataFrame, cell: float) -> DataFrame:
    """segments in each cell they run through, cx and cz: column by column, so that a long diagonal has no more cells than a long street."""
    slack = cell * 1e-9  # a hair, so that a point on a border is in the cell it is computed to be in
    e = segments.withColumn("cx", F.explode(_cells(F.col("lx") - slack, F.col("hx") + slack, cell)))
    rise = F.try_divide(F.col("z2") - F.col("z1"), F.col("x2") - F.col("x1"))
    # Between the column's edges; all of an upright one.
    at = lambda x, upright: F.when(rise.isNull(), upright).otherwise(F.least(F.greatest(F.col("z1") + (x - F.col("x1")) * rise, F.col("lz")), F.col("hz")))
    a = at(F.greatest(F.col("lx"), F.col("cx") * cell - slack), F.col("lz"))
    b = at(F.least(F.col("hx"), (F.col("cx") + 1) * cell + slack), F.col("hz"))
    return e.withColumn("cz", F.explode(_cells(F.least(a, b) - slack, F.greatest(a, b) + slack, cell)))


def street_intersections(segments: DataFrame, cell: float, all_hits: bool = False) -> DataFrame:
    """Where streets meet: street_a < street_b, x, y and the directions of the two segments.

    segments has street, seq, x1, z1, x2, z2. Each is put into the cells it runs through; two meet in the cell of
    their common point, so that no pair comes twice. Only the first hit of a pair (by seq of a, then of b; ties by
    x and y) is reported, unless all_hits. Segments of no length and null ends meet nothing.
    """
    s = segments.filter("x1 IS NOT NULL AND z1 IS NOT NULL AND x2 IS NOT NULL AND z2 IS NOT NULL AND street IS NOT NULL").select("street", "seq", "x1", "z1", "x2", "z2", F.least("x1", "x2").alias("lx"), F.greatest("x1", "x2").alias("hx"), F.least("z1", "z2").alias("lz"), F.greatest("z1", "z2").alias("hz"))
    # One number for each cell, which sorts by itself; a segment is its box and the corners it runs between, as boxes are what nearly all pairs are told apart by.
    number = lambda cx, cz: F.shiftleft(cx, 32).bitwiseXOR(cz)
    way = F.when(F.col("x1") > F.col("x2"), 1).otherwise(0) + F.when(F.col("z1") > F.col("z2"), 2).otherwise(0)
    e = _visited(s, cell).select(number(F.col("cx"), F.col("cz")).alias("cell"), "street", "seq", "lx", "hx", "lz", "hz", way.alias("way"))
    a, b = (e.select("cell", *(F.col(c).alias(f"{c}_{k}") for c in e.columns[1:])) for k in "ab")
    j = a.join(b, "cell").filter("street_a < street_b AND lx_a <= hx_b AND lx_b <= hx_a AND lz_a <= hz_b AND lz_b <= hz_a")
    for k in "ab":
        back, down = (F.col(f"way_{k}").bitwiseAND(bit) > 0 for bit in (1, 2))
        pick = lambda turned, one, other, k=k: F.when(turned, F.col(f"{one}_{k}")).otherwise(F.col(f"{other}_{k}"))
        j = j.withColumns({f"x1_{k}": pick(back, "hx", "lx"), f"z1_{k}": pick(down, "hz", "lz"), f"x2_{k}": pick(back, "lx", "hx"), f"z2_{k}": pick(down, "lz", "hz")})
    col = lambda k: tuple(F.col(f"{c}_{k}") for c in ("x1", "z1", "x2", "z2"))
    ids, dirs = ["street_a", "street_b", "seq_a", "seq_b"], [G.direction(*col(k)).alias(f"dir_{k}") for k in "ab"]
    # Not a filter: Catalyst would write it into the join's condition, a method then too long for the JVM to compile, run for each pair of a cell.
    hit = j.select(*ids, "cell", *dirs, F.explode(F.array(G.intersection(col("a"), col("b")))).alias("p")).filter("p IS NOT NULL")
    hit = hit.filter(number(F.floor(F.col("p.x") / cell), F.floor(F.col("p.y") / cell)) == F.col("cell")).select(*ids, F.col("p.x").alias("x"), F.col("p.y").alias("y"), "dir_a", "dir_b")
    if all_hits:
        return hit
    first = F.row_number().over(Window.partitionBy("street_a", "street_b").orderBy("seq_a", "seq_b", "x", "y"))
    return hit.repartition("street_a", "street_b").withColumn("n", first).filter("n = 1").select("street_a", "street_b", "x", "y", "dir_a", "dir_b")


def keepers(edges: DataFrame) -> DataFrame:
    """at and keeper (the earliest kept one it touches) of what is dropped, taken in order: only kept ones drop others.

    edges: at touches earlier. Each round keeps what touches nothing earlier any more and drops what touches it.
    """
    left, done = cut(edges), None
    while not left.isEmpty():
        kept = left.select(F.col("earlier").alias("k")).join(left.select(F.col("at").alias("k")), "k", "left_anti").distinct()
        hit = cut(left.join(kept.withColumnRenamed("k", "earlier"), "earlier").groupBy("at").agg(F.min("earlier").alias("keeper")))
        done = hit if done is None else done.unionByName(hit)
        gone = hit.select("at").unionByName(kept.select(F.col("k").alias("at"))).distinct()
        left = cut(left.join(gone, "at", "left_anti").join(gone.withColumnRenamed("at", "earlier"), "earlier", "left_anti"))
    return left.select("at", F.col("earlier").alias("keeper")) if done is None else done


def duplicate_shapes(shapes: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """id and keeper of shapes whose corners, in order, lie within tolerance in sum of an earlier kept one.

    shapes has id, seq (arrival; ties by id), points ARRAY<STRUCT x, z> and contained: shapes wholly on their tile
    are neither compared nor compared against. Of one outline only the earliest shape is compared, so copies never
    meet; outlines are told apart by two hashes (96 bits). Blocks are the number of corners and a cell of the first
    corner a few times the tolerance wide, so that what meets in one is nearly alike, too.
    """
    outline = [F.xxhash64("points").alias("h1"), F.hash("points").alias("h2")]
    own = shapes.filter("NOT contained AND points IS NOT NULL AND size(points) > 0").select("id", F.struct("seq", "id").alias("at"), *outline, "points")
    first = own.groupBy("h1", "h2").agg(F.min_by(F.struct("at", "points"), "at").alias("f")).select("h1", "h2", "f.*")
    cell = 16 * tolerance
    q = lambda c, d: F.floor((F.col("points")[0][c] + d) / cell).cast("bigint")
    base = first.select("at", "points", F.size("points").alias("n"))
    listed = base.select("n", q("x", 0.0).alias("cx"), q("z", 0.0).alias("cz"), F.col("at").alias("earlier"), F.col("points").alias("points_a"))
    both = lambda c: F.explode(F.array_distinct(F.array(q(c, -tolerance), q(c, tolerance))))
    probe = base.withColumn("cx", both("x")).withColumn("cz", both("z"))
    near = probe.join(listed, ["n", "cx", "cz"]).filter((F.col("earlier") < F.col("at")) & (G.vertex_error(F.col("points_a"), F.col("points")) < tolerance))
    leader = first.select("h1", "h2", "at").join(keepers(near.select("at", "earlier")), "at", "left").select("h1", "h2", F.coalesce("keeper", "at").alias("keeper"))
    return own.drop("points").join(leader, ["h1", "h2"]).filter("at <> keeper").select("id", F.col("keeper.id").alias("keeper"))


def near_earlier(points: DataFrame, distance: float = 1.0) -> DataFrame:
    """id, earlier and gap: points closer than distance, each pair once, the earlier id second."""
    p = points.filter("x IS NOT NULL AND z IS NOT NULL").select("id", "x", "z", F.floor(F.col("x") / distance).cast("bigint").alias("cx"), F.floor(F.col("z") / distance).cast("bigint").alias("cz"))
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    probe = p.withColumn("cx", around("cx")).withColumn("cz", around("cz"))
    b = p.select(F.col("id").alias("earlier"), F.col("x").alias("bx"), F.col("z").alias("bz"), "cx", "cz")
    gap = F.hypot(F.col("x") - F.col("bx"), F.col("z") - F.col("bz"))
    return probe.join(b, ["cx", "cz"]).filter("earlier < id").withColumn("gap", gap).filter(F.col("gap") < distance).select("id", "earlier", "gap")


def merge_by_tile(features: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Tiles with more than one feature, and how many; the members stay in a table of their own, keyed by tile.

    Nothing is gathered into one row, so that a tile with a third of all features is as good as any other.
    """
    return features.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("first"), F.max(value).alias("last")).filter("n > 1")


def first_requests(requests: DataFrame, url: str, order: Column) -> DataFrame:
    """One request for each URL, the first; the others are answered from its result."""
    return requests.filter(F.col(url).isNotNull()).groupBy(url).agg(F.min(order).alias("first"), F.count("*").alias("requests"))
