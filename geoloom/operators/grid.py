"""Tile grids, viewports and their bounding boxes."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import coords as C


@dataclass(frozen=True)
class TileSet:
    """A window of nx x ny tiles, each width local units wide; located by at()."""

    nx: int
    ny: int
    width: float
    precision: int = 1
    lon: float | None = None
    lat: float | None = None
    zoom: int | None = None

    def __post_init__(self) -> None:
        for name in ("nx", "ny", "precision"):
            v = getattr(self, name)
            if isinstance(v, bool) or not isinstance(v, int) or v <= 0:
                raise ValueError(f"{name} must be a positive integer")
        if not math.isfinite(self.width) or self.width <= 0:
            raise ValueError("width must be finite and greater than zero")

    def at(self, lat: float, lon: float, zoom: int) -> TileSet:
        return replace(self, lat=lat, lon=lon, zoom=zoom)

    def located(self, what: str) -> TileSet:
        if self.zoom is None:
            raise RuntimeError(f"the tile set must be located before you can {what}")
        return self

    @property
    def corner(self) -> tuple[int, int]:
        """Tile in the south-west corner: x of the first column, y of the first row (rows go north)."""
        self.located("find its corner")
        n = 2.0**self.zoom
        phi = math.radians(self.lat)
        x = math.floor((self.lon + 180.0) / 360.0 * n)
        y = math.floor((1.0 - math.log(math.tan(phi) + 1.0 / math.cos(phi)) / math.pi) / 2.0 * n)
        return x - self.nx // 2, y + self.ny // 2

    @property
    def xmin(self) -> float:
        return -self.width * self.nx / 2

    @property
    def zmin(self) -> float:
        return -self.width * self.ny / 2

    @property
    def scale(self) -> float | None:
        """Local units a metre; None at zoom 0."""
        self.located("scale it")
        metres = 0.0 if self.zoom == 0 else C.EQUATOR * math.cos(math.radians(self.lat)) / 2.0**self.zoom
        return self.width / metres if metres else None

    # Columns between tiles and the local plane.
    def tile_to_plane(self, x: Column, y: Column) -> Column:
        cx, cy = self.corner
        # The first row's north edge lies one tile above its south edge at zmin.
        return C.xz(F.lit(self.xmin) + (x - cx) * self.width, F.lit(self.zmin + self.width) - (y - cy) * self.width)

    def plane_to_tile(self, x: Column, z: Column) -> Column:
        cx, cy = self.corner
        return F.struct(((x - self.xmin) / self.width + cx).alias("x"), (F.lit(float(cy)) - (z - (self.zmin + self.width)) / self.width).alias("y"))

    def lonlat_to_plane(self, lon: Column, lat: Column) -> Column:
        z = F.lit(self.zoom)
        return self.tile_to_plane(C.lon_to_tile_exact(lon, z), C.lat_to_tile_exact(lat, z))

    def source_to_plane(self, x: Column, y: Column, epsg: Column) -> Column:
        t = C.to_tile_exact(x, y, epsg, F.lit(self.zoom))
        return self.tile_to_plane(t["x"], t["y"])

    def plane_to_lonlat(self, x: Column, z: Column) -> Column:
        t = self.plane_to_tile(x, z)
        return C.tile_to_lonlat(t["x"], t["y"], F.lit(self.zoom))

    def grid(self, spark: SparkSession) -> DataFrame:
        """One row a tile, row by row from the south-west: idx, i, j, z, x, y, centre, box and whether the id exists."""
        cx, cy = self.corner
        idx = spark.range(self.nx * self.ny).select(F.col("id").alias("idx"), (F.col("id") % self.nx).alias("i"), F.floor(F.col("id") / self.nx).alias("j"))
        x, y = F.lit(cx) + F.col("i"), F.lit(cy) - F.col("j")
        n = 2**self.zoom
        centre_x, centre_z = F.lit(self.xmin) + (F.col("i") + 0.5) * self.width, F.lit(self.zmin) + (F.col("j") + 0.5) * self.width
        half = self.width / 2
        return idx.select("idx", "i", "j", F.lit(self.zoom).alias("z"), x.alias("x"), y.alias("y"), centre_x.alias("centre_x"), centre_z.alias("centre_z"), (centre_x - half).alias("min_x"), (centre_x + half).alias("max_x"), (centre_z - half).alias("min_z"), (centre_z + half).alias("max_z"), (x.between(0, n - 1) & y.between(0, n - 1)).alias("valid"))


def tile_box(x: Column, y: Column, zoom: Column) -> Column:
    """STRUCT min_lat, min_lon, max_lat, max_lon of a tile."""
    return F.struct(C.tile_to_lat(y + 1, zoom).alias("min_lat"), C.tile_to_lon(x, zoom).alias("min_lon"), C.tile_to_lat(y, zoom).alias("max_lat"), C.tile_to_lon(x + 1, zoom).alias("max_lon"))


def tiles_box(tiles: DataFrame) -> DataFrame:
    """One row: the box around all tiles (columns z, x, y of one zoom)."""
    e = tiles.groupBy("z").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    z = F.col("z")
    return e.select("z", C.tile_to_lat(F.col("y1") + 1, z).alias("min_lat"), C.tile_to_lon(F.col("x0"), z).alias("min_lon"), C.tile_to_lat(F.col("y0"), z).alias("max_lat"), C.tile_to_lon(F.col("x1") + 1, z).alias("max_lon"))


def corners_inside(box: Column, tile: Column) -> Column:
    """Whether a footprint (min_x, max_x, min_z, max_z) lies within a tile's box, edges included."""
    return (box["min_x"] >= tile["min_x"]) & (box["max_x"] <= tile["max_x"]) & (box["min_z"] >= tile["min_z"]) & (box["max_z"] <= tile["max_z"])


def best_tile(spec: TileSet, x: Column, z: Column, last_tile: bool = False) -> Column:
    """Index of the tile that holds a local point; on a shared edge the west or south one.

    A point outside goes to the nearest tile by centre, or to the last one for compatibility. No join is needed: the
    tile's number follows from the point.
    """
    u, v = (x - spec.xmin) / spec.width, (z - spec.zmin) / spec.width
    inside = u.between(0.0, float(spec.nx)) & v.between(0.0, float(spec.ny))
    cell = lambda t, n: F.greatest(F.least(F.ceil(t) - 1, F.lit(n - 1)), F.lit(0))
    nearest = cell(v, spec.ny) * spec.nx + cell(u, spec.nx)
    return F.when(inside | F.lit(not last_tile), nearest).otherwise(F.lit(spec.nx * spec.ny - 1)).cast("bigint")


def window_shift(grid: DataFrame, spec: TileSet, dx: float, dz: float, limit: int | None = None) -> DataFrame:
    """The grid after moving all tiles by (dx, dz): tiles whose centre left the window come in on the other side.

    At most limit tiles (by index) are reloaded at once; moved tiles beyond that keep their place outside for the next
    call. Adds reloaded.
    """
    cx, cz = F.col("centre_x") + dx, F.col("centre_z") + dz
    w, h = spec.width * spec.nx, spec.width * spec.ny
    side = lambda v, half: F.when(v < -half, 1).when(v > half, -1).otherwise(0)
    sx, sz = side(cx, w / 2), side(cz, h / 2)
    left = (sx != 0) | (sz != 0)
    moved = grid.select("idx", "z", "x", "y", cx.alias("cx"), cz.alias("cz"), sx.alias("sx"), sz.alias("sz"), left.alias("left"))
    if limit is None:
        chosen = moved.withColumn("reloaded", F.col("left"))
    else:
        first = moved.filter("left").orderBy("idx").limit(limit).select("idx", F.lit(True).alias("reloaded"))
        chosen = moved.join(first, "idx", "left").withColumn("reloaded", F.coalesce("reloaded", F.lit(False)))
    go = lambda c: F.when(F.col("reloaded"), F.col(c)).otherwise(0)
    return chosen.select("idx", "z", (F.col("x") + go("sx") * spec.nx).alias("x"), (F.col("y") - go("sz") * spec.ny).alias("y"), (F.col("cx") + go("sx") * w).alias("centre_x"), (F.col("cz") + go("sz") * h).alias("centre_z"), "reloaded")


def parent_tiles(tiles: DataFrame, zoom: int, parent_zoom: int) -> DataFrame:
    """Distinct tiles parent_zoom that cover the given tiles of zoom."""
    up = zoom - parent_zoom
    if up < 0:
        raise ValueError(f"parents at zoom {parent_zoom} need tiles at zoom {parent_zoom} or deeper")
    return tiles.select(F.lit(parent_zoom).alias("z"), C.parent_tile(F.col("x"), up).alias("x"), C.parent_tile(F.col("y"), up).alias("y")).distinct()


def desired_diff(loaded: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tiles to 'dispose' (loaded, not wanted) and to 'load' (wanted, not loaded); both keyed by z, x, y."""
    key = ["z", "x", "y"]
    gone = loaded.join(wanted, key, "left_anti").select(*key, F.lit("dispose").alias("action"))
    return gone.unionByName(wanted.join(loaded, key, "left_anti").select(*key, F.lit("load").alias("action")))


def without_tiles(tiles: DataFrame, excluded: DataFrame) -> DataFrame:
    return tiles.join(excluded, ["z", "x", "y"], "left_anti")


def model_transform(spec: TileSet, x: Column, y: Column, source_zoom: int = 14, extent: int = 8192, exaggeration: float = 1.0) -> Column:
    """Where a model tile's root stands: position, scale (mirrored in x) and tilt."""
    if not math.isfinite(exaggeration) or exaggeration <= 0:
        raise ValueError("exaggeration must be finite and greater than zero")
    if spec.located("place models").zoom < source_zoom:
        raise ValueError(f"models need zoom {source_zoom} or deeper")
    z = F.lit(source_zoom)
    p = spec.lonlat_to_plane(C.tile_to_lon(x, z), C.tile_to_lat(y, z))
    h = spec.width * 2.0 ** (spec.zoom - source_zoom) / extent
    return F.struct(p["x"].alias("x"), p["z"].alias("z"), F.lit(-h).alias("scale_x"), F.lit(h).alias("scale_y"), F.lit((spec.scale or 0.0) * exaggeration).alias("scale_z"), F.lit(-math.pi / 2).alias("tilt"))
