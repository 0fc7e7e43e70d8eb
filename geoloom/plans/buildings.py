"""From response bodies to placed buildings, end to end: scan, coerce, project, assign to a tile, drop duplicates, mesh."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import features as X
from geoloom.functions import geometry as G
from geoloom.functions import js
from geoloom.operators import mesh, spatial_join
from geoloom.operators.grid import TileSet, best_tile, corners_inside
from geoloom.session import cut
from geoloom.sources.files import features_of

LINE_WIDTH, POINT_DIAMETER = 2.0, 0.5


def positive(what: str, v: float) -> float:
    if not math.isfinite(v) or v <= 0:
        raise ValueError(f"the {what} must be finite and greater than zero")
    return v


def point_marker(position: Column, diameter: float = POINT_DIAMETER) -> Column:
    """A point feature as centre and radius in the local plane."""
    return F.struct(position["x"].alias("x"), position["z"].alias("z"), F.lit(positive("diameter of points", diameter) / 2).alias("radius"))


def source_parts(coordinates: Column, geometry_type: Column) -> Column:
    """ARRAY parts of ARRAY rings of ARRAY positions, as given; a line is a ring of a part of its own, a point one position.

    coordinates (VARIANT) may be given as text. NULL where they don't have the type's nesting.
    """
    v = F.when(js.kind(coordinates) == "STRING", F.try_parse_json(js.text(coordinates))).otherwise(coordinates)
    nested = lambda depth: F.try_variant_get(v, "$", "array<" * depth + "double" + ">" * depth)
    return (
        F.when(geometry_type == "Polygon", F.array(nested(3)))
        .when(geometry_type == "MultiPolygon", nested(4))
        .when(geometry_type == "MultiLineString", F.transform(nested(3), lambda line: F.array(line)))
        .when(geometry_type == "Point", F.array(F.array(F.array(nested(1)))))
    )


def plane_parts(parts: Column, epsg: Column, spec: TileSet) -> Column:
    """The parts in the local plane; positions without two numbers, or off the map, are left out."""
    there = lambda p: spec.source_to_plane(F.get(p, F.lit(0)), F.get(p, F.lit(1)), epsg)
    ring = lambda r: F.filter(F.transform(r, there), lambda p: p["x"].isNotNull() & p["z"].isNotNull() & (F.abs(p["x"] + p["z"]) < float("inf")))
    return F.transform(parts, lambda rings: F.transform(rings, ring))


def outlined(parts: Column, route: Column, line_width: float) -> Column:
    """Parts that can be built: lines as outlines of the width asked for, areas and points as they are."""
    lines = F.transform(parts, lambda p: F.array(G.buffer_line(F.get(p, F.lit(0)), line_width)))
    kept = lambda ps: F.filter(ps, lambda p: F.coalesce(F.size(F.get(p, F.lit(0))), F.lit(0)) > 0)
    return F.when(route == "lines", kept(lines)).otherwise(kept(parts))


def place(bodies: DataFrame, keep: list[str], spec: TileSet, explicit_epsg: Column, default_height: float = X.DEFAULT_HEIGHT, requested: Column | None = None, line_width: float = LINE_WIDTH) -> DataFrame:
    """One row a feature: name, route, height, roof, projection, properties, parts and box in the plane, lines, tile, contained and reason.

    All data at once (requested is None): a feature goes to the tile that holds the middle of the box around all its
    parts, or to the nearest one. Tile by tile: requested (STRUCT z, x, y) is the tile it was asked for, which it
    keeps. contained tells whether the box lies wholly on the tile. parts has outer rings first; lines are the
    projected lines of line features. reason tells why a feature is set aside (no properties, unsupported geometry,
    unknown projection, no position, tile not shown); it is null for a placed one.
    """
    positive("width of lines", line_width)
    f = features_of(bodies, keep)
    # What later columns and filters use again and again is worked out once.
    f = js.once(f, "height", X.resolve_height(F.col("properties"), default_height)).withColumn("route", X.geometry_route(F.col("geometry_type")))
    f = js.once(f, "roof", X.roof_spec(F.col("properties"), F.col("height"))).withColumn("name", X.feature_name(F.col("properties"), F.col("id")))
    f = js.once(f, "epsg", X.resolve_projection(explicit_epsg, F.col("crs")))
    f = js.once(f, "drawn", F.when(F.col("epsg").isNotNull(), plane_parts(source_parts(F.col("coordinates"), F.col("geometry_type")), F.col("epsg"), spec)))
    f = js.once(f, "parts", outlined(F.col("drawn"), F.col("route"), line_width)).withColumn("lines", F.when(F.col("route") == "lines", F.transform("drawn", lambda p: F.get(p, F.lit(0)))))
    f = js.once(f, "corners", F.flatten(F.flatten("parts")))
    f = js.once(f, "box", G.bounds(F.col("corners")))
    x, z = (F.col("box.min_x") + F.col("box.max_x")) / 2, (F.col("box.min_z") + F.col("box.max_z")) / 2
    cx, cy = spec.corner
    if requested is None:
        tile = best_tile(spec, x, z)
    else:
        i, j = requested["x"] - cx, F.lit(cy) - requested["y"]
        shown = (requested["z"] == spec.zoom) & i.between(0, spec.nx - 1) & j.between(0, spec.ny - 1)
        tile = F.when(shown, (j * spec.nx + i).cast("bigint"))
    f = f.withColumn("tile", F.when(x.isNotNull() & z.isNotNull(), tile))
    west, south = F.lit(spec.xmin) + F.pmod("tile", F.lit(spec.nx)) * spec.width, F.lit(spec.zmin) + F.floor(F.col("tile") / spec.nx) * spec.width
    of_tile = F.struct(west.alias("min_x"), (west + spec.width).alias("max_x"), south.alias("min_z"), (south + spec.width).alias("max_z"))
    absent = F.col("properties").isNull() | F.is_variant_null("properties")
    reason = F.when(absent, "no properties").when(F.col("route").startswith("unsupported"), F.col("route")).when(F.col("epsg").isNull(), "unknown projection").when(x.isNull() | z.isNull(), "no position").when(F.col("tile").isNull(), "tile not shown")
    return f.select(*keep, "feature_no", "name", "route", "height", "roof", "epsg", "properties", "parts", "lines", "box", "tile", corners_inside(F.col("box"), of_tile).alias("contained"), reason.alias("reason"))


def without_duplicates(placed: DataFrame, key: list[str], seq: str) -> DataFrame:
    """placed (tile by tile) without buildings that an earlier tile's answer brought already; those wholly on their tile always stay."""
    placed = cut(placed)
    shapes = placed.filter("reason IS NULL").select(F.struct(*key).alias("id"), F.col(seq).alias("seq"), "contained", F.flatten(F.flatten("parts")).alias("points"))
    gone = spatial_join.duplicate_shapes(shapes).select(*(F.col(f"id.{k}").alias(k) for k in key))
    return placed.join(gone, key, "left_anti")


def meshes(placed: DataFrame, key: Column, spec: TileSet, exaggeration: float = 1.0) -> DataFrame:
    """One mesh a feature (key: bigint): its parts' meshes merged; points and features set aside have none."""
    areas = placed.filter("reason IS NULL AND route <> 'point'").select(key.alias("feature"), "height", "roof", F.posexplode("parts").alias("part", "rings"))
    numbered = areas.withColumn("id", F.xxhash64("feature", "part"))
    ground = F.when(F.col("roof").isNotNull(), F.col("roof.shape"))
    built = mesh.build(numbered.select("id", "rings", "height", ground.alias("shape"), F.col("roof.height").alias("roof_height"), F.col("roof.direction").alias("bearing")), (spec.scale or 0.0) * positive("exaggeration", exaggeration))
    # Vertices are numbered through the merged parts; a feature has few of them.
    parts = built.join(numbered.select("id", "feature", "part"), "id").groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("part", "wall_height", "roof_built", "n_triangles", "positions"))).alias("p"))
    return parts.select("feature", F.size("p").alias("n_parts"), F.aggregate("p", F.lit(0), lambda s, p: s + p["n_triangles"]).alias("n_triangles"), F.flatten(F.transform("p", lambda p: p["positions"])).alias("positions"))
