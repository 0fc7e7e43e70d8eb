"""Coordinate algebra as column expressions: longitude/latitude, Web Mercator, map tiles and the local plane.

Columns in, columns out, so that the optimizer folds, prunes and compiles them. Longitude and latitude are degrees,
zoom an integer; tile y grows southward. The local plane has x east and z north, with the tile set's centre at 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Web-Mercator radius and half width, metres around the equator, projection codes.
RADIUS = 6378137.0
HALF_WIDTH = 20037508.342789244
EQUATOR = 40075016.686
EPSG_3857, EPSG_4326 = 0, 1


def _n(zoom: Column) -> Column:
    return F.pow(F.lit(2.0), zoom)


def lon_to_tile_exact(lon: Column, zoom: Column) -> Column:
    return (lon + 180.0) / 360.0 * _n(zoom)


def lat_to_tile_exact(lat: Column, zoom: Column) -> Column:
    """South edge at the northernmost latitudes is 0; beyond ±90 and at the poles there is no tile (null)."""
    phi = F.radians(lat)
    y = (1.0 - F.log(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0 * _n(zoom)
    return F.when((lat > -90.0) & (lat < 90.0), y)


def lon_to_tile(lon: Column, zoom: Column) -> Column:
    return F.floor(lon_to_tile_exact(lon, zoom)).cast("bigint")


def lat_to_tile(lat: Column, zoom: Column) -> Column:
    return F.floor(lat_to_tile_exact(lat, zoom)).cast("bigint")


def tile_to_lon(x: Column, zoom: Column) -> Column:
    return x / _n(zoom) * 360.0 - 180.0


def tile_to_lat(y: Column, zoom: Column) -> Column:
    n = math.pi - 2.0 * math.pi * y / _n(zoom)
    return F.degrees(F.atan(0.5 * (F.exp(n) - F.exp(-n))))


def tile_to_lonlat(x: Column, y: Column, zoom: Column) -> Column:
    return F.struct(tile_to_lon(x, zoom).alias("lon"), tile_to_lat(y, zoom).alias("lat"))


def mercator_to_lonlat(x: Column, y: Column) -> Column:
    lon = F.degrees(x / RADIUS)
    lat = F.degrees(math.pi / 2 - 2.0 * F.atan(F.exp(-y / RADIUS)))
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def sign(x: Column) -> Column:
    """-1, 0 or 1."""
    return F.signum(x)


def lonlat_to_mercator(lon: Column, lat: Column) -> Column:
    """Longitudes beyond ±180 are wrapped once; both axes are clamped to the square map, poles included."""
    wrapped = F.when(F.abs(lon) <= 180.0, lon).otherwise(lon - sign(lon) * 360.0)
    clamp = lambda v: F.least(F.greatest(v, F.lit(-HALF_WIDTH)), F.lit(HALF_WIDTH))
    y = F.when(lat <= -90.0, -HALF_WIDTH).when(lat >= 90.0, HALF_WIDTH).otherwise(RADIUS * F.log(F.tan(math.pi / 4 + F.radians(lat) * 0.5)))
    return F.struct(clamp(RADIUS * F.radians(wrapped)).alias("x"), clamp(y).alias("y"))


def to_tile_exact(x: Column, y: Column, epsg: Column, zoom: Column) -> Column:
    """Unfloored tile position of a coordinate in either projection; null for an unknown projection."""
    ll = mercator_to_lonlat(x, y)
    lon = F.when(epsg == EPSG_4326, x).when(epsg == EPSG_3857, ll["lon"])
    lat = F.when(epsg == EPSG_4326, y).when(epsg == EPSG_3857, ll["lat"])
    return F.struct(lon_to_tile_exact(lon, zoom).alias("x"), lat_to_tile_exact(lat, zoom).alias("y"))


def to_tile(x: Column, y: Column, epsg: Column, zoom: Column) -> Column:
    t = to_tile_exact(x, y, epsg, zoom)
    return F.struct(F.floor(t["x"]).cast("bigint").alias("x"), F.floor(t["y"]).cast("bigint").alias("y"))


def parent_tile(v: Column, levels: int) -> Column:
    """Tile number that many zoom levels up."""
    return F.shiftright(v, levels)


def tile_width_m(lat: Column, zoom: Column) -> Column:
    """Metres on the ground of a tile's side; 0 at zoom 0, which stands for 'not set up'."""
    return F.when(zoom == 0, F.lit(0.0)).otherwise(EQUATOR * F.cos(F.radians(lat)) / _n(zoom))


def tile_scale(tile_width: Column, lat: Column, zoom: Column) -> Column:
    """Local units a metre; null at zoom 0."""
    return F.try_divide(tile_width, tile_width_m(lat, zoom))


def xz(x: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), z.alias("z"))


def plane_to_3d(v: Column) -> Column:
    return F.struct(v["x"].alias("x"), F.lit(0.0).alias("y"), v["z"].alias("z"))


def plane_of_3d(v: Column) -> Column:
    return F.struct(v["x"].alias("x"), v["z"].alias("z"))


def session_token(random: Column | None = None) -> Column:
    """'1', '01' and ten random base-62 digits: nondeterministic, for request URLs only."""
    digits = F.lit("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return F.concat(F.lit("101"), *(F.substring(digits, (F.floor(F.rand() * 62) + 1).cast("int"), F.lit(1)) for _ in range(10)))
