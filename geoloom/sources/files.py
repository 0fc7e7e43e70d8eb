"""Files: GeoJSON bodies, delimited points, opaque model tiles and saved responses."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "latitude double, longitude double, short_description string, long_description string"
FEATURE = "id variant, type string, properties variant, geometry struct<type: string, coordinates: variant, geometries: variant>"


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """path, feature_no, crs and one feature a row of GeoJSON files; unreadable bodies give no features."""
    body = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.try_parse_json("value").alias("v"))
    return features_of(body, ["path"])


def features_of(bodies: DataFrame, keep: list[str], v: str = "v") -> DataFrame:
    """Features of collections given as VARIANT, with their place, id, type, properties, geometry type and coordinates."""
    listed = bodies.select(*keep, F.try_variant_get(v, "$.crs", "variant").alias("crs"), F.posexplode(F.try_variant_get(v, "$.features", "array<variant>")).alias("feature_no", "f"))
    get = lambda p, t: F.try_variant_get("f", p, t)
    return listed.select(*keep, "crs", "feature_no", get("$.id", "string").alias("id"), get("$.type", "string").alias("type"), get("$.properties", "variant").alias("properties"), get("$.geometry.type", "string").alias("geometry_type"), get("$.geometry.coordinates", "variant").alias("coordinates"))


def csv_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of CSV files with a header, latitude first; quoted fields may hold commas and line breaks."""
    return spark.read.csv(path, schema=POINTS, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE").select("longitude", "latitude", "short_description", "long_description")


def model_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Model files (names z_x_y.glb) as z, x, y and opaque content."""
    parts = F.regexp_extract_all("path", F.lit(r"(\d+)_(\d+)_(\d+)\.[^/]*$"), F.lit(0))
    number = lambda i: F.regexp_extract("path", r"(\d+)_(\d+)_(\d+)\.[^/]*$", i).cast("bigint")
    return spark.read.format("binaryFile").load(path).filter(F.size(parts) > 0).select(number(1).cast("int").alias("z"), number(2).alias("x"), number(3).alias("y"), "content")


class RasterProvider(ABC):
    """Where a provider's tile images are; subclass it for a service of your own."""

    name = ""

    @abstractmethod
    def url(self, z: Column, x: Column, y: Column, index: Column) -> Column: ...

    def save(self, tiles: DataFrame, folder: str) -> None:  # noqa: B027
        """Most providers' images aren't kept."""


class NoRaster(RasterProvider):
    def url(self, z: Column, x: Column, y: Column, index: Column) -> Column:
        return F.lit("")


class FeatureProvider(ABC):
    """A source of features; subclasses say how a tile is asked for and what its answers' projection is."""

    epsg: int | None = None
    flip_winding = False

    @abstractmethod
    def request(self, z: Column, x: Column, y: Column, index: Column) -> Column: ...

    def prefix(self, url: Column) -> Column:
        """What mirrors share; the whole address by default."""
        return url
