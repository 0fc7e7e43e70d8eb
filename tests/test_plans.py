"""What the plans must look like to hold at scale, and the end-to-end placement."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from geoloom.operators import hotdeck
from geoloom.operators.grid import TileSet
from geoloom.plans import buildings


def plan(spark, df):
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", ["street_intersections", "building_dedup", "near_overlap", "tile_diff", "tiles_excluded", "viewport_points", "dem_seams", "request_cache", "crs_detect", "p4_found", "p5_unified"])
def test_no_pairs_of_all_with_all(spark, small, name):
    p = plan(spark, E.queries()[name](spark, small))
    assert "CartesianProduct" not in p and "NestedLoop" not in p


@pytest.mark.parametrize(("name", "columns"), [("parent_tiles", {"o_orderkey"}), ("crs_detect", {"row_id", "provider", "crs", "usual_epsg"}), ("p1_found", {"line_id", "file_name", "line_no", "raw"}), ("geometry_routes", {"provider", "geometry_type"})])
def test_only_what_is_needed_is_read(spark, small, name, columns):
    p = plan(spark, E.queries()[name](spark, small))
    read = {c.split(":")[0] for line in p.splitlines() if line.startswith("ReadSchema") for c in line.split("<", 1)[1].rstrip(">").split(",")}
    assert read <= columns


def test_buildings_are_filtered_in_the_scan(spark, small):
    b = hotdeck.measured_buildings(spark.read.parquet(f"{small}/features.parquet"), spark.read.parquet(f"{small}/providers.parquet"))
    assert "PushedFilters: [In(geometry_type, [MultiPolygon,Polygon])]" in plan(spark, b)


def test_placement(spark):
    def f(properties, geometry):
        return {"type": "Feature", "id": 7, "properties": properties, "geometry": geometry}

    point = {"type": "Point", "coordinates": [10.5, 20.25]}
    body = {"crs": "EPSG:4326", "features": [f({"name": "a", "height": 9}, point), f(None, point), f({}, {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}), f({}, {"type": "Polygon", "coordinates": []}), None]}
    b = spark.createDataFrame([(1, json.dumps(body)), (2, json.dumps(body | {"crs": None})), (3, None), (4, "{"), (5, json.dumps({"features": None}))], "page bigint, t string").withColumn("v", F.try_parse_json("t"))
    spec = TileSet(4, 4, 10.0).at(20.25, 10.5, 6)
    got = {(r["page"], r["feature_no"]): r for r in buildings.place(b, ["page"], spec, F.lit(None).cast("int")).collect()}
    assert (got[1, 0]["name"], got[1, 0]["height"], got[1, 0]["reason"], got[1, 0]["tile"]) == ("a", 9.0, None, 10)
    assert [got[1, i]["reason"] for i in range(1, 5)] == ["no properties", "unsupported: LineString", "no position", "no properties"]
    assert got[2, 0]["reason"] == "unknown projection" and len(got) == 10
    with pytest.raises(ValueError):
        buildings.point_marker(F.col("plane"), 0)


SQUARES = {"type": "MultiPolygon", "coordinates": [[[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]], [[[30, 0], [32, 0], [32, 2], [30, 2], [30, 0]]]]}


def body(spark, *features):
    text = json.dumps({"crs": "EPSG:4326", "features": [{"type": "Feature", "id": i, "properties": p, "geometry": g} for i, (p, g) in enumerate(features)]})
    return spark.createDataFrame([(1, text)], "page bigint, t string").withColumn("v", F.try_parse_json("t"))


def test_a_feature_lies_where_the_middle_of_all_its_parts_does(spark):
    spec = TileSet(8, 4, 10.0).at(1.0, 16.0, 5)
    line = {"type": "MultiLineString", "coordinates": [[[0, 1], [32, 1]], [[5, 5]]]}
    b = body(spark, ({"a": 1}, SQUARES), ({}, line), ({}, {"type": "Point", "coordinates": [16, 1]}), ({}, {"type": "Polygon", "coordinates": json.dumps(SQUARES["coordinates"][0])}))
    got = buildings.place(b, ["page"], spec, F.lit(None).cast("int")).orderBy("feature_no").collect()
    middle = got[2]["tile"]
    assert [r["reason"] for r in got] == [None] * 4 and got[0]["tile"] == got[1]["tile"] == middle != got[3]["tile"]
    assert [len(r["parts"]) for r in got] == [2, 1, 1, 1] and len(got[1]["lines"]) == 2 and str(got[0]["properties"]) == '{"a":1}'
    assert not got[0]["contained"] and len(got[1]["parts"][0][0]) == 5
    asked = F.struct(F.lit(5).alias("z"), F.lit(0).alias("x"), F.lit(15).alias("y"))
    assert {r["reason"] for r in buildings.place(b, ["page"], spec, F.lit(None).cast("int"), requested=asked).collect()} == {"tile not shown"}
    with pytest.raises(ValueError):
        buildings.place(b, ["page"], spec, F.lit(None), line_width=0.0)


def test_parts_are_merged_into_one_mesh(spark):
    spec = TileSet(8, 4, 10.0).at(1.0, 16.0, 5)
    placed = buildings.place(body(spark, ({"height": 9}, SQUARES), (None, SQUARES)), ["page"], spec, F.lit(None).cast("int"))
    got = buildings.meshes(placed, F.col("feature_no").cast("bigint"), spec).collect()
    assert [(r["feature"], r["n_parts"], r["n_triangles"], len(r["positions"])) for r in got] == [(0, 2, 36, 36 * 9)]
