import json

from geoloom.operators import nested as N

POLY = [[[0, 0], [1, 0], [1, 1], [0, 0]], [[0.1, 0.1], [0.2, 0.1], [0.2, 0.2], [0.1, 0.1]]]
SCHEMA = "page_id bigint, body string, kind string"


def feature(geometry=None, **properties):
    return {"type": "Feature", "geometry": geometry, "properties": properties}


def found(spark, *bodies):
    df = spark.createDataFrame([(i, b if b is None or isinstance(b, str) else json.dumps(b), "clash") for i, b in enumerate(bodies)], SCHEMA)
    return sorted(tuple(r) for r in N.children(N.node_table(df)).collect())


def test_every_kind_of_child(spark):
    fs = [
        None,
        feature({"type": "Polygon", "coordinates": POLY}, sources={"a": 1}, names={"common": [{"v": 1}, None, {"v": 2}]}),
        feature({"type": "MultiPolygon", "coordinates": [[], POLY]}, addresses=[{"units": None}, {"units": [{"u": 1}, {"u": 2}]}, {"units": {"u": 3}}]),
        feature({"type": "GeometryCollection", "geometries": [{"type": "MultiPoint", "coordinates": [[0, 0], [1, 1]]}, {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, {"type": "Polygon", "coordinates": POLY}]}),
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": "[1, 2]"}, "properties": json.dumps({"sources": json.dumps([{"a": 1}])})},
    ]
    got = [r[1:] for r in found(spark, {"data": {"features": fs}})]
    assert got == sorted(
        [(1, "ring", 0, 0), (1, "ring", 0, 1), (1, "source", 0, 0), (1, "name", 0, 0), (1, "name", 0, 2)]
        + [(2, "ring", 1, 0), (2, "ring", 1, 1), (2, "address", 0, 0), (2, "address", 0, 1), (2, "address", 0, 2), (2, "unit", 1, 0), (2, "unit", 1, 1), (2, "unit", 2, 0)]
        + [(3, "ring", 0, 0), (3, "ring", 1, 0), (3, "ring", 2, 0), (3, "ring", 3, 0), (3, "ring", 3, 1), (4, "ring", 0, 0), (4, "source", 0, 0)]
    )


def test_nothing_from_nothing(spark):
    deep = "[" * 100_000
    assert found(spark, None, "", " ", "{", "[]", "null", deep, {"features": None}, {"features": []}, {"error": 1}, {"features": [None, 5, {"geometry": {"type": "Polygon", "coordinates": []}, "properties": None}]}) == []
    assert N.node_table(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_pages_and_long_bodies(spark):
    body = {"features": [feature({"type": "Point", "coordinates": [1, 2]}, sources=[{"k": "x" * 100}] * 3)] * 2000}
    got = found(spark, body, body)
    assert len(got) == 2 * 2000 * 4


def test_labels_link_children_to_parents(spark, small):
    n = N.node_table(spark.read.parquet(f"{small}/geojson_pages.parquet")).cache()
    for child, parent in (("unit", "address"), ("source", "feature"), ("address", "feature"), ("ring", "feature")):
        c = n.filter(f"kind = '{child}'")
        linked = N.link_by_interval(c, n.filter(f"kind = '{parent}'")).join(c.select("page_id", "pre", "parent_pre"), ["page_id", "pre"])
        assert linked.count() == c.count()
        assert linked.filter("parent_label IS DISTINCT FROM parent_pre").count() == 0
    tables = N.flat_tables(n)
    assert tables["features"].count() == n.filter("kind = 'feature'").count()
