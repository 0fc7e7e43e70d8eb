import json

import numpy as np

from geoloom.operators import proximity as P

ZONES = "zone_id int, geometry_type string, coordinates string, lat double"


def brute(points, zones):
    out = set()
    pts = [(i, y, x) for i, y, x in points if y is not None and x is not None and abs(y) <= 90 and abs(x) <= 180]
    for i, y, x in pts:
        for j, v, u in pts:
            if i < j and P.ground_m(*(np.array([t]) for t in (x, y, u, v)))[0] <= 30:
                out.add(("near", i, j))
        for z, g in zones:
            if any(P.inside(P.zone_rings(g), np.array([x + s]), np.array([y]))[0] for s in (0, 360, -360)):
                out.add(("inside", i, z))
    return out


def run(spark, points, zones, **k):
    p = spark.createDataFrame([(*r, "clash") for r in points], "point_id bigint, latitude double, longitude double, zone string")
    z = spark.createDataFrame([(i, "Polygon", g, 0.0) for i, g in zones], ZONES)
    got = [tuple(r) for r in P.point_joins(p, z, **k).collect()]
    assert len(got) == len(set(got))
    return set(got)


def square(x0, y0, x1, y1):
    return [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    pts, k = [], 0
    for cy, cx in ((0, 0), (60, 179.9999), (60, -179.9999), (89.9999, 10), (89.9999, -170), (-33.3, 45), (85, -180)):
        for _ in range(40):
            pts.append((k, float(np.clip(cy + rng.normal(0, 2e-4), -90, 90)), float((cx + rng.normal(0, 4e-4) + 180) % 360 - 180)))
            k += 1
    pts += [(k + i, 10.0, 20.0) for i in range(60)] + [(k + 60, None, 3.0), (k + 61, 4.0, None), (k + 62, 91.0, 0.0), (k + 63, 0.0, 181.0), (k + 64, float("nan"), 1.0), (k + 5, 10.0, 20.0)]
    zones = [(1, json.dumps([square(-1, -1, 1, 1), square(-1e-4, -1e-4, 1e-4, 1e-4)])), (2, json.dumps([[square(19, 9, 21, 11)], [square(44, -34, 46, -33)]])), (3, json.dumps([square(179.9, 59, 180.1, 61)])), (4, json.dumps([square(179.9, 59, -179.9, 61)])), (5, None), (6, "rubbish"), (7, "[]")]
    want = brute(pts, zones)
    assert {kind for kind, _, _ in want} == {"near", "inside"} and any(z == 3 for _, _, z in want)
    assert run(spark, pts, zones) == want
    assert run(spark, pts, zones, sample=50, per_leaf=10) == want


def test_empty_tables(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [(1, 0.0, 0.0), (2, 0.0, 0.0)], []) == {("near", 1, 2)}
    assert run(spark, [(None, 0.0, 0.0), (2, None, None)], [(1, json.dumps([square(-1, -1, 1, 1)]))]) == set()


def test_packed_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    for n in (0, 1, 15, 16, 17, 500):
        a = rng.random((2, n))
        q = rng.random((2, 40))
        i, j = P.PackedRTree(a[0], a[1], a[0] + 0.02, a[1] + 0.02).probe(q[0], q[1], q[0] + 0.1, q[1] + 0.1)
        hit = (a[0] <= q[0][:, None] + 0.1) & (a[0] + 0.02 >= q[0][:, None]) & (a[1] <= q[1][:, None] + 0.1) & (a[1] + 0.02 >= q[1][:, None])
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(int(x), int(y)) for x, y in np.argwhere(hit)}


def test_morton_codes_go_both_ways():
    x, y = np.array([0, 5, 123456, (1 << 24) - 1]), np.array([7, 0, 654321, 1])
    assert [v.tolist() for v in P.unmorton(P.morton(x, y))] == [x.tolist(), y.tolist()]
