import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators import dem, mesh, spatial_join

PTS = "array<struct<x: double, z: double>>"


def on(spark, points, column):
    return spark.createDataFrame([([tuple(map(float, p)) for p in points],)], f"p {PTS}").select(column(F.col("p"))).first()[0]


def test_intersections(spark):
    ask = lambda *v: spark.range(1).select(G.intersection(tuple(F.lit(float(x)) for x in v[:4]), tuple(F.lit(float(x)) for x in v[4:]))).first()[0]
    assert tuple(ask(0, 0, 10, 10, 0, 10, 10, 0)) == (5.0, 5.0)
    assert ask(0, 0, 10, 0, 0, 1, 10, 1) is None and ask(0, 0, 1, 1, 5, 0, 6, -9) is None and ask(2, 2, 2, 2, 0, 0, 4, 4) is None
    assert tuple(ask(0, 0, 10, 0, 10, 0, 10, 5)) == (10.0, 0.0)


def test_lines(spark):
    s = on(spark, [(0, 0), (10, 0), (10, 5)], G.line_segments)
    assert [tuple(x) for x in s] == [(-0.25, 0.0, 10.0, 0.0), (10.0, 0.0, 10.0, 5.25)]
    assert on(spark, [(1, 1)], G.line_segments) is None and on(spark, [], lambda p: G.buffer_line(p, 2.0)) is None
    o = on(spark, [(0, 0), (10, 0), (10, 5)], lambda p: G.buffer_line(p, 6.0))
    assert len(o) == 9 and tuple(o[0]) == tuple(o[-1]) == (0.0, 3.0) and tuple(o[3]) == (7.0, 5.0)
    assert tuple(on(spark, [(0, 0), (0, 0)], lambda p: G.buffer_line(p, 6.0))[0]) == (0.0, 0.0)


def test_segments_are_lines_of_two_points(spark):
    rows = [(0.0, 0.0, 3.0, 4.0), (1.0, 2.0, 1.0, 2.0), (5.0, -1.0, -7.5, 2.25)]
    df = spark.createDataFrame(rows, "x1 double, z1 double, x2 double, z2 double")
    ends = [F.col(c) for c in df.columns]
    line = F.array(F.struct(ends[0].alias("x"), ends[1].alias("z")), F.struct(ends[2].alias("x"), ends[3].alias("z")))
    for r in df.select(G.buffer_segment(*ends, 6.0).alias("a"), G.buffer_line(line, 6.0).alias("b"), G.pushed_segment(*ends).alias("c"), G.line_segments(line).alias("d")).collect():
        assert [v for p in r["a"] for v in p] == pytest.approx([v for p in r["b"] for v in p]) and len(r["a"]) == len(r["b"]) == 5
        assert list(r["c"]) == pytest.approx(list(r["d"][0])) and len(r["d"]) == 1
    with pytest.raises(ValueError):
        G.buffer_segment(*ends, -1.0)


def test_rings(spark):
    square = [(0, 0), (4, 0), (4, 2), (0, 2)]
    dent = [(0, 0), (4, 0), (2, 1), (4, 2), (0, 2)]
    assert on(spark, square, G.is_convex) and not on(spark, dent, G.is_convex) and not on(spark, [(0, 0), (1, 1), (2, 2)], G.is_convex) and not on(spark, [], G.is_convex)
    assert len(on(spark, [*square, (0, 0)], G.without_closing_point)) == 4 and len(on(spark, square, G.without_closing_point)) == 4
    assert tuple(on(spark, square, G.box_centre)) == (2.0, 1.0) and on(spark, square, G.area) == 8.0
    a = on(spark, square, lambda p: G.axes(p, F.lit(None).cast("double")))
    assert tuple(a["ridge"]) == (1.0, 0.0)
    b = on(spark, square, lambda p: G.axes(p, F.lit(90.0)))
    assert b["slope"]["x"] == pytest.approx(1) and b["ridge"]["z"] == pytest.approx(1)
    r = spark.createDataFrame([([[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)], [(0.2, 0.1), (0.3, 0.1), (0.3, 0.2), (0.2, 0.1)]],)], f"r array<{PTS}>")
    w = r.select(G.outer_and_holes(F.col("r")).alias("a"), G.outer_and_holes(F.col("r"), True).alias("b")).first()
    assert [tuple(p) for p in w["a"]["outer"]] == [(1.0, 1.0), (1.0, 0.0), (0.0, 0.0)] and len(w["a"]["holes"]) == 1
    assert [tuple(p) for p in w["b"]["outer"]] == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]


def test_vertices_to_world(spark):
    df = spark.createDataFrame([([(1.0, 2.0, 0.0)],)], "p array<struct<x: double, y: double, z: double>>")
    got = df.select(G.to_world(F.col("p"), F.lit(10.0), F.lit(20.0), F.lit(30.0), F.lit(2.0), F.lit(math.pi / 2))).first()[0][0]
    assert (got["x"], got["y"], got["z"]) == (pytest.approx(10.0), 24.0, pytest.approx(28.0))


def test_street_crossings_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    p = rng.uniform(0, 60, (150, 2))
    d = rng.uniform(-9, 9, (150, 2))
    rows = [(i // 2, i % 2, *map(float, (p[i, 0], p[i, 1], p[i, 0] + d[i, 0], p[i, 1] + d[i, 1]))) for i in range(150)] + [(90, 0, 1.0, 1.0, 1.0, 1.0), (91, 0, None, 1.0, 2.0, 2.0)]
    s = spark.createDataFrame(rows, "street long, seq int, x1 double, z1 double, x2 double, z2 double")

    def cross(a, b):
        (x1, y1, x2, y2), (x3, y3, x4, y4) = a, b
        den = (y4 - y3) * (x2 - x1) - (x4 - x3) * (y2 - y1)
        if not den:
            return None
        ua = ((x4 - x3) * (y1 - y3) - (y4 - y3) * (x1 - x3)) / den
        ub = ((x2 - x1) * (y1 - y3) - (y2 - y1) * (x1 - x3)) / den
        return (x1 + ua * (x2 - x1), y1 + ua * (y2 - y1)) if 0 <= ua <= 1 and 0 <= ub <= 1 else None

    want = {}
    for a in rows[:151]:
        for b in rows[:151]:
            if a[0] < b[0] and (hit := cross(a[2:], b[2:])):
                k = (a[0], b[0])
                if k not in want or (a[1], b[1]) < want[k][0]:
                    want[k] = ((a[1], b[1]), hit)
    got = spatial_join.street_intersections(s, 7.0).collect()
    assert {(r["street_a"], r["street_b"]) for r in got} == set(want) and len(got) == len(want)
    assert all((r["x"], r["y"]) == pytest.approx(want[r["street_a"], r["street_b"]][1]) for r in got)
    assert spatial_join.street_intersections(s.limit(0), 7.0).count() == 0


def test_duplicates_keep_the_first(spark):
    sq = lambda x, e=0.0: [(x + e, 0.0), (x + 1.0, 0.0), (x + 1.0, 1.0)]
    rows = [(5, 2, False, sq(3.0)), (4, 1, False, sq(3.0, 4e-6)), (6, 3, True, sq(3.0)), (7, 4, False, sq(3.0)[:2]), (8, 5, False, None), (9, 6, False, []), (1, 7, False, sq(3.0, 1e-3)), (2, 9, False, sq(3.0))]
    df = spark.createDataFrame(rows, f"id long, seq int, contained boolean, points {PTS}")
    assert {tuple(r) for r in spatial_join.duplicate_shapes(df).collect()} == {(5, 4), (2, 4)}


def test_only_kept_shapes_drop_others(spark):
    at = lambda e: [(3.0 + e, 0.0), (4.0, 0.0), (4.0, 1.0)]
    rows = [(i, i, False, at(8e-6 * i)) for i in range(6)] + [(9, 9, False, at(8e-6 * 5))]
    df = spark.createDataFrame(rows, f"id long, seq int, contained boolean, points {PTS}")
    # Each lies within the tolerance of its neighbours only: every other one stays.
    assert {tuple(r) for r in spatial_join.duplicate_shapes(df).collect()} == {(1, 0), (3, 2), (5, 4), (9, 4)}


def test_a_long_diagonal_has_few_cells(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 0.0, 1000.0, 1000.0), (2, 0, 0.0, 900.0, 900.0, 0.0), (3, 0, 500.0, 0.0, 500.0, 900.0)], "street long, seq int, x1 double, z1 double, x2 double, z2 double")
    boxed = s.selectExpr("*", "least(x1, x2) AS lx", "greatest(x1, x2) AS hx", "least(z1, z2) AS lz", "greatest(z1, z2) AS hz")
    assert spatial_join._visited(boxed.filter("street = 1"), 10.0).count() < 400
    assert {(r["street_a"], r["street_b"], r["x"], r["y"]) for r in spatial_join.street_intersections(s, 10.0).collect()} == {(1, 2, 450.0, 450.0), (1, 3, 500.0, 500.0), (2, 3, 500.0, 400.0)}


def test_near_points(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.9, 0.0), (3, 2.0, 0.0), (4, -0.5, -0.5), (5, None, 0.0), (6, 0.0, 0.0)], "id long, x double, z double")
    assert {(r["id"], r["earlier"]) for r in spatial_join.near_earlier(df).collect()} == {(2, 1), (4, 1), (6, 1), (6, 2), (6, 4)}


def test_elevation(spark):
    ask = lambda r, g, b: spark.range(1).select(dem.height(F.lit(r), F.lit(g), F.lit(b))).first()[0]
    assert ask(0.0, 0.0, 0.0) == -10000.0 and ask(1.0, 134.0, 160.0) == 0.0


def test_seams_are_those_of_the_procedure(spark):
    """Loading tile by tile in any order and fixing seams as they become possible gives the stateless result."""
    rng = np.random.default_rng(6)
    for nx, ny, p in ((1, 1, 1), (3, 2, 2), (2, 3, 3)):
        raw = {(x, y): rng.integers(0, 99, (p + 1, p + 1)).astype(float) for x in range(nx) for y in range(ny)}
        now = {k: v.copy() for k, v in raw.items()}
        done, loaded = set(), set()
        for k in rng.permutation(len(raw)):
            loaded.add(list(raw)[k])
            for x, y in loaded:
                for name, to in (("n", (x, y - 1)), ("e", (x + 1, y)), ("c", (x + 1, y - 1))):
                    if to in loaded and (name, x, y) not in done:
                        if name == "n":
                            stop = p if ("c", x, y) in done else p + 1
                            now[x, y][0, :stop] = raw[to][p, :stop]
                        elif name == "e":
                            start = 1 if ("c", x, y) in done else 0
                            now[x, y][start:, p] = raw[to][start:, 0]
                        else:
                            now[x, y][0, p] = raw[to][p, 0]
                        done.add((name, x, y))
        for (x, y), v in raw.items():
            v[:] = v
        rows = [(1, x, y, r, c, float(v[r, c])) for (x, y), v in raw.items() for r in range(p + 1) for c in range(p + 1)]
        got = dem.fix_seams(spark.createDataFrame(rows, "z int, x long, y long, row int, col int, h double"), p).collect()
        assert len(got) == len(rows)
        for g in got:
            x, y, r, c = g["x"], g["y"], g["row"], g["col"]
            options = [raw[n][i, j] for n, i, j, ok in (((x + 1, y - 1), p, 0, r == 0 and c == p), ((x + 1, y), r, 0, c == p), ((x, y - 1), p, c, r == 0), ((x, y), r, c, True)) if ok and n in raw]
            assert g["h"] == options[0]


def test_resampling(spark):
    df = spark.createDataFrame([(1, 0, 0, 3, 2, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])], "z int, x long, y long, width int, height int, dem array<double>")
    got = {(r["row"], r["col"]): r["h"] for r in dem.resample(df, 2, 10.0).collect()}
    assert got == {(0, 0): 0, (0, 1): 10, (0, 2): 20, (1, 0): 0, (1, 1): 10, (1, 2): 20, (2, 0): 30, (2, 1): 40, (2, 2): 50}


def area(ts):
    return sum(abs(mesh.cross(*t)) / 2 for t in ts)


def test_triangulation_covers_the_area():
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
    hole2 = [(2.5, 2.5), (3.5, 2.5), (3.5, 3.5), (2.5, 3.5), (2.5, 2.5)]
    ell = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0)]
    assert area(mesh.triangulate([square])) == 16 and area(mesh.triangulate([ell])) == 7 and area(mesh.triangulate([ell[::-1]])) == 7
    assert area(mesh.triangulate([square, hole])) == pytest.approx(15) and area(mesh.triangulate([square, hole, hole2])) == pytest.approx(14)
    assert mesh.triangulate([]) == [] and mesh.triangulate([[(0.0, 0.0), (1.0, 1.0)]]) == []
    rng = np.random.default_rng(8)
    for _ in range(30):
        a = np.sort(rng.uniform(0, 2 * np.pi, 12))
        r = rng.uniform(1, 5, 12)
        star = [(float(x), float(y)) for x, y in zip(r * np.cos(a), r * np.sin(a), strict=True)]
        if np.diff(np.append(a, a[0] + 2 * np.pi)).max() < 3:
            assert area(mesh.triangulate([star])) == pytest.approx(abs(mesh.signed_area(star)))


@pytest.mark.parametrize("shape", ["gabled", "hipped", "pyramidal", "skillion"])
def test_roofs_sit_on_walls(spark, shape):
    ring = [(-10.0, -5.0), (10.0, -5.0), (10.0, 5.0), (-10.0, 5.0), (-10.0, -5.0)]
    rows = [(1, [ring], 12.0, shape, 4.0, 90.0), (2, [ring, [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, -1.0)]], 12.0, shape, 4.0, None), (3, None, None, shape, None, None), (4, [ring], 12.0, None, None, None)]
    df = spark.createDataFrame(rows, f"id long, rings array<{PTS}>, height double, shape string, roof_height double, bearing double")
    got = {r["id"]: r for r in mesh.build(df).collect()}
    assert (got[1]["wall_height"], got[1]["top"], got[1]["roof_built"]) == (8.0, pytest.approx(12.0), True)
    assert got[2]["roof_built"] == (shape == "skillion") and got[2]["wall_height"] == (8.0 if shape == "skillion" else 12.0) and got[2]["top"] == pytest.approx(12.0)
    assert got[3]["n_triangles"] == 0 and got[4]["wall_height"] == 12.0 and got[4]["cap_area"] == 200.0
