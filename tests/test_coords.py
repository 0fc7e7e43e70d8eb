import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.functions import coords as C
from geoloom.operators.grid import TileSet, best_tile, desired_diff, parent_tiles, tile_box, window_shift


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def L(v):
    return F.lit(v)


@pytest.mark.parametrize(("lon", "lat", "z"), [(0.0, 0.0, 1), (-80.8431, 35.2271, 12), (13.405, 52.52, 15), (151.2093, -33.8688, 10)])
def test_exact_tiles_go_back(spark, lon, lat, z):
    x, y = C.lon_to_tile_exact(L(lon), L(z)), C.lat_to_tile_exact(L(lat), L(z))
    r = one(spark, C.tile_to_lon(x, L(z)).alias("lon"), C.tile_to_lat(y, L(z)).alias("lat"), C.lon_to_tile(L(lon), L(z)).alias("x"), F.floor(x).alias("fx"))
    assert r["lon"] == pytest.approx(lon, abs=1e-10) and r["lat"] == pytest.approx(lat, abs=1e-10) and r["x"] == r["fx"]


def test_golden_values(spark):
    x, y = 18051.51296625778, 25908.406989225274
    r = one(spark, C.lon_to_tile_exact(L(-80.8400777), L(16)).alias("x"), C.lat_to_tile_exact(L(35.2258461), L(16)).alias("y"), C.tile_width_m(L(35.2258461), L(16)).alias("w"), C.tile_scale(L(25.0), L(35.2258461), L(16)).alias("s"), C.tile_scale(L(25.0), L(0.0), L(0)).alias("none"), C.tile_width_m(L(1.0), L(0)).alias("zero"))
    assert (r["x"], r["y"]) == (pytest.approx(x, abs=1e-8), pytest.approx(y, abs=1e-8))
    assert r["w"] == pytest.approx(499.5219644697197) and r["s"] == pytest.approx(0.05004784930035937)
    assert r["none"] is None and r["zero"] == 0.0
    m = one(spark, C.lonlat_to_mercator(L(-80.0), L(35.0)).alias("m"))["m"]
    assert (m["x"], m["y"]) == (pytest.approx(-8905559.263461886), pytest.approx(4163881.144064293))
    b = one(spark, tile_box(L(0), L(0), L(0)).alias("b"))["b"]
    assert (b["min_lat"], b["max_lat"], b["min_lon"], b["max_lon"]) == (pytest.approx(-85.05112878), pytest.approx(85.05112878), -180.0, 180.0)


def test_wrapping_clamping_and_poles(spark):
    r = one(spark, C.lonlat_to_mercator(L(190.0), L(0.0)).alias("a"), C.lonlat_to_mercator(L(-170.0), L(90.0)).alias("b"), C.lonlat_to_mercator(L(600.0), L(-90.0)).alias("c"), C.lat_to_tile_exact(L(90.0), L(3)).alias("pole"), C.lon_to_tile(F.lit(None).cast("double"), L(3)).alias("none"))
    assert r["a"]["x"] == pytest.approx(r["b"]["x"]) and r["b"]["y"] == C.HALF_WIDTH and r["c"]["y"] == -C.HALF_WIDTH
    assert r["c"]["x"] == C.HALF_WIDTH and r["pole"] is None and r["none"] is None


@settings(max_examples=25, deadline=None)
@given(st.floats(-179.9, 179.9), st.floats(-85, 85))
def test_mercator_goes_back(spark, lon, lat):
    m = C.lonlat_to_mercator(L(lon), L(lat))
    p = one(spark, C.mercator_to_lonlat(m["x"], m["y"]).alias("p"))["p"]
    assert p["lon"] == pytest.approx(lon, abs=1e-9) and p["lat"] == pytest.approx(lat, abs=1e-9)


def test_projections_agree_on_the_tile(spark):
    m = C.lonlat_to_mercator(L(-80.8), L(35.2))
    r = one(spark, C.to_tile(L(-80.8), L(35.2), L(C.EPSG_4326), L(12)).alias("a"), C.to_tile(m["x"], m["y"], L(C.EPSG_3857), L(12)).alias("b"), C.to_tile_exact(L(1.0), L(1.0), L(7), L(12)).alias("c"))
    assert r["a"] == r["b"] and r["c"]["x"] is None


def test_plane_and_back(spark):
    t = TileSet(5, 4, 20.0).at(35.2, -80.8, 14)
    p = t.lonlat_to_plane(L(-80.81), L(35.21))
    r = one(spark, t.plane_to_lonlat(p["x"], p["z"]).alias("b"))["b"]
    assert (r["lon"], r["lat"]) == (pytest.approx(-80.81, abs=1e-9), pytest.approx(35.21, abs=1e-9))


def test_grid(spark):
    t = TileSet(4, 4, 100.0).at(0.0, 0.0, 2)
    rows = t.grid(spark).orderBy("idx").collect()
    assert [(r["x"], r["y"]) for r in rows[:5]] == [(0, 4), (1, 4), (2, 4), (3, 4), (0, 3)]
    assert [r["valid"] for r in rows] == [False] * 4 + [True] * 12
    assert TileSet(4, 4, 25.0).at(35.2258461, -80.8400777, 16).corner == (18049, 25910)
    # The first row's tiles lie at the south edge, also when seen through the plane.
    x, y = rows[0]["x"], rows[0]["y"]
    p = one(spark, t.tile_to_plane(L(float(x)), L(float(y))).alias("p"))["p"]
    assert p["x"] == rows[0]["min_x"] and p["z"] == rows[0]["max_z"]


@pytest.mark.parametrize("bad", [(0, 1, 1.0), (1, -1, 1.0), (1, 1, 0.0), (1, 1, math.inf), (1.5, 1, 1.0)])
def test_guards(bad):
    with pytest.raises(ValueError):
        TileSet(*bad)
    with pytest.raises(RuntimeError):
        TileSet(1, 1, 1.0).corner  # noqa: B018


def test_best_tile_ties_and_outside(spark):
    t = TileSet(3, 2, 10.0)
    at = lambda x, z, **k: one(spark, best_tile(t, L(float(x)), L(float(z)), **k).alias("i"))["i"]
    assert at(-15, -10) == 0 and at(-5, -10) == 0 and at(-4.9, -10) == 1 and at(-5, 0) == 0 and at(-5, 0.1) == 3
    assert at(99, 99) == 5 and at(-99, 0) == 0 and at(-99, -99, last_tile=True) == 5


def test_windows_wrap_and_limits_hold(spark):
    t = TileSet(4, 4, 10.0).at(10.0, 10.0, 6)
    g = t.grid(spark)
    moved = window_shift(g, t, -12.0, 0.0).collect()
    assert sum(r["reloaded"] for r in moved) == 4 and all(-20 <= r["centre_x"] <= 20 for r in moved)
    first = {r["idx"]: r["x"] for r in g.collect()}
    assert all(r["x"] == first[r["idx"]] + 4 * r["reloaded"] for r in moved)
    assert [r["idx"] for r in window_shift(g, t, -12.0, 0.0, limit=2).collect() if r["reloaded"]] == [0, 4]


def test_parents_and_their_difference(spark):
    t = TileSet(4, 4, 100.0).at(35.2258461, -80.8400777, 16)
    p = parent_tiles(t.grid(spark), 16, 14)
    assert {(r["x"], r["y"]) for r in p.collect()} == {(4512, 6476), (4512, 6477), (4513, 6476), (4513, 6477)}
    d = desired_diff(p, p.filter("x = 4512").unionByName(spark.sql("SELECT 14 z, 1L x, 1L y")))
    assert {(r["x"], r["action"]) for r in d.collect()} == {(4513, "dispose"), (1, "load")}
    with pytest.raises(ValueError):
        parent_tiles(t.grid(spark), 12, 14)
