import json
import math

import pytest

from geoloom.operators import units as U

CASES = [("9.5", 9.5, ""), ("22'", 22 * 0.3048, "ft"), ("20′4″", 20 * 0.3048 + 4 * 0.0254, "ft"), ("25 ft 3 in", 7.6962, "ft"), ("ca. 3.9 m", 3.9, "m"), ("950CM", 9.5, "cm"), ("7,3 m", 7.3, "m"), ('547"', 13.8938, "in"), ("6400 mm", 6.4, "mm"), ("9.7 yards", 8.86968, "yd"), ("73.8 Fuß", 22.49424, "ft"), ("8.9 mètres", 8.9, "m"), ("G+3", 4, "upper"), ("EG+0", 1, "upper"), ("ground + 4", 5, "upper"), ("2 above ground floor", 3, "upper"), ("3 fl.", 3, "storey"), ("5 Etagen", 5, "storey"), ("20 °C", 293.15, "°C"), ("-3 m", -3, "m")]


@pytest.mark.parametrize(("text", "value", "unit"), CASES)
def test_readings(text, value, unit):
    got = U.read_quantity(text)
    assert got[1] == unit and math.isclose(got[0], value, rel_tol=1e-9)


@pytest.mark.parametrize("text", [None, "", " ", "n/a", "-", "?", "k.A.", "NaN", "null", "3 m 2 storeys", "m", "3 apples", "x" * 100_000, "1 2 3 m" * 500])
def test_no_quantity(text):
    assert U.read_quantity(text)[1] is None


def test_dimensions_add_up():
    assert U.read_quantity("5 kg/m³")[2] == (-3, 1, 0, 0, 0) and U.read_quantity("5 kg/m³")[0] == pytest.approx(5)
    assert U.read_quantity("36 km/h")[0] == pytest.approx(10) and U.read_quantity("36 km/h")[2] == (1, 0, -1, 0, 0)


def test_coordinates():
    text, unit = U.lonlat_text("[[-12711792.39,4205125.33,3],[-12711786.23,4205138.56,3]]", None)
    assert unit == "EPSG:3857" and json.loads(text)[0][0] == pytest.approx(-114.1919739, abs=1e-6) and json.loads(text)[0][2] == 3
    assert U.lonlat_text("[10.5,20.5]", '"EPSG:3857"') == ("[10.5,20.5]", None)
    assert U.lonlat_text("[[0.0,0.0],[40.0,60.0]]", '"EPSG:3857"')[1] == "EPSG:3857"
    assert U.lonlat_text("", None) == ("", None) and U.lonlat_text("rubbish", "{") == ("rubbish", None)


def features(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, provider string, coordinates string, crs string, height string, levels string, bare_unit string")


def providers(spark):
    return spark.createDataFrame([("A", "ft"), ("B", None), ("C", None), ("B", None)], "provider string, height_unit string")


def test_bare_numbers_take_their_providers_unit(spark):
    rows = [(i, "C", None, None, f"{8 + i % 7} m", None, "clash") for i in range(40)]
    rows += [(100 + i, "A", None, None, str(round((8 + i % 7) / 0.3048, 1)), "2", "clash") for i in range(40)]
    rows += [(200 + i, "B", None, None, str((8 + i % 7) * 100), "9999", "clash") for i in range(40)]
    rows += [(300, "B", "[1,2]", None, "9999", "G+1", "x"), (301, None, None, None, "7", None, "x"), (302, "Z", None, None, "-1", "4 m", "x"), (302, "Z", None, None, "-1", "4 m", "x")]
    got = U.to_common_units(features(spark, rows), providers(spark)).collect()
    assert len(got) == len(rows)
    by = {r["row_id"]: r for r in got}
    assert by[100]["height_unit"] == "ft" and by[100]["height_m"] == pytest.approx(8, abs=0.05)
    assert by[200]["height_unit"] == "cm" and by[200]["height_m"] == pytest.approx(8)
    assert by[200]["levels_n"] is None and by[300]["height_m"] is None and by[300]["levels_n"] == 2
    assert by[301]["height_m"] == 7 and by[302]["height_unit"] is None and by[302]["levels_unit"] == "m"
    foreign = {tuple(r) for r in U.foreign_units(U.to_common_units(features(spark, rows), providers(spark))).collect()}
    assert (302, "levels", "m") in foreign and (300, "levels", "upper") in foreign and not any(r[0] < 100 for r in foreign)


def test_empty_tables(spark):
    assert U.to_common_units(features(spark, []), providers(spark)).count() == 0
    got = U.to_common_units(features(spark, [(1, "A", None, None, "10", None, None)]), providers(spark).limit(0)).first()
    assert got["height_m"] == 10


def test_a_comma_groups_thousands_of_small_units():
    assert U.read_quantity("12,500 mm")[0] == 12.5 and U.read_quantity("1,250 ft")[0] == 381.0 and U.read_quantity("12,5 m")[0] == 12.5 and U.read_quantity("12,500 m")[0] == 12.5
