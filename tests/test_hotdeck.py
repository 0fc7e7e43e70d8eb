from datetime import datetime

import pytest

from geoloom.operators import hotdeck as H

SCHEMA = "row_id bigint, district string, kind string, at timestamp, v double, w double, __t string"


def frame(spark, rows):
    return spark.createDataFrame([(i, d, k, t and datetime(2024, 1, t), v, w, "clash") for i, d, k, t, v, w in rows], SCHEMA)


def fill(df, ranges):
    return {r["row_id"]: r for r in H.hot_deck(df, ["v", "w"], ["district", "kind"], "at", "row_id", ranges).collect()}


ROWS = [(1, "a", "x", 1, 10.0, None), (2, "a", "x", 3, None, None), (3, "a", "x", 9, 30.0, None), (4, "a", "y", 2, None, 7.0), (5, "b", "x", None, None, None), (6, None, None, 4, None, None), (7, "a", "x", 5, None, 0.0), (8, "a", "x", 5, None, None)]


@pytest.mark.parametrize("ranges", [1, 2, 7])
def test_donors(spark, ranges):
    got = fill(frame(spark, ROWS), ranges)
    assert len(got) == len(ROWS)
    assert (got[2]["v"], got[2]["v_donor"], got[2]["v_donor_level"], got[2]["v_donor_gap"]) == (10.0, 1, 2, 2 * 86400.0)
    assert got[7]["v_donor"] == 3 or got[7]["v_donor"] == 1
    assert not got[1]["v_was_missing"] and got[1]["v_donor"] is None and got[1]["v"] == 10.0
    assert got[7]["w"] == 0.0 and not got[7]["w_was_missing"]
    assert got[4]["v_donor"] == 3 and got[4]["v_donor_level"] == 1
    assert got[5]["v"] is not None and got[5]["v_donor_level"] == 0 and got[5]["v_donor_gap"] is None
    assert all(r["v"] is not None for r in got.values())


def test_ranges_make_no_difference(spark):
    rows = [(i, f"d{i % 3 if i % 5 else 0}", f"k{i % 2}", i % 27 + 1, float(i) if i % 4 else None, None if i % 9 else float(i)) for i in range(400)]
    one, many = fill(frame(spark, rows), 1), fill(frame(spark, rows), 13)
    assert one == many


def test_nothing_observed_and_nothing_at_all(spark):
    got = fill(frame(spark, [(1, None, None, None, None, None), (1, None, None, None, None, None)]), 2)
    assert got[1]["v"] is None and got[1]["v_was_missing"] and got[1]["v_donor"] is None
    assert fill(frame(spark, []), 2) == {}


def test_what_counts_as_missing(spark):
    rows = [(i, "P", "Polygon", h, lv, rf, "d", None, None, None) for i, (h, lv, rf) in enumerate([("9.5", "2", "0"), ("", " ", "n/a"), (None, "-1", "9999"), ("-999", "G+1", "1.5"), ("99999", "k.A.", "?")])]
    rows.append((9, "P", "Point", None, None, None, None, None, None, None))
    f = spark.createDataFrame(rows, "row_id bigint, provider string, geometry_type string, height string, levels string, roof_height string, district string, building_type string, observed_at timestamp, loaded_at timestamp")
    p = spark.createDataFrame([("P", "m")], "provider string, height_unit string")
    got = sorted(tuple(r) for r in H.filled_values(H.fill_buildings(f, p)).collect())
    assert got == [(1, "height"), (1, "levels"), (1, "roof_height"), (2, "height"), (2, "levels"), (2, "roof_height"), (3, "height"), (4, "height"), (4, "levels"), (4, "roof_height")]
