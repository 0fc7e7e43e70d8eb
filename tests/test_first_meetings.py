"""street_first_hits at size: streets travel, what they meet doesn't."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as E
from geoloom.functions import geometry as G
from geoloom.operators import first_meetings as M
from geoloom.operators import spatial_join

CORNERS = ("ax", "az", "bx", "bz", "cx", "cz")
SCHEMA = "street long, " + ", ".join(f"{c} double" for c in CORNERS)


def _segments(df):
    ax, az, bx, bz, cx, cz = (F.col(c) for c in CORNERS)
    return df.distinct().select("street", F.posexplode(G.short_line_segments([(ax, az), (bx, bz), (cx, cz)])).alias("seq", "s")).select("street", "seq", "s.*")


def _found(df):
    return sorted(tuple(r) for r in df.select("street_a", "street_b", "x", "y").collect())


def test_packed_lines_come_back_to_the_bit():
    kinds = [[1.0, -2.5, 20011.0, 0.0, 8388607.99609375, -8388608.0], [0.1, 1e300, float("nan"), -0.0, 5e-324, float("-inf")]]
    for kind in (kinds[:1], kinds[1:], kinds):
        corners = np.array([draw.choices(sum(kind, []), k=40) for draw in [random.Random(3)] for _ in range(6)])
        street = np.array([draw.choice((-(2**63), -1, 0, 7, 2**63 - 1)) for draw in [random.Random(4)] for _ in range(40)])
        rows = M._rows({"k": np.arange(40)}, np.array([0, 1, 30, 40]), street, corners)
        got = M._lines(M._parts(iter([rows]), "k"))
        order = np.argsort(street, kind="stable")
        assert (got[0] == street[order]).all() and (got[1].view(np.int64) == corners[:, order].view(np.int64)).all()
        assert rows["whole"].to_pylist()[1] == (kind is not kinds and 0.1 not in kind[0])


def test_no_hits_are_shuffled(spark, small):
    plan = E.queries()["street_first_hits"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "hashpartitioning(street_a" not in plan


def _few_at_a_time(rows, cell):
    """first_meetings, in this process."""
    parts = lambda t, *keys: [(k, t.filter(pa.array([r == k for r in zip(*(t[c].to_pylist() for c in keys), strict=True)])).to_batches()) for k in sorted(set(zip(*(t[c].to_pylist() for c in keys), strict=True)))]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["street", *CORNERS])
    dealt = pa.Table.from_batches(M._dealt(iter([whole.slice(0, 99), whole.slice(99)])))
    tiles = pa.Table.from_batches(list(M._to_tiles(cell, 0.25)(iter(dealt.sort_by("bucket").to_batches()))))
    met = [b for k, part in parts(tiles, "tx", "tz") for b in M._met(cell, 0.25)(tuple(map(pa.scalar, k)), iter(part))]
    return sorted(tuple(r.values()) for b in met for r in b.to_pylist())


def test_first_hits_of_streets_with_many_lines(spark, monkeypatch):
    """Lines of a street lie in many tiles, twice or side by side, and some are larger than a tile; a few pairs are worked on at a time, too."""
    draw = random.Random(5)
    rows = []
    for _ in range(300):
        x, z = draw.randint(-60, 60), draw.randint(-60, 60)
        reach = draw.choice((3, 12, 60))
        rows.append((draw.randint(-20, 20), *(float(v + draw.randint(-reach, reach)) for v in (x, z) * 3)))
    df = spark.createDataFrame(rows + rows[:40], SCHEMA)
    assert len({r[0] for r in rows}) == 41 and len(want := _found(spatial_join.street_intersections(_segments(df), 4.0))) > 300
    met = M._met(2.0, 0.25)
    assert _found(M.first_meetings(df, 2.0)) == want
    monkeypatch.setattr(M._slices, "__defaults__", (7,))
    monkeypatch.setattr(M, "LINES", 30)
    monkeypatch.setattr(M, "IN_BAND", 3)
    assert _few_at_a_time(rows + rows[:40], 2.0) == want


def test_earlier_hit_in_another_tile_counts(spark):
    # Street 1 crosses street 2 far apart: by its second segment near the origin, by its first at 900.
    rows = [(1, -9.0, 50.0, -9.0, 9.0, 5.0, 9.0), (1, 895.0, 0.0, 905.0, 0.0, 905.0, 40.0), (2, 0.0, 5.0, 0.0, 12.0, 0.0, 20.0), (2, 900.0, -5.0, 900.0, 5.0, 900.0, 9.0)]
    assert _found(M.first_meetings(spark.createDataFrame(rows, SCHEMA), 4.0)) == [(1, 2, 900.0, 0.0)]


def test_lines_without_a_place_meet_nothing(spark):
    cross = [(1, 0.0, 0.0, 9.0, 9.0, 9.0, 20.0), (2, 0.0, 9.0, 9.0, 0.0, 20.0, 0.0)]
    odd = [(3, None, 0.0, 9.0, 9.0, 9.0, 20.0), (4, float("nan"), 0.0, 9.0, 9.0, 9.0, 20.0), (5, float("inf"), 0.0, 9.0, 9.0, 9.0, 20.0), (None, 0.0, 0.0, 9.0, 9.0, 9.0, 20.0), (6, 4.5, 4.5, 4.5, 4.5, 4.5, 4.5)]
    assert _found(M.first_meetings(spark.createDataFrame(cross + odd, SCHEMA), 4.0)) == [(1, 2, 4.5, 4.5)]
    assert _found(M.first_meetings(spark.createDataFrame(odd, SCHEMA), 4.0)) == []
    assert _found(M.first_meetings(spark.createDataFrame([], SCHEMA), 4.0)) == []
