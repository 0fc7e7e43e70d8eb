import json

import numpy as np
import pyarrow as pa
import pytest

from geoloom.llm import history_dedup as D

SCHEMA = "row_id bigint, batch_no int, id string, geometry_type string, coordinates string, ord string"
#: About one metre in degrees at the equator.
M = 1 / 111_320


def ring(x, y, w=20, h=10, close=True, start=0, back=False, more=(), jitter=None):
    pts = [(0, 0), (w, 0), (w, h), (0, h)]
    pts = pts[start:] + pts[:start]
    if back:
        pts = pts[::-1]
    for k in more:
        a, b = pts[k], pts[(k + 1) % len(pts)]
        pts = pts[: k + 1] + [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)] + pts[k + 1 :]
    if jitter is not None:
        pts = [(a + dx, b + dy) for (a, b), (dx, dy) in zip(pts, jitter, strict=False)]
    if close:
        pts.append(pts[0])
    return [[x + a * M, y + b * M] for a, b in pts]


def mercator(r):
    return [[np.radians(x) * D.EARTH_A, float(np.log(np.tan(np.pi / 4 + np.radians(y) / 2)) * D.EARTH_A)] for x, y in r]


def frame(spark, rows):
    return spark.createDataFrame([(i, b, "same", k, c if c is None or isinstance(c, str) else json.dumps(c), "clash") for i, b, k, c in rows], SCHEMA)


def run(spark, rows):
    return {(r["row_a"], r["row_b"]) for r in D.repeats(frame(spark, rows)).collect()}


def test_spellings_of_one_shape(spark):
    hole = ring(10 + 5 * M, 5 + 3 * M, 4, 4)
    rows = [(1, 1, "Polygon", [ring(10, 5), hole]), (2, 1, "Polygon", [ring(10, 5)]), (3, 2, "Polygon", [ring(10, 5, start=2, back=True, close=False), hole]), (4, 2, "Polygon", [mercator(ring(10, 5, more=(0, 2))), mercator(hole)]), (5, 3, "MultiPolygon", [[[[*p, 7.5] for p in ring(10, 5)], hole]]), (6, 3, "Polygon", [ring(10, 5, jitter=[(0.3, -0.2), (-0.2, 0.3), (0.1, 0.3), (-0.3, 0.1)]), hole]), (7, 3, "Polygon", [ring(10, 5, w=21), hole]), (8, 4, "MultiLineString", [ring(10, 5), hole]), (9, 5, "Polygon", [ring(10, 5, w=21), hole])]
    assert run(spark, rows) == {(1, 3), (1, 4), (1, 5), (1, 6), (7, 9)}


def test_points_and_lines(spark):
    line = [[1, 1], [1.0001, 1.0001], [1.0002, 1]]
    rows = [(1, 1, "Point", [3, 3]), (2, 2, "Point", [3 + 0.3 * M, 3]), (3, 2, "Point", [3 + 0.9 * M, 3]), (4, 2, "MultiLineString", [line]), (5, 3, "LineString", line[::-1]), (6, 3, "LineString", line[:2]), (7, 4, "Point", [3.0, 89.0]), (8, 4, "Point", [3.0, 89.0])]
    assert run(spark, rows) == {(1, 2), (4, 5), (7, 8)}


def test_rows_without_a_shape(spark):
    rows = [(1, 1, "Polygon", None), (2, 1, "Polygon", ""), (3, 1, "Polygon", "[[["), (4, 1, None, [ring(0, 0)]), (5, 1, "Blob", [ring(0, 0)]), (6, None, "Polygon", [ring(0, 0)]), (7, 1, "Polygon", [ring(0, 0)]), (8, 1, "Polygon", "[]"), (9, 1, "Polygon", '[[["a",1]]]'), (10, 1, "Polygon", "[null]"), (11, 1, "Polygon", json.dumps([ring(0, 0)])[:-1])]
    assert run(spark, rows) == {(7, 6)}
    assert run(spark, []) == set()


def test_chains_and_hot_shapes(spark):
    # Each step is within half a metre of the last one only: every other one is accepted.
    chain = [(i, 1, "Point", [7 + 0.4 * M * i, 7]) for i in range(1, 7)]
    assert run(spark, chain) == {(1, 2), (3, 4), (5, 6)}
    rng = np.random.default_rng(2)
    hot = [(100 + i, 2, "Polygon", [ring(20, 2, jitter=rng.uniform(-0.1, 0.1, (4, 2)))]) for i in range(600)]
    assert run(spark, hot) == {(100, 100 + i) for i in range(1, 600)}


def test_batch_by_batch_is_like_all_at_once(spark, small, tmp_path):
    f = spark.read.parquet(f"{small}/features.parquet")
    history, got = D.FeatureHistory(str(tmp_path / "history")), set()
    bounds = ((1, 8), (9, 16), (17, 24))
    for lo, hi in bounds:
        got |= {tuple(r) for r in history.accept(f.filter(f"batch_no BETWEEN {lo} AND {hi}")).collect()}
    assert got == {tuple(r) for r in D.repeats(f).collect()} and got


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_batch_accepted_again_adds_nothing(spark, tmp_path):
    point = lambda i, b, x: (i, b, "Point", [x, 3])
    one, two = frame(spark, [point(1, 1, 3), point(2, 1, 4), point(3, 1, 3)]), frame(spark, [point(4, 2, 4), point(5, 2, 5)])
    history = D.FeatureHistory(str(tmp_path / "history"))
    assert pairs(history.accept(one)) == pairs(history.accept(one)) == [(1, 3)]
    assert pairs(history.accept(two)) == pairs(history.accept(two)) == [(2, 4)]
    assert pairs(history.accept(one)) == [(1, 3)] and pairs(history.accept(frame(spark, []))) == []
    assert pairs(history.accept(frame(spark, [point(6, 3, 3), point(7, 3, 5), point(8, 3, 5 + 0.3 * M)]))) == [(1, 6), (5, 7), (5, 8)]
    # Three rows are held, each once, whatever a job that died left behind.
    held = spark.read.parquet(str(tmp_path / "history/index")).filter("shape IS NOT NULL")
    assert sorted(r[0] for r in held.select("r").collect()) == [1, 2, 5]


def test_a_batch_that_died_half_written(spark, tmp_path, monkeypatch):
    history, one = D.FeatureHistory(str(tmp_path / "history")), frame(spark, [(1, 1, "Polygon", [ring(3, 3)]), (2, 1, "Polygon", [ring(4, 3)])])

    def dies(self, spark, name):
        if name.startswith("commits"):
            raise OSError("died")

    with monkeypatch.context() as m:
        m.setattr(D.FeatureHistory, "_touch", dies)
        with pytest.raises(OSError):
            history.accept(one)
    assert pairs(history.accept(one)) == []
    assert pairs(history.accept(frame(spark, [(3, 2, "Polygon", [ring(3, 3, start=1)])]))) == [(1, 3)]


def test_a_late_batch_is_checked_against_all_held(spark, tmp_path):
    history = D.FeatureHistory(str(tmp_path / "history"))
    assert pairs(history.accept(frame(spark, [(9, 5, "Polygon", [ring(3, 3)])]))) == []
    assert pairs(history.accept(frame(spark, [(2, 1, "Polygon", [ring(3, 3, back=True)]), (3, 1, "Point", [1, 1])]))) == [(9, 2)]
    assert pairs(history.accept(frame(spark, [(12, 6, "Point", [1, 1]), (13, 6, "Polygon", [ring(3, 3)])]))) == [(3, 12), (9, 13)]


def test_only_a_missing_history_is_empty(spark, tmp_path):
    history, one = D.FeatureHistory(str(tmp_path / "history")), frame(spark, [(1, 1, "Point", [3, 3])])
    history.accept(one)
    for f in tmp_path.glob("history/index/*/*.parquet"):
        f.write_bytes(b"broken")
    with pytest.raises(Exception, match=r"(?i)parquet"):
        history.accept(one).collect()


def test_the_history_is_neither_shuffled_nor_read_whole(spark, tmp_path):
    history = D.FeatureHistory(str(tmp_path / "history"), buckets=4)
    history.accept(frame(spark, [(1, 1, "Point", [3, 3])]))
    index = spark.table(history.table(spark)).select("hash", "b", "r")
    batch = spark.range(10).select(D.F.col("id").alias("hash"), D.F.lit(1).alias("x"))
    p = spark._jvm.PythonSQLUtils.explainString(batch.hint("merge").join(index, "hash")._jdf.queryExecution(), "formatted")
    assert "Bucketed: true" in p and "SelectedBucketsCount: 4 out of 4" in p and p.count("hashpartitioning") == 1
    assert "shape" not in "".join(line for line in p.splitlines() if line.startswith("ReadSchema"))


def test_a_row_that_comes_twice_is_one_row(spark):
    rows = [(1, 1, "Polygon", [ring(3, 3)]), (1, 1, "Polygon", [ring(3, 3)]), (2, 1, "Polygon", [ring(3, 3, back=True)]), (2, 1, "Polygon", [ring(3, 3, back=True)]), (3, 1, "Polygon", [ring(3, 3, jitter=[(0.2, 0.1)] * 4)])]
    assert pairs(D.repeats(frame(spark, rows))) == [(1, 2), (1, 3)]
    with pytest.raises(ValueError, match="several shapes"):
        D.repeats(frame(spark, [*rows, (1, 1, "Polygon", [ring(9, 3)])]))


def test_a_ring_given_twice_does_not_stand_for_another(spark):
    outer, inner = ring(3, 3), ring(3 + 5 * M, 3 + 2.5 * M, 10, 5)
    assert run(spark, [(1, 1, "Polygon", [outer, inner]), (2, 1, "MultiPolygon", [[outer], [outer]]), (3, 1, "Polygon", [outer])]) == {(2, 3)}


def test_large_ids_and_batches(spark):
    big = (1 << 62) + 7
    rows = [(big, 1, "Point", [1, 1]), (5, 2, "Point", [1, 1]), (big + 1, (1 << 31) - 1, "Point", [1, 1]), (-3, None, "Point", [1, 1])]
    assert run(spark, rows) == {(big, 5), (big, big + 1), (big, -3)}


def test_many_points_of_one_cell(spark):
    """A thousand points 1.2 m apart lie in a few cells: they are settled in a pass or two, not one by one."""
    grid = [(i, 1, "Point", [3 + 1.2 * M * (i % 32), 3 + 1.2 * M * (i // 32)]) for i in range(1000)]
    again = [(2000 + i, 1, "Point", [x + 0.2 * M, y]) for i, _, _, (x, y) in grid[::7]]
    assert run(spark, grid + again) == {(i, 2000 + i) for i, _, _, _ in grid[::7]}


def test_crowded_cells_are_split(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 1, "Polygon", [ring(20, 2, w=20 + 2 * int(k), jitter=rng.uniform(-0.1, 0.1, (4, 2)))]) for i, k in enumerate(rng.integers(0, 5, 300))]
    rows += [(1000 + i, int(b), "Polygon", [ring(20, 2, w=20 + 2 * int(k), jitter=rng.uniform(-0.1, 0.1, (4, 2)))]) for i, (k, b) in enumerate(zip(rng.integers(0, 7, 200), rng.integers(1, 3, 200), strict=True))]
    f = frame(spark, rows)
    want = {tuple(r) for r in D.repeats(f).collect()}
    assert len(want) == 500 - 7 and {tuple(r) for r in D.repeats(f, limit=20).collect()} == want


def greedy(o, order):
    accepted, out = [], {}
    for i in order:
        hits = np.flatnonzero(o.same(np.array(accepted, np.int64), np.full(len(accepted), i))) if accepted else []
        if len(hits):
            out[i] = accepted[hits[0]]
        else:
            accepted.append(i)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_cells_against_one_by_one(seed):
    """Own rows of a cell in which all is known are settled as if taken one by one; others wait, rightly."""
    rng = np.random.default_rng(seed)
    n = 120
    x, y = rng.uniform(0, 5, n), rng.uniform(0, 5, n)
    o = D.Outlines(D.pack(np.arange(n), np.arange(n) + 1, np.arange(n), 9e5 + x, 7e5 + y), np.full(n, D.POINT), 0.5)
    none = np.zeros(n, bool)
    want = greedy(o, range(n))
    best, wait = D.settle_cells(np.zeros(n, int), ~none, none, none, o)
    assert not wait.any() and {i: int(b) for i, b in enumerate(best) if b >= 0} == want
    mine = rng.random(n) < 0.7
    best, wait = D.settle_cells(np.zeros(n, int), mine, none, none, o)
    sure = mine & ~wait
    assert sure.any() and all(want.get(i, -1) == best[i] for i in np.flatnonzero(sure))


def test_against_brute_force(spark, small):
    f = spark.read.parquet(f"{small}/features.parquet")
    p = sorted(D.parse_features(f).select("b", "r", "kind", "shape").collect())
    o = D.Outlines(pa.array([bytes(r["shape"]) for r in p], pa.binary()), np.array([r["kind"] for r in p]), 0.5)
    want = {(p[a]["r"], p[b]["r"]) for b, a in greedy(o, range(len(p))).items()}
    assert {tuple(r) for r in D.repeats(f).collect()} == want


def test_long_outlines_and_large_shapes():
    a = np.linspace(0, 2 * np.pi, 3000, endpoint=False)
    x, y = 5e6 + 9e4 * np.cos(a), 1e6 + 9e4 * np.sin(a)
    blob = D.pack(np.array([0]), np.array([3000]), np.zeros(3000, int), x, y)
    back = D.Packed(blob)
    assert np.abs(back.x - x).max() < 0.006 and np.abs(back.y - y).max() < 0.006
    moved = D.pack(np.array([0]), np.array([3000]), np.zeros(3000, int), np.roll(x, 7)[::-1], np.roll(y, 7)[::-1] + 0.3)
    off = D.pack(np.array([0]), np.array([3000]), np.zeros(3000, int), x, y + 1)
    o = D.Outlines(pa.concat_arrays([blob, moved, off]), np.full(3, D.AREA), 0.5)
    assert o.same(np.array([0, 0]), np.array([1, 2])).tolist() == [True, False]


@pytest.mark.parametrize("text", [b"[1,2]", b"[[1,2],[3,4]]", b"[[[1,2,9],[3,4,9]],[[5,6],[7,8]]]", b"[[[[1e1,-2],[3,4]]],[[[5,6],[7,8]]]]", b" [ [ 1 , 2 ] ,\n[3,4] ] "])
def test_flat_reading_is_like_json(text):
    s = D.read_coordinates([None, text, b"[9,9]"])
    out: list = []
    D._positions(json.loads(text), out, 0)
    one = s.row == 1
    assert one.sum() == len(out) and (s.row == 2).sum() == 1
    assert (np.diff(s.ring[one]) != 0).tolist() == [a[0] != b[0] for a, b in zip(out, out[1:], strict=False)]
