import itertools
import json
from datetime import datetime

import numpy as np

from geoloom.operators import schema_drift as S

SCHEMA = "row_id bigint, feed_id int, file_id int, exported_at timestamp, properties string, path string"


def frame(spark, files):
    rows, k = [], 0
    for feed, file, at, props in files:
        for p in props:
            rows.append((k, feed, file, at and datetime(2024, 1, at), p if p is None or isinstance(p, str) else json.dumps(p), "clash"))
            k += 1
    return spark.createDataFrame(rows, SCHEMA)


def changes(df):
    return sorted(tuple(r) for r in S.top_level(S.schema_changes(df)).collect())


def test_all_kinds_of_change(spark):
    base = [{"id": f"r{i}", "height": i * 3, "kind": f"k{i}", "gone": i, "size": i} for i in range(10)]
    later = [{"id": f"r{i}", "hgt": str(i * 3), "kind": [f"k{i}"], "size": None if i else i, "fresh": i * 7 + 100} for i in range(10)]
    df = frame(spark, [(1, 2, 9, later), (1, 1, 3, base), (2, 5, 1, base), (2, 6, 2, base + base)])
    assert changes(df) == [(2, "added", "", "fresh"), (2, "removed", "gone", ""), (2, "renamed", "height", "hgt"), (2, "retyped", "kind", "kind")]


def test_odd_rows(spark):
    rows = [None, "", "{", "[1]", "3", {}, {"id": None, "a": 1}, {"OBJECTID": 4, "a": 1}, {"OBJECTID": 4, "a": 1}, {"a": "x" * 200_000}]
    df = frame(spark, [(1, 1, 1, rows), (1, 2, None, [{"OBJECTID": 4, "b": 1, "c": {"d": [5]}}] * 3), (None, None, 2, rows)])
    assert changes(df) == [(2, "added", "", "c"), (2, "removed", "id", ""), (2, "renamed", "a", "b")]
    assert S.top_level(S.schema_changes(df.limit(0))).count() == 0


def test_a_tie_in_time_goes_by_file_and_types_by_majority(spark):
    df = frame(spark, [(1, 8, 5, [{"id": 1, "a": 1}, {"id": 2, "a": 2}, {"id": 3, "a": "odd"}]), (1, 7, 5, [{"id": 1, "a": "1"}, {"id": 2, "a": "2"}, {"id": 3, "a": 3}])])
    assert changes(df) == [(8, "retyped", "a", "a")]


def test_least_cost_is_least():
    rng = np.random.default_rng(3)
    for n, m in itertools.product(range(1, 5), range(1, 6)):
        if n <= m:
            c = rng.integers(0, 20, (n, m)).astype(float)
            best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
            assert sum(c[i, j] for i, j in enumerate(S.least_cost(c))) == best


def test_moves_between_levels():
    old, new = S.tree([("a", "number"), ("o", "object")]), S.tree([("o", "object"), ("o\x1fa", "number")])
    agree = {("a", "o\x1fa"): 1.0}
    assert S.with_moves(S.edit_script(old, new, agree)[1], agree) == [("moved", "a", "o\x1fa")]


def test_one_table_of_stable_columns(spark):
    f = [(1, 1, 1, [{"id": "a", "height": 3}, {"id": "b", "height": 4}]), (1, 2, 2, [{"id": "a", "hgt": 3}, {"id": "b", "hgt": 4}]), (1, 3, 3, [{"id": "a", "tall": "3"}, {"id": "b", "tall": "4"}])]
    df = frame(spark, f)
    got = S.unify(df, S.compile_projections(S.explode_fields(df), S.schema_changes(df)), ["id", "height"]).orderBy("row_id").collect()
    assert [(r["id"], r["height"]) for r in got] == [("a", "3"), ("b", "4")] * 3


def unified(df, feed_columns=None):
    names = S.compile_projections(S.explode_fields(df), S.schema_changes(df))
    return [r["fields"] for r in S.unify(df, names).orderBy("row_id").collect()]


def test_retyped_values_come_out_in_one_dress(spark):
    dress = [lambda i: i, lambda i: {"value": i}, lambda i: [str(i)], lambda i: f" {i}.0 ", lambda i: [{"value": i + 0.0}]]
    df = frame(spark, [(1, k + 1, k + 1, [{"id": f"r{i}", "story": d(i), "tags": [i], "big": 12345678901234567890 + i, "x": 0.10} for i in range(4)]) for k, d in enumerate(dress)])
    want = [{"id": f"r{i}", "story": str(i), "tags": f"[{i}]", "big": str(12345678901234567890 + i), "x": "0.1"} for i in range(4)] * 5
    assert unified(df) == want


def test_odd_single_values_and_several_values(spark):
    df = frame(spark, [(1, 1, 1, [{"id": "a", "n": 4}, {"id": "b", "n": ["4"]}, {"id": "c", "n": 5}, {"id": "d", "n": [4, 5]}, {"id": "e", "n": {"lo": 4, "hi": 5}}, {"id": "f", "n": None}, None, "{"]), (None, None, 1, [{"id": "a", "n": {"value": 1}}, {"id": "b", "n": 1}])])
    assert unified(df) == [{"id": "a", "n": "4"}, {"id": "b", "n": "4"}, {"id": "c", "n": "5"}, {"id": "d", "n": "[4,5]"}, {"id": "e", "n.lo": "4", "n.hi": "5"}, {"id": "f", "n": None}, None, None, {"id": "a", "n": "1"}, {"id": "b", "n": "1"}]


def test_moved_and_nested_fields_keep_their_column(spark):
    f = lambda make: [{"id": f"r{i}", **make(i)} for i in range(6)]
    files = [f(lambda i: {"a": i * 3, "o": {"x": f"x{i}", "k": i % 2}}), f(lambda i: {"o": {"a": i * 3, "y": f"x{i}", "k": i % 2}}), f(lambda i: {"p": {"a": i * 3, "y": f"x{i}", "k": i % 2}}), f(lambda i: {"a": i * 3, "o": {"x": f"x{i}", "k": i % 2}})]
    df = frame(spark, [(1, k + 1, k + 1, rows) for k, rows in enumerate(files)])
    want = [{"id": f"r{i}", "a": str(i * 3), "o.x": f"x{i}", "o.k": str(i % 2)} for i in range(6)]
    assert unified(df) == want * 4


def test_a_move_between_levels_is_a_change_of_the_top_level(spark):
    f = lambda make: [{"id": f"r{i}", **make(i)} for i in range(6)]
    df = frame(spark, [(1, 1, 1, f(lambda i: {"a": i * 3, "o": {"x": f"x{i}"}})), (1, 2, 2, f(lambda i: {"o": {"a": i * 3, "x": f"x{i}"}})), (1, 3, 3, f(lambda i: {"a": i * 3, "o": {"x": f"x{i}"}}))])
    assert changes(df) == [(2, "removed", "a", ""), (3, "added", "", "a")]


def test_flags_that_agree_by_chance_are_no_rename():
    # 92 % of either are "yes": 34 of 40 agree where they have nothing to do with each other.
    chance = 0.92**2 + 0.08**2
    assert S.agreement(40, 34, chance) == 0.0 and S.agreement(40, 40, chance) == 1.0 and S.agreement(40, 40, 1.0) == 1.0
    assert S.agreement(40, 36, 0.05) == 0.9 and S.agreement(25, 20, 0.2) == 0.8


def test_independent_flags(spark):
    import random

    rng, flag = random.Random(3), lambda: "yes" if rng.random() < 0.9 else "no"
    rows = [(i, 1, f, t, json.dumps({"id": i, key: flag(), old: i * 7})) for f, t, key, old in ((1, "2024-01-01", "heated", "area"), (2, "2024-02-01", "insured", "size")) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, feed_id int, file_id int, exported_at string, properties string")
    assert {tuple(r)[1:] for r in S.top_level(S.schema_changes(df)).collect()} == {("removed", "heated", ""), ("added", "", "insured"), ("renamed", "area", "size")}
