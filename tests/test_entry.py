import glob
import os

import duckdb
import pytest

import __spark_entry__ as E

NAMES = sorted(E.queries())


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: "null" if v is None or v != v else f"{v + 0.0!r}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", [n for n in NAMES if n in E.oracle_sql()])
def test_queries_against_sql(spark, small, duck, name):
    df = E.queries()[name](spark, small)
    got = duck.execute(E.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(got.fetchall(), columns)


@pytest.mark.parametrize("name", [n for n in NAMES if n not in E.oracle_sql()])
def test_other_queries_run(spark, small, name):
    df = E.queries()[name](spark, small)
    assert all(len(r) == len(df.columns) for r in df.collect())


def test_entry(spark):
    assert E.entry(spark).count() > 0
