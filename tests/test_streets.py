"""street_first_hits: fit for large tables, and rounded as SQL rounds."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from geoloom.functions import geometry as G
from geoloom.operators import spatial_join


@pytest.mark.parametrize("name", ["street_first_hits", "street_intersections"])
def test_methods_are_short_enough_for_the_jvm_to_compile(spark, small, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else nothing is generated before it runs
    try:
        code = spark._jvm.PythonSQLUtils.explainString(E.queries()[name](spark, small)._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000


def test_halves_are_rounded_as_in_sql(spark, tmp_path):
    con = duckdb.connect()
    streets = (80517, 559569, 330879, 460322, 331937, 1027229, 377791, 764954)
    con.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.1/lineitem.parquet' WHERE l_orderkey*8 + l_linenumber IN {streets}) TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = con.execute(E.oracle_sql()["street_first_hits"]).fetchall()
    assert len(want) == 4 and {tuple(r) for r in E.queries()["street_first_hits"](spark, str(tmp_path)).collect()} == set(want)


def test_first_of_equal_hits_does_not_hang_on_their_order(spark):
    # Street 1 is given twice, and meets street 2 twice at the same numbers of segments.
    rows = [(1, 0, 5.0, -1.0, 5.0, 1.0), (1, 0, 3.0, -1.0, 3.0, 1.0), (2, 0, 0.0, 0.0, 9.0, 0.0), (3, 0, -9.0, -7.0, -11.0, -9.0), (4, 0, -9.0, -9.0, -11.0, -7.0)]
    for r in (rows, rows[::-1]):
        s = spark.createDataFrame(r, "street long, seq int, x1 double, z1 double, x2 double, z2 double")
        assert {tuple(h)[:4] for h in spatial_join.street_intersections(s, 4.0).collect()} == {(1, 2, 3.0, 0.0), (3, 4, -10.0, -8.0)}


def test_short_lines_are_as_long_ones(spark):
    df = spark.createDataFrame([(0.0, 0.0, 3.0, 4.0, 3.0, 9.0), (1.0, 1.0, 1.0, 1.0, -2.0, 1.5), (1.0, 1.0, 2.0, 3.0, 2.0, 3.0)], "ax double, az double, bx double, bz double, cx double, cz double")
    corners = [(F.col("ax"), F.col("az")), (F.col("bx"), F.col("bz")), (F.col("cx"), F.col("cz"))]
    line = lambda c: F.array(*(F.struct(x.alias("x"), z.alias("z")) for x, z in c))
    for n in (2, 3):
        for r in df.select(G.short_line_segments(corners[:n]).alias("a"), G.line_segments(line(corners[:n])).alias("b")).collect():
            assert r["a"] == r["b"]
