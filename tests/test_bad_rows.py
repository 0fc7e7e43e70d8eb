import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.operators import bad_rows as B

GOOD = ['1.5,-2,a,b', '+3, 4 ,"x, y",', '"5","6","say ""hi""","two\nlines"', "90,-180,s,l", ".5,1.,s,tab\tin"]
BAD = [("", "columns"), ("   ", "columns"), ("1,2,a", "columns"), ("1,2,a,b,c", "columns"), ('1,2,"a,b', "quoting"), ('1,2,"a"x,b', "quoting"), ('1,2,a"b,c', "quoting"), ("91,2,a,b", "value"), ("1,181,a,b", "value"), ("1e1,2,a,b", "value"), ("NaN,2,a,b", "value"), ("1,2, ,b", "value"), ("1,2,a,b\x07", "value"), ("1,2,a�,b", "value"), ("1,2,a,b\r", "value"), ('1,2,"a,b\n3', "quoting")]


def rows(t):
    return list(zip(*(t[c].to_pylist() for c in t.column_names), strict=True))


def test_reasons():
    for r in GOOD:
        assert B.diagnose(r)[4] is None, r
    for r, why in BAD:
        assert B.diagnose(r) == (None, None, None, None, why), r
    assert B.diagnose(None)[4] == "columns"
    assert B.diagnose(GOOD[2]) == (5.0, 6.0, 'say "hi"', "two\nlines", None)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(GOOD + [b for b, _ in BAD]), st.text('1,2."a \n-', max_size=12), st.none()), max_size=400))
def test_blocks_agree_with_the_strict_reader(raws):
    assert rows(B.parse_block(pa.array(raws, pa.string()))) == [B.diagnose(r) for r in raws]


def test_frame(spark):
    raws = [None, "", *GOOD, *GOOD, *(b for b, _ in BAD), "1,2,a," + "z" * 300_000]
    df = spark.createDataFrame([(i, 2, r, "x") for i, r in enumerate(raws)], "line_id bigint, line_no int, raw string, reason string")
    got = {r["line_id"]: r["reason"] for r in B.parse_records(df).collect()}
    assert got == {i: B.diagnose(r)[4] for i, r in enumerate(raws)}
    with pytest.raises(ValueError):
        B.parse_records(df, keep=("reason",))
    assert B.parse_records(df.limit(0)).count() == 0


def test_headers_are_left_out(spark):
    df = spark.createDataFrame([(1, "f", 1, "Latitude,Longitude,a,b"), (2, "f", 2, "Latitude,Longitude,a,b"), (3, "f", None, "1,2,a,b")], "line_id bigint, file_name string, line_no int, raw string")
    assert {(r["line_id"], r["reason"]) for r in B.load_jcsu(df).collect()} == {(2, "value"), (3, None)}
