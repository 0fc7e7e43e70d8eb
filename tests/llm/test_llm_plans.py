import pytest

import __spark_entry__ as E


@pytest.mark.parametrize("name", ["p9_packed"])
def test_no_pairs_of_all_with_all(spark, small, name):
    p = spark._jvm.PythonSQLUtils.explainString(E.queries()[name](spark, small)._jdf.queryExecution(), "formatted")
    assert "CartesianProduct" not in p and "NestedLoop" not in p
