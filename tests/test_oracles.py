import os

import pytest
from compare import spark_rows, sql_rows

from sparkloom.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    names, rows = spark_rows(QUERIES[name](spark, SF))
    want_names, want = sql_rows(ORACLES[name], SF)
    assert names == want_names
    assert len(rows) == len(want)
    assert rows == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["subject_category", "predicate", "object_category", "n"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
