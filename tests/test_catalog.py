import pytest

from tessella.plans import catalog

from .compare import connect, rows_of_duckdb, rows_of_spark


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_equals_sql(spark, sf, con, name):
    names, rows = rows_of_spark(catalog.QUERIES[name](spark, sf))
    want_names, want = rows_of_duckdb(con, catalog.ORACLE[name])
    assert names == want_names
    assert len(rows) == len(want) > 0
    assert rows == want
