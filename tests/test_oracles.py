"""Every query with an oracle agrees with it on the smallest tables; the others give rows."""

import pytest
from oracle import compare, views

from sievework.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return views(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE_SQL:
        assert compare(df, tables, catalog.ORACLE_SQL[name]) == ""
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
