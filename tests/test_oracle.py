"""Every query with SQL gives the SQL's rows; the others give rows."""
import pytest

from oracle import compare, connect
from saddle.plans import catalog

#: Run at small settings by tests/test_runs.py.
LONG = {n for n in catalog.QUERIES if n.startswith(("sweep_", "repeat_"))}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, con, small, name):
    assert compare(spark, con, small, name, catalog.QUERIES[name], catalog.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - LONG))
def test_gives_rows(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 20 and set(e.oracle_sql()) <= set(e.queries())
