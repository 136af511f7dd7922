"""Every core query against its SQL on the smallest tables."""

from pathlib import Path

import pytest
from oracle import differences, duck

from cellspindle.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, con, name):
    assert differences(catalog.QUERIES[name](spark, SF), catalog.SQL[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["feature", "cell", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
