from pathlib import Path

import pytest
from oracle import differences, duck

from cellspindle.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, con, name):
    assert differences(queries.QUERIES[name](spark, SF), queries.SQL[name], con) == ""
