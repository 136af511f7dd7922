"""Queries whose smallest tables have few or no results, against their SQL on larger ones."""

from pathlib import Path

import pytest
from oracle import differences, duck

from cellspindle.plans import catalog

SF = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_fusion_molecules(spark, con):
    found = catalog.QUERIES["fusion_molecules"](spark, SF).cache()
    assert found.count() == 101 and found.where("length(umi) < 10").count() == 0
    assert differences(found, catalog.SQL["fusion_molecules"], con) == ""


def test_parse_barcodes(spark, con):
    found = catalog.QUERIES["parse_barcodes"](spark, SF).cache()
    assert found.where("status = 'corrected'").count() > 0 and found.where("length(seq) > 25").count() > 0
    assert found.where("name not rlike 'CB:Z:[ACGT]{20}$'").count() == 0
    assert differences(found, catalog.SQL["parse_barcodes"], con) == ""


def test_peaks_deep(spark, con):
    found = catalog.QUERIES["peaks_deep"](spark, SF).cache()
    assert 0 < found.count() < catalog.QUERIES["peaks"](spark, SF).count()
    assert differences(found, catalog.SQL["peaks_deep"], con) == ""
