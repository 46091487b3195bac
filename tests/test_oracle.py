"""Every query over series against its DuckDB text on the smallest tables."""

import pytest

from __spark_entry__ import entry
from seriesloom.plans import load_all
from tools.compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    status, message, _ = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert status in ("exact", "close", "rows"), message
