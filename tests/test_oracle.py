import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).columns == ["total_score", "force_danger", "final_status", "grade"]


@pytest.mark.parametrize("name", list(entry.REGISTRY))
def test_query_equals_sql(spark, duck, name):
    ok, text = compare(spark, duck, name, SF_DIR, entry.queries(), entry.oracle_sql())
    assert ok, text
