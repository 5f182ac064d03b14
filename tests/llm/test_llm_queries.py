"""The registered training-data queries against their SQL, and in outline where there is none."""

import os

import pytest

from strandloom.llm import queries
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF, queries.QUERIES[name], queries.SQL.get(name)) is None
