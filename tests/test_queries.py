"""Every registered query against its SQL on the smallest tables, and the driver's contract."""

import os

import pytest

import __spark_entry__ as entry
from strandloom.plans import core_queries
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(core_queries.QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF, core_queries.QUERIES[name], core_queries.SQL.get(name)) is None


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_llm_subpackage():
    root = os.path.dirname(os.path.abspath(core_queries.__file__))
    for folder, _, files in os.walk(os.path.dirname(root)):
        if os.path.basename(folder) != "llm":
            assert not any("llm" in open(os.path.join(folder, f)).read().replace("tests/llm", "") for f in files if f.endswith(".py") and f != "__init__.py")
