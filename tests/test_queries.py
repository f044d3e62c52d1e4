"""Every registered query against its SQL on the small tables."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect
from checks.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    ok, note = compare(df, con, SQL[name])
    assert ok, note


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["doc_id", "risk_score", "risk_level"]
    assert df.count() == 200


def test_worker_code_travels_with_the_query():
    from pyspark import cloudpickle

    assert {"checks", "sievelight"} <= set(cloudpickle.list_registry_pickle_by_value())
