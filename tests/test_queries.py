"""Every registered query against its SQL, over the whole smallest tables."""

import os

import pytest
from compare import connect, differences

import __spark_entry__
from soundrows.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    problem = differences(spark, connection, name, QUERIES[name], ORACLES[name], FOLDER)
    assert problem is None


def test_entry(spark):
    assert set(QUERIES) == set(ORACLES) <= set(__spark_entry__.queries())
    frame = __spark_entry__.entry(spark)
    assert frame.columns[:3] == ["dataset", "rule_index", "rule_id"]
    assert frame.count() > 60
