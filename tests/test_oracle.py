"""Every registered query against its SQL; queries without SQL must run."""

import pytest
from oracle import compare, connect

from quillmesh.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name not in ORACLES:
        assert QUERIES[name](spark, FOLDER).count() >= 0
        return
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], FOLDER) is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())
