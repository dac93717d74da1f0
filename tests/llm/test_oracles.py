"""The registered corpus queries that have SQL against DuckDB."""

import pytest

from tests.oracle import connect, differences
from tidewell.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    assert differences(db, ORACLES[name], QUERIES[name](spark, DIR)) == ""
