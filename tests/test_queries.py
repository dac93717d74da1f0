"""Every registered query of the sequence and container layers against the oracle."""

import pytest

from tests.oracle import connect, differences
from tidewell.plans.catalog import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    assert name in ORACLES
    assert differences(db, ORACLES[name], QUERIES[name](spark, DIR)) == ""


@pytest.mark.parametrize("balance", ["-0.0::DOUBLE", "'-0.0'::DOUBLE", "0.0::DOUBLE", "NULL", "'NaN'::DOUBLE", "'-inf'::DOUBLE"])
def test_odd_balances(spark, tmp_path, balance):
    made = connect(DIR)
    made.execute(f"COPY (SELECT * REPLACE (CASE WHEN c_custkey % 10 IN (3, 4, 8) THEN {balance} ELSE c_acctbal END AS c_acctbal) FROM customer) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    name = "cmp_comparing_double"
    assert differences(connect(str(tmp_path)), ORACLES[name], QUERIES[name](spark, str(tmp_path))) == ""
