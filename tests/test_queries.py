"""Every named query against its SQL on the smallest tables."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as contract
from quayside.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"

# Checked in test_operators.py instead: results depend on a sketch.
WITHOUT_SQL = {"a5_query_rollup_approx"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_but_sketches_has_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, SF, name, QUERIES[name], ORACLES[name]) == ""


def test_contract_hands_out_all_of_them():
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_gives_rows(spark):
    assert contract.entry(spark).count() == 1
