"""All registered queries against their SQL, and the driver contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from checks.compare import connect, difference
from checks.oracle import ORACLE
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, folder, duck, name):
    assert difference(QUERIES[name](spark, folder), duck, ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    out = contract.entry(spark)
    assert out.columns[0] == "SK_ID_CURR" and out.count() > 0
