"""The queries of the training-data operators that have SQL, against it."""

from __future__ import annotations

import pytest

from checks.compare import connect, difference
from rowloom.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, folder, name):
    assert difference(QUERIES[name](spark, folder), connect(folder), ORACLE[name]) == ""


def test_every_operator_has_one_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
