"""Queries that SQL can express give DuckDB's rows."""

from __future__ import annotations

import pytest

from tests.oracle import connect, differences
from tracewell.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, data, name):
    assert differences(QUERIES[name](spark, data), connect(data), ORACLE_SQL[name]) == ""


def test_every_operator_has_its_query():
    assert {n.split("_")[0] for n in QUERIES} == {*(f"op{k}" for k in range(1, 11)), "pipeline"}
