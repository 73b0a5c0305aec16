"""Every query with SQL gives DuckDB's rows."""

from __future__ import annotations

import pytest

from tests.oracle import connect, differences
from tracewell import queries

SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, data, con, name):
    assert differences(queries.queries()[name](spark, data), con, SQL[name]) == ""


def test_queries_without_sql_run(spark, data):
    for name in sorted(set(queries.queries()) - set(SQL)):
        assert queries.queries()[name](spark, data).columns


def test_from_unixtime_of_years_without_four_digits(spark, tmp_path):
    keys = [None, -100_000_000, -4_371_954, -4_371_953, -1_200_000, -800_000, -719_529, -719_528, -719_162, -1, 0, 2_932_896, 2_932_897, 9_000_000, 106_751_990]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    name = "f_from_unixtime"
    assert differences(queries.queries()[name](spark, str(tmp_path)), connect(str(tmp_path)), SQL[name]) == ""
