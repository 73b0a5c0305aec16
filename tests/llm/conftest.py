from __future__ import annotations

import pytest

from tests.llm.cases import EXTRA, SCHEMA, odd_rows


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, blank and very long texts, repeated rows, and columns with clashing names."""
    return spark.createDataFrame([(*r, *EXTRA) for r in odd_rows()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
