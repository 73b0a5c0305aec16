"""Where queries register under a name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Tables of a folder by attribute; each is read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


class Registry:
    def __init__(self) -> None:
        self.functions: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
        if name in self.functions:
            raise ValueError(f"{name} is registered already")
        self.functions[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            self.sql[name] = sql

    def query(self, sql: str | None = None) -> Callable:
        """Decorator: the function takes Tables; its name is the query's."""

        def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.add(build.__name__, build, sql)
            return build

        return register
