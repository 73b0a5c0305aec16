"""Command line: import scripts, write and load bundles, explain a field, run SQL on the store, clear it."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from tracewell.operators.explain import Explainer
from tracewell.sources.bundle import import_bundle
from tracewell.sources.script import ScriptImporter
from tracewell.sources.store import ParquetStore


def session(conf: list[str]) -> SparkSession:
    builder = SparkSession.builder.appName("tracewell")
    for pair in conf:
        builder = builder.config(*pair.split("=", 1))
    return builder.getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracewell", description=__doc__)
    p.add_argument("--store", required=True, help="folder of the Parquet store")
    p.add_argument("--conf", action="append", default=[], metavar="KEY=VALUE", help="Spark setting")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("import", help="lineage of a script file or folder into the store")
    i.add_argument("path")
    i.add_argument("--continue", dest="go_on", action="store_true", help="report bad statements and go on")
    e = sub.add_parser("export-bundle", help="lineage of scripts as CSV files")
    e.add_argument("path")
    e.add_argument("to")
    b = sub.add_parser("import-bundle", help="load CSV files into the store")
    b.add_argument("path")
    b.add_argument("--vertices-only", action="store_true")
    x = sub.add_parser("explain", help="where a field comes from")
    x.add_argument("table")
    x.add_argument("column")
    x.add_argument("--format", choices=("text", "json", "tree"), default="text")
    q = sub.add_parser("sql", help="run SQL on views of the store")
    q.add_argument("statement")
    sub.add_parser("clear", help="delete the store")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or session(a.conf)
    store = ParquetStore(spark, a.store)
    if a.command == "import":
        done = ScriptImporter(spark, on_error="continue" if a.go_on else "raise").import_path(a.path, store)
        print(json.dumps({"scripts": len(done), "results": sum(len(d.results) for d in done), "failures": [f for d in done for f in d.failures]}))
    elif a.command == "export-bundle":
        print(json.dumps(ScriptImporter(spark).export_bundle(a.path, a.to)))
    elif a.command == "import-bundle":
        print(json.dumps(import_bundle(spark, a.path, store, a.vertices_only, report=print)))
    elif a.command == "explain":
        explainer = Explainer(store.tables())
        print(explainer.tree(a.table, a.column) if a.format == "tree" else explainer.report(a.table, a.column, a.format))
    elif a.command == "sql":
        store.views()
        spark.sql(a.statement).show(1000, truncate=False)
    else:
        store.clear()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
