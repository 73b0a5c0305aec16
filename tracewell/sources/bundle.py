"""The CSV bundle: vertices/*.csv and edges/*.csv without header, schema text, and a manifest; written and read by Spark."""

from __future__ import annotations

import json
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tracewell.plans.lineage import Result
from tracewell.plans.schema import EDGE, VERTEX
from tracewell.sources.store import MemoryStore, ParquetStore, run_in_parallel

NULL = "__TRACEWELL_NULL__"
OPTIONS = {"header": "false", "quote": '"', "escape": '"', "nullValue": NULL}
READ = OPTIONS | {"multiLine": "true", "emptyValue": ""}
PARALLEL = 4


def folder(name: str) -> str:
    return f"{'vertices' if name in VERTEX else 'edges'}/{name}.csv"


def schema_text(space: str = "lineage", partitions: int = 10, replicas: int = 1, id_length: int = 256) -> str:
    """CREATE statements for the space, its vertex tags and its edges."""
    kinds = {"string": "string", "int": "int", "bigint": "int", "boolean": "bool"}

    def fields(shape: T.StructType, skip: int) -> str:
        return ", ".join(f"`{f.name}` {kinds[f.dataType.simpleString()]} NULL" for f in shape.fields[skip:])

    lines = [f"CREATE SPACE IF NOT EXISTS `{space}` (partition_num = {partitions}, replica_factor = {replicas}, vid_type = FIXED_STRING({id_length}));", f"USE `{space}`;"]
    lines += [f"CREATE TAG IF NOT EXISTS `{n}` ({fields(s, 1)});" for n, s in VERTEX.items()]
    lines += [f"CREATE EDGE IF NOT EXISTS `{n}` ({fields(s, 3)});" for n, s in EDGE.items()]
    return "\n".join(lines) + "\n"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


class BundleSession:
    """Collects the results of scripts, one write at the end."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.memory, self.scripts, self.began = spark, path.rstrip("/"), MemoryStore(spark), [], time.time()

    def append_script(self, script: str, events: list[dict], results: list[Result]) -> None:
        self.scripts.append(script)
        self.memory.save_batch(events, results)

    def finish(self) -> dict:
        """Write the bundle; returns the summary that is also the manifest."""
        counts = {}
        write_text(self.spark, f"{self.path}/schema.ddl", schema_text())
        for name, df in self.memory.tables().items():
            df.write.mode("overwrite").options(**OPTIONS).csv(f"{self.path}/{folder(name)}")
            counts[name] = read_table(self.spark, self.path, name).count()
        summary = {"scripts": len(self.scripts), "events": len(self.memory.events), "results": len(self.memory.results), "vertices": sum(counts[n] for n in VERTEX), "edges": sum(counts[n] for n in EDGE), "tables": counts}
        write_text(self.spark, f"{self.path}/manifest.json", json.dumps(summary))
        return summary | {"path": self.path, "duration_ms": int((time.time() - self.began) * 1000)}


def open_session(spark: SparkSession, path: str) -> BundleSession:
    return BundleSession(spark, path)


def checked(columns: list[str], name: str) -> None:
    """The first columns must be the key, and the others those of the table."""
    want = ["vid"] if name in VERTEX else ["src", "dst", "rank"]
    if columns[: len(want)] != want:
        raise ValueError(f"{name} begins with {columns[: len(want)]}, expected {want}")
    if columns != {**VERTEX, **EDGE}[name].names:
        raise ValueError(f"{name} has the columns {columns}, expected {({**VERTEX, **EDGE}[name]).names}")


def declared(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Columns of each table by the bundle's own schema text, keys first."""
    text = spark.read.text(f"{path.rstrip('/')}/schema.ddl", wholetext=True).collect()[0][0]
    found = re.findall(r"CREATE (TAG|EDGE) IF NOT EXISTS `(\w+)` \((.*)\);", text)
    return {name: [*(["vid"] if kind == "TAG" else ["src", "dst", "rank"]), *re.findall(r"`(\w+)`", fields)] for kind, name, fields in found}


def read_table(spark: SparkSession, path: str, name: str, partitions: int | None = None) -> DataFrame:
    """A table of the bundle, after its declared columns and the width of its records have been looked at."""
    shape, at = {**VERTEX, **EDGE}[name], f"{path.rstrip('/')}/{folder(name)}"
    if (columns := declared(spark, path).get(name)) is None:
        raise ValueError(f"the bundle's schema declares no {name}")
    checked(columns, name)
    first = spark.read.options(**READ).csv(at).limit(1)
    if first.columns and len(first.columns) != len(shape):
        raise ValueError(f"{name} has records of {len(first.columns)} fields, expected {len(shape)}")
    df = spark.read.schema(shape).options(**READ).csv(at)
    return df.repartition(partitions) if partitions else df


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path.rstrip('/')}/manifest.json", wholetext=True).collect()[0][0])


def import_bundle(spark: SparkSession, path: str, store: ParquetStore, vertices_only: bool = False, parallelism: int = PARALLEL, report=lambda line: None) -> dict:
    """Load a bundle into a store, tables in parallel, the largest first."""
    began, known = time.time(), manifest(spark, path)
    names = [*VERTEX, *([] if vertices_only else EDGE)]
    sequence = time.time_ns()

    def load(session: SparkSession, name: str) -> None:
        ParquetStore(session, store.path).append({name: read_table(session, path, name)}, sequence)

    tables = run_in_parallel(spark, [(n, known["tables"].get(n, 0), n) for n in names], parallelism, load, report=report)
    return {"tables": tables, "vertices": known["vertices"], "edges": 0 if vertices_only else known["edges"], "duration_ms": int((time.time() - began) * 1000)}
