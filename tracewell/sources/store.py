"""Where the lineage graph is kept: in memory, or as Parquet with cheap appends.

A write only adds a batch, a folder of its own rows, stamped with a rising number; a read keeps the latest row of each key
(vertices: vid; edges: src, dst, rank) by a partial aggregate; `compact` merges a table's batches into one when that
pays. A merged batch names those that it stands for in a file that appears by one rename: readers see either them or it,
and a batch that was added meanwhile stays.
"""

from __future__ import annotations

import os
import time
import uuid
from concurrent.futures import ThreadPoolExecutor, as_completed

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators import graph
from tracewell.plans.lineage import Result, completed
from tracewell.plans.schema import EDGE, EVENT, RESULT, VERTEX, VERTEX_OF
from tracewell.sources.shared import stored

TABLES = {**VERTEX, **EDGE}
STAMP = "_seq"


def keys_of(name: str) -> list[str]:
    return ["vid"] if name in VERTEX else ["src", "dst", "rank"]


def kept_frames(spark: SparkSession, result: Result) -> dict[str, DataFrame]:
    """Kept vertices and edges of one statement."""
    frames = completed(result.frames(spark), result.event["event_id"])
    context, seen = result.event["task"], result.event["capture_time_ms"] // 1000
    out = {}
    refs = frames["table_ref"]
    out["table_node"] = refs.select(F.concat(F.lit("table:"), "normalized_name").alias("vid"), "catalog", "database", "name", "source_type", "normalized_name").dropDuplicates(["vid"])
    for kind, name in VERTEX_OF.items():
        rows = frames[kind].withColumnRenamed("node_id", "vid")
        rows = rows.withColumn("qualifier", F.array_join("qualifier", ".")) if kind == "column" else rows
        out[name] = rows.select(*VERTEX[name].names).dropDuplicates(["vid"])
    out["table_has_column"] = graph.table_has_column(frames["column"], refs)
    # Stored once: twelve kept tables filter it, and the walks behind the edges end here.
    edges = stored(graph.converge(frames["edge"], seen, context["task_id"], context["run_id"]), "kept-edges")
    for name in EDGE:
        if name == "column_has_instance":
            out[name] = edges.filter(F.col("edge_name") == name).select("src", "dst", "rank", F.col("last_event_id").alias("event_id"), F.col("last_seen_time").alias("capture_time"), "role")
        elif name != "table_has_column":
            out[name] = edges.filter(F.col("edge_name") == name).select(*EDGE[name].names)
    return out


class MemoryStore:
    """Events (first write of an id wins) and results (last wins) in this process."""

    def __init__(self, spark: SparkSession):
        self.spark, self.events, self.results, self.kept = spark, {}, {}, {}

    def save_capture(self, event: dict) -> None:
        self.events.setdefault(event["event_id"], event)

    def save_lineage(self, result: Result) -> None:
        self.results[result.event["event_id"]] = result

    def save_batch(self, events: list[dict], results: list[Result]) -> None:
        for e in events:
            self.save_capture(e)
        for r in results:
            self.save_lineage(r)

    def list_events(self) -> list[dict]:
        return sorted(self.events.values(), key=lambda e: e["capture_time_ms"])

    def list_results(self) -> list[Result]:
        return sorted(self.results.values(), key=lambda r: r.event["capture_time_ms"])

    def latest_by_output(self) -> dict[str, Result]:
        """The newest result of each output table; of equal times the later one."""
        out: dict[str, Result] = {}
        for r in self.list_results():
            for t in r.rows["table_ref"]:
                if t["usage"] == "output":
                    out[t["normalized_name"]] = r
        return out

    def tables(self) -> dict[str, DataFrame]:
        for event_id, r in self.results.items():
            if event_id not in self.kept or self.kept[event_id][0] is not r:
                self.kept[event_id] = (r, kept_frames(self.spark, r))
        per = [self.kept[r.event["event_id"]][1] for r in self.list_results()]
        out = {}
        for name, shape in TABLES.items():
            df = self.spark.createDataFrame([], shape).withColumn(STAMP, F.lit(0))
            for k, frames in enumerate(per):
                df = df.unionByName(frames[name].withColumn(STAMP, F.lit(k + 1)))
            out[name] = graph.merge_latest(df.limit(0), df, keys_of(name), [STAMP]).drop(STAMP)
        return out

    def clear(self) -> None:
        for held in (self.events, self.results, self.kept):
            held.clear()


class ParquetStore:
    """The graph under `path`, a folder that Spark can write, one folder a table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _exists(self, name: str) -> bool:
        fs, path = self._fs()
        return fs.exists(path(f"{self.path}/{name}"))

    def append(self, frames: dict[str, DataFrame], sequence: int | None = None) -> None:
        """Add rows of any of the kept tables; later sequence numbers win."""
        sequence = time.time_ns() if sequence is None else sequence
        for name, df in frames.items():
            reconciled(df, TABLES[name]).withColumn(STAMP, F.lit(sequence).cast("bigint")).write.parquet(f"{self.path}/{name}/batch-{uuid.uuid4().hex}")

    def save_capture(self, event: dict) -> None:
        self.spark.createDataFrame([event], EVENT).write.mode("append").parquet(f"{self.path}/event")

    def save_lineage(self, result: Result) -> None:
        self.append(kept_frames(self.spark, result))

    def save_batch(self, events: list[dict], results: list[Result]) -> None:
        if events:
            self.spark.createDataFrame(events, EVENT).write.mode("append").parquet(f"{self.path}/event")
        for r in results:
            self.save_lineage(r)

    def events(self) -> DataFrame:
        if not self._exists("event"):
            return self.spark.createDataFrame([], EVENT)
        e = self.spark.read.schema(EVENT).parquet(f"{self.path}/event")
        return graph.merge_latest(e.limit(0), e, ["event_id"], ["capture_time_ms"], "first")

    def batches(self, name: str) -> list[str]:
        """Whole batches of a table that no merged one stands for."""
        fs, path = self._fs()
        if not self._exists(name):
            return []
        found = {f.getPath().getName() for f in fs.listStatus(path(f"{self.path}/{name}"))}
        gone: set[str] = set()
        for f in sorted(found):
            if f.startswith("replaced-"):
                gone |= {r[0] for r in self.spark.read.text(f"{self.path}/{name}/{f}").collect()}
        # A merged batch counts once its file of replaced ones is there.
        return sorted(f for f in found if (f.startswith("batch-") or f.startswith("merged-") and f"replaced-{f}" in found) and f not in gone and fs.exists(path(f"{self.path}/{name}/{f}/_SUCCESS")))

    def _rows(self, name: str, batches: list[str]) -> DataFrame:
        """The latest row of each key, with its stamp."""
        shape = T.StructType([*TABLES[name].fields, T.StructField(STAMP, T.LongType())])
        if not batches:
            return self.spark.createDataFrame([], shape)
        rows = self.spark.read.schema(shape).parquet(*(f"{self.path}/{name}/{b}" for b in batches))
        return graph.merge_latest(rows.limit(0), rows, keys_of(name), [STAMP])

    def table(self, name: str) -> DataFrame:
        return self._rows(name, self.batches(name)).drop(STAMP)

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in TABLES}

    def insert(self, name: str, rows: DataFrame) -> None:
        """Add rows whose keys are not there yet; others stay as they are."""
        self.append({name: rows.join(self.table(name).select(*keys_of(name)), keys_of(name), "left_anti")})

    def update(self, name: str, rows: DataFrame) -> None:
        """Change rows whose keys are there: the columns of rows take its values, the others stay. Other rows do nothing."""
        keys, old = keys_of(name), self.table(name)
        new = rows.select(*keys, F.struct(*(c for c in rows.columns if c not in keys)).alias("_new"))
        fresh = [c for c in rows.columns if c not in keys]
        changed = old.join(new, keys).select(*keys, *((F.col("_new")[c] if c in fresh else F.col(c)).alias(c) for c in old.columns if c not in keys))
        self.append({name: changed})

    def remove(self, name: str, keys: DataFrame) -> None:
        """Delete the given keys from a table (a rewrite of what stays)."""
        self._replace(name, lambda rows: rows.join(keys, keys_of(name), "left_anti"))

    def compact(self, name: str) -> None:
        self._replace(name, lambda rows: rows)

    def _replace(self, name: str, change) -> None:
        fs, path = self._fs()
        old = self.batches(name)
        merged = f"merged-{uuid.uuid4().hex}"
        change(self._rows(name, old)).write.parquet(f"{self.path}/{name}/{merged}")
        draft = path(f"{self.path}/{name}/.{merged}")
        out = fs.create(draft, True)
        out.write(bytearray("\n".join(old).encode()))
        out.close()
        fs.rename(draft, path(f"{self.path}/{name}/replaced-{merged}"))
        for b in old:
            fs.delete(path(f"{self.path}/{name}/{b}"), True)
            fs.delete(path(f"{self.path}/{name}/replaced-{b}"), False)

    def clear(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.path), True)

    def views(self, prefix: str = "") -> None:
        """Register every table as a temporary view, for plain SQL."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(f"{prefix}{name}")


def store_of(spark: SparkSession) -> MemoryStore | ParquetStore:
    """By spark.tracewell.storage.type (`parquet`, else memory) and spark.tracewell.storage.path."""
    if (spark.conf.get("spark.tracewell.storage.type", None) or os.environ.get("TRACEWELL_STORAGE_TYPE", "memory")).strip().lower() == "parquet":
        return ParquetStore(spark, spark.conf.get("spark.tracewell.storage.path"))
    return MemoryStore(spark)


_SAME = {"integer": "bigint", "int": "bigint", "long": "bigint", "int64": "bigint", "smallint": "bigint", "tinyint": "bigint"}


def reconciled(df: DataFrame, shape) -> DataFrame:
    """df with the columns of shape: missing ones null, whole numbers of any width alike, other types an error."""
    have = dict(df.dtypes)
    out = []
    for f in shape.fields:
        want = f.dataType.simpleString()
        if f.name not in have:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        if have[f.name] != want and have[f.name] != "void" and _SAME.get(have[f.name], have[f.name]) != _SAME.get(want, want):
            raise TypeError(f"column {f.name} is {have[f.name]}, expected {want}")
        out.append(F.col(f.name).cast(f.dataType))
    return df.select(*out)


def run_in_parallel(spark: SparkSession, tasks: list[tuple[str, int, object]], parallelism: int, run, pool: str = "import", report=print) -> int:
    """Run run(session, payload) for (label, size, payload) tasks, largest first, each in a session of its own and in the
    named scheduler pool; the first failure stops what has not begun. Returns the number of tasks done."""

    def one(label: str, payload) -> str:
        own = spark.newSession()
        own.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        run(own, payload)
        return label

    ordered = sorted(tasks, key=lambda t: (-t[1], t[0]))
    with ThreadPoolExecutor(max(1, min(parallelism, len(ordered)))) as threads:
        running = [threads.submit(one, label, payload) for label, _, payload in ordered]
        try:
            for k, f in enumerate(as_completed(running)):
                report(f"[{k + 1}/{len(running)}] {f.result()}")
        except BaseException:
            for f in running:
                f.cancel()
            raise
    return len(ordered)


__all__ = ["EVENT", "RESULT", "TABLES", "MemoryStore", "ParquetStore", "kept_frames", "reconciled", "run_in_parallel", "store_of"]
