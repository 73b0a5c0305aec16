"""Lineage of one statement or DataFrame, as DataFrames."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import graph
from tracewell.plans import ids, schema
from tracewell.plans.names import Names
from tracewell.plans.reader import Plan, Reader
from tracewell.plans.resolve import Lineage, Resolver, physical_sources


@dataclass(frozen=True)
class TaskContext:
    """Who runs a statement; blank fields read as missing."""

    task_id: str | None = None
    task_name: str | None = None
    run_id: str | None = None
    biz_date: str | None = None
    owner: str | None = None
    script_path: str | None = None

    def __post_init__(self):
        for k, v in self.__dict__.items():
            object.__setattr__(self, k, v if v and v.strip() else None)

    def merged(self, other: TaskContext | None) -> TaskContext:
        """The first value of each field that is there."""
        return self if other is None else TaskContext(**{k: v or getattr(other, k) for k, v in self.__dict__.items()})


def runtime_event_id(context: TaskContext, status: str, func: str, analyzed: str | None, logical: str | None) -> str:
    return ids.sha1(context.run_id or context.task_id or "unknown-run", status, func, analyzed or logical or func)


@dataclass
class Result:
    """Rows of a statement by kind (schema.RESULT), and its event."""

    event: dict
    rows: dict[str, list[dict]]
    statement_type: str
    column_sources: list[tuple[str, str]] = field(default_factory=list)

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        return graph.frames_of(spark, self.rows, schema.RESULT)


def app_context(spark: SparkSession) -> dict:
    sc = spark.sparkContext
    return {"app_id": sc.applicationId, "app_name": sc.appName, "user": sc.sparkUser(), "master": sc.master}


def event_row(spark: SparkSession, event_id: str, context: TaskContext, func: str, plans: dict, status: str = "SUCCESS", duration_ns: int = 0, when_ms: int | None = None, error: str | None = None) -> dict:
    return {"event_id": event_id, "status": status, "task": dict(context.__dict__), "app": app_context(spark), "func_name": func, "duration_ns": duration_ns, "capture_time_ms": int(time.time() * 1000) if when_ms is None else when_ms, "error_message": error, "plans": {k: plans.get(k) for k in ("logical", "analyzed", "optimized", "physical")}}


def parse(spark: SparkSession, sql_or_df: str | DataFrame, context: TaskContext | None = None, event_id: str | None = None, func: str = "sql", when_ms: int | None = None, by_name: bool = False) -> Result:
    """Lineage rows of a statement (analyzed, not run) or a DataFrame.

    by_name: a statement that cannot be analyzed is read by names instead, with a warning NOT_ANALYZED; else that is an error.
    """
    reader = Reader(spark)
    try:
        parsed, analyzed = reader.analyzed(sql_or_df)
    except Exception as e:
        if not by_name or isinstance(sql_or_df, DataFrame):
            raise
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql_or_df)
        return parse_plan(spark, reader, parsed, parsed, context or TaskContext(), event_id, func, when_ms, plan=Names(reader).read(parsed), warning=("NOT_ANALYZED", str(e).strip().splitlines()[0]))
    return parse_plan(spark, reader, parsed, analyzed, context or TaskContext(), event_id, func, when_ms)


def parse_plan(spark: SparkSession, reader: Reader, parsed, analyzed, context: TaskContext, event_id: str | None, func: str, when_ms: int | None = None, status: str = "SUCCESS", duration_ns: int = 0, plan: Plan | None = None, warning: tuple[str, str] | None = None) -> Result:
    texts = {"logical": parsed.toString(), "analyzed": analyzed.toString()}
    event = event_row(spark, event_id or runtime_event_id(context, status, func, texts["analyzed"], texts["logical"]), context, func, texts, status, duration_ns, when_ms)
    lineage = Lineage(event["event_id"], context.task_id, context.run_id, event["capture_time_ms"] // 1000)
    resolver = Resolver(lineage)
    resolver.statement(plan or reader.plan(analyzed))
    rows = lineage.rows()
    if warning:
        rows["warning"].append(dict(zip(("code", "message"), warning)))
    return Result(event, rows, lineage.statement_type, physical_sources(lineage, resolver))


def lineage_of(spark: SparkSession, sql_or_df: str | DataFrame, context: TaskContext | None = None, **options) -> dict[str, DataFrame]:
    """DataFrames by kind, with producer links and derived attribution among the edges."""
    result = parse(spark, sql_or_df, context, **options)
    return completed(result.frames(spark), result.event["event_id"])


def completed(frames: dict[str, DataFrame], event_id: str) -> dict[str, DataFrame]:
    edges = frames["edge"]
    event = F.lit(event_id).alias("event_id")
    linked = edges.unionByName(graph.producer_links(frames["column_instance"], frames["scope"]).select("*", event)).distinct()
    derived = graph.derived_attribution(frames["column_instance"], linked).select("*", event)
    return {**frames, "edge": linked.unionByName(derived)}


def column_lineage(spark: SparkSession, sql_or_df: str | DataFrame) -> DataFrame:
    """(output_column, source_table, source_column): the physical columns behind every output."""
    rows = [(name, *source.rsplit(".", 1)) for name, source in parse(spark, sql_or_df).column_sources]
    return spark.createDataFrame(rows, "output_column string, source_table string, source_column string")
