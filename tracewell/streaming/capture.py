"""Capturing lineage from running jobs: an explicit call, a context manager, and an optional listener."""

from __future__ import annotations

import contextlib
import contextvars
import logging
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from tracewell.plans.lineage import Result, TaskContext, event_row, parse_plan, runtime_event_id
from tracewell.plans.reader import Reader, get, option
from tracewell.sources.shared import shared_dir

log = logging.getLogger(__name__)
_CONTEXT: contextvars.ContextVar[TaskContext | None] = contextvars.ContextVar("task_context", default=None)
#: Tasks that run in this process now, for callbacks on Spark's thread; and the listeners that they wait for.
_RUNNING: list[TaskContext] = []
_LISTENERS: list[Listener] = []
PREFIX = "spark.tracewell.task."
_FIELDS = {"task_id": "id", "task_name": "name", "run_id": "runId", "biz_date": "bizDate", "owner": "owner", "script_path": "scriptPath"}


@contextlib.contextmanager
def task(**fields: str) -> Iterator[TaskContext]:
    """Statements inside run as this task. With a listener, the end waits until the events of these have been delivered."""
    context = TaskContext(**fields)
    token = _CONTEXT.set(context)
    _RUNNING.append(context)
    try:
        yield context
    finally:
        for listener in list(_LISTENERS):
            listener.drain()
        _RUNNING.remove(context)
        _CONTEXT.reset(token)


def current_context(spark: SparkSession) -> TaskContext:
    """The context manager's task, then local properties, then the session's configuration; merged field by field."""
    sc = spark.sparkContext
    local = TaskContext(**{k: sc.getLocalProperty(PREFIX + v) for k, v in _FIELDS.items()})
    conf = TaskContext(**{k: spark.conf.get(PREFIX + v, None) for k, v in _FIELDS.items()})
    return (_CONTEXT.get() or (_RUNNING[-1] if _RUNNING else TaskContext())).merged(local).merged(conf)


class Capture:
    """Parses finished (or failed) executions and hands events and results to a store; never fails the job."""

    def __init__(self, spark: SparkSession, store):
        self.spark, self.store, self.reader = spark, store, Reader(spark)

    def sql(self, statement: str) -> DataFrame:
        """Run a statement as spark.sql does, and capture it."""
        began = time.time_ns()
        try:
            df = self.spark.sql(statement)
        except Exception as e:
            self.failed("sql", statement, e)
            raise
        self.succeeded("sql", df, time.time_ns() - began, statement)
        return df

    def write(self, df: DataFrame, run) -> None:
        """Run run(df), an action on a DataFrame, and capture the DataFrame's plan."""
        began = time.time_ns()
        run(df)
        self.succeeded("save", df, time.time_ns() - began)

    def succeeded(self, func: str, df: DataFrame, duration_ns: int, statement: str | None = None) -> Result | None:
        try:
            parsed, analyzed = self.reader.analyzed(statement if statement is not None else df)
            result = parse_plan(self.spark, self.reader, parsed, analyzed, current_context(self.spark), None, func, None, "SUCCESS", duration_ns)
            self.store.save_capture(result.event)
            self.store.save_lineage(result)
            return result
        except Exception:
            log.warning("lineage of %s was not captured", func, exc_info=True)
            return None

    def failed(self, func: str, statement: str, error: Exception) -> None:
        try:
            context = current_context(self.spark)
            event_id = runtime_event_id(context, "FAILURE", func, None, statement)
            self.store.save_capture(event_row(self.spark, event_id, context, func, {"logical": statement}, "FAILURE", error=str(error)))
        except Exception:
            log.warning("failure of %s was not captured", func, exc_info=True)


class Listener:
    """A QueryExecutionListener over Py4J. Callbacks come on Spark's listener thread, one for each of a statement's
    executions: nested writes repeat a plan, so equal plans of a task are captured once. The task is asked for at every
    event: of what runs in this process, else of the session's configuration."""

    def __init__(self, capture: Capture):
        self.capture, self.seen, self.closed = capture, set(), False
        self.own = shared_dir(capture.spark).removeprefix("file:").lstrip("/")

    def register(self) -> Listener:
        from pyspark.java_gateway import ensure_callback_server_started

        ensure_callback_server_started(self.capture.spark.sparkContext._gateway)
        self.drain()  # what has ended before is not ours
        self.capture.spark._jsparkSession.listenerManager().register(self)
        _LISTENERS.append(self)
        return self

    def drain(self, most_ms: int = 20_000) -> None:
        """Wait until Spark has delivered the events of what has ended."""
        with contextlib.suppress(Exception):
            self.capture.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(most_ms)

    def unregister(self) -> None:
        # Spark knows the Java side of this object by reference, and Py4J makes a new one at every call: so Spark may
        # keep calling, and is answered at once.
        self.closed = True
        self.capture.spark._jsparkSession.listenerManager().unregister(self)
        if self in _LISTENERS:
            _LISTENERS.remove(self)

    def onSuccess(self, func, execution, duration):  # noqa: N802  the JVM interface's names
        if self.closed:
            return
        try:
            c, analyzed = self.capture, execution.analyzed()
            path = get(analyzed, "outputPath")
            if path is not None and option(get(analyzed, "catalogTable")) is None and path.toString().removeprefix("file:").lstrip("/").startswith(self.own):
                return  # a table of this library's own walks
            plan = c.reader.plan(analyzed)
            context = current_context(c.spark)
            print_of = (context, tuple(p.kind for p in plan.walk()), tuple(p.target.normalized for p in plan.walk() if p.target), analyzed.toString())
            if print_of in self.seen:
                return
            self.seen.add(print_of)
            result = parse_plan(c.spark, c.reader, execution.logical(), analyzed, context, None, func, None, "SUCCESS", duration)
            c.store.save_capture(result.event)
            c.store.save_lineage(result)
        except Exception:
            log.warning("lineage of %s was not captured", func, exc_info=True)

    def onFailure(self, func, execution, error):  # noqa: N802
        if self.closed:
            return
        with contextlib.suppress(Exception):
            self.capture.failed(func, execution.logical().toString(), RuntimeError(error.toString()))

    class Java:
        implements = ["org.apache.spark.sql.util.QueryExecutionListener"]
