"""Scripts, stores, bundles, explanations, capture, and the command line."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tracewell import cli
from tracewell.operators.explain import Explainer, FieldNotFound, alias_hints, table_neighbours
from tracewell.plans.lineage import parse
from tracewell.sources import bundle, script
from tracewell.sources.store import MemoryStore, ParquetStore, kept_frames, reconciled, run_in_parallel, store_of
from tracewell.streaming import capture, ingest

NOW = lambda: datetime.datetime(2026, 3, 20)
SCRIPT = """-- daily job
set dayCut='2026-03-19';
DROP TABLE IF EXISTS nothing;
INSERT OVERWRITE TABLE seg_daily /*+ COALESCE(1) */
SELECT c.c_mktsegment AS segment, sum(CASE WHEN o.o_orderstatus = 'F; -- x' THEN o.o_totalprice ELSE 0 END) AS paid, '${daycut}' AS day
FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_acctbal > 7 GROUP BY c.c_mktsegment;
"""


@pytest.fixture(scope="module")
def ready(spark, data):
    for t in ("customer", "orders"):
        spark.read.parquet(f"{data}/{t}.parquet").createOrReplaceTempView(t)
    spark.sql("CREATE TABLE IF NOT EXISTS seg_daily (segment STRING, paid DOUBLE, day STRING) USING parquet")
    return spark


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "jobs" / "sub").mkdir(parents=True)
    (tmp_path / "jobs" / "sub" / "a.sql").write_text(SCRIPT)
    return tmp_path


# --- scripts


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("a;b", ["a", "b"]), ("a ';' b; c", ["a ';' b", "c"]), ('x "a;b" `c;d`;', ['x "a;b" `c;d`']), ("a -- b; c\nd;", ["a \nd"]), ("a /* ; */ b", ["a  b"]), ("/*+ HINT(1) */ a", ["a"]), ("a '--' b", ["a '--' b"]),
        (" ; ;", []), ("a 'it\\'s; ok' b; c", ["a 'it\\'s; ok' b", "c"]), ("a -- end", ["a"]), ("a /* open", ["a"]),
    ],
)
def test_statements_are_split(text, parts):
    assert script.split_statements(text) == parts


def test_variables_and_placeholders():
    assert script.set_variable("SET A = '2023-01-01'") == ("a", "20230101")
    assert script.set_variable("select 1") is None
    v = script.default_variables(NOW())
    assert (v["today"], v["outfilesuffix"], v["start_date"]) == ("20260320", "2026-03-19", "20230101")
    assert script.replace_placeholders("${Today} ${unknown} ${x_date} ${mySuffix}", v) == "20260320 0 20260320 20260320"


@pytest.mark.parametrize(("text", "is_one"), [("INSERT INTO t SELECT 1", True), ("create table t as select 1", True), ("create table t (a int)", False), ("with a as (select 1) insert into t select * from a", True), ("with a as (select 1) select * from a", False), ("drop table t", False), ("add jar x", False), ("msck repair table t", False), ("analyze table t compute statistics", False), ("create temporary function f as 'x'", False)])
def test_lineage_statements(text, is_one):
    assert script.is_lineage_statement(text) == is_one


def test_scripts_import_and_report_failures(ready, folder):
    (folder / "jobs" / "b.sql").write_text("INSERT INTO nowhere SELECT 1;")
    store = MemoryStore(ready)
    with pytest.raises(script.ScriptError, match="statement 1"):
        script.ScriptImporter(ready, NOW).import_path(str(folder / "jobs"), store)
    done = script.ScriptImporter(ready, NOW, on_error="continue").import_path(str(folder / "jobs"), store)
    assert [len(d.results) for d in done] == [0, 1] and len(done[0].failures) == 1
    assert store.list_results()[0].event["event_id"].startswith("offline:") and len(store.list_events()) == 2
    assert list(store.latest_by_output()) == ["default.seg_daily"]
    literals = {x["literal_value"] for x in store.list_results()[0].rows["literal"]}
    assert {"F; -- x", "20260319"} <= literals


# --- stores


def explained(tables) -> dict:
    return Explainer(tables).explain("default.seg_daily", "PAID")


def test_explanation(ready, folder):
    store = MemoryStore(ready)
    script.ScriptImporter(ready, NOW).import_path(str(folder), store)
    tables = store.tables()
    found = explained(tables)
    assert found["target"]["column"] == "paid" and found["valueColumns"] == ["orders.o_orderstatus", "orders.o_totalprice"] and set(found["upstreamColumns"]) > set(found["valueColumns"])
    assert any(e["category"] == "aggregate" and "F; -- x" in e["literals"] for e in found["expressions"])
    assert {(p["kind"]) for p in found["predicates"]} >= {"join_on"} and set(found["relations"]) >= {"table:orders"}
    e = Explainer(tables)
    assert "EXPR" in e.tree("default.seg_daily", "paid") and "upstream columns" in e.report("default.seg_daily", "paid")
    assert json.loads(e.report("default.seg_daily", "paid", "json"))["target"]["table"] == "default.seg_daily"
    for table, column in (("nowhere", "x"), ("default.seg_daily", "nothing")):
        with pytest.raises(FieldNotFound):
            e.explain(table, column)
    assert alias_hints("select a.b, a.b, c.`d`") == [("a", "b"), ("c", "d")]


def test_parquet_store_merges_and_clears(ready, tmp_path):
    store = ParquetStore(ready, f"{tmp_path}/store")
    assert store.table("table_node").count() == 0 and store.events().count() == 0
    result = parse(ready, "INSERT OVERWRITE TABLE seg_daily SELECT c_mktsegment, c_acctbal, 'x' FROM customer", when_ms=1000)
    for _ in range(2):
        store.save_capture(result.event)
        store.save_lineage(result)
    memory = kept_frames(ready, result)
    for name in ("table_node", "column_node", "column_instance_node", "latest_column_instance_flows_to_column_instance", "table_has_column"):
        assert store.table(name).count() == memory[name].distinct().count() > 0
    assert store.events().count() == 1
    store.compact("column_node")
    n = store.table("column_node").count()
    store.remove("column_node", store.table("column_node").select("vid").limit(1))
    assert store.table("column_node").count() == n - 1
    store.views("kept_")
    assert ready.sql("SELECT * FROM kept_table_node").count() == 2
    store.clear()
    assert store.table("table_node").count() == 0


def test_later_runs_win(ready, tmp_path):
    store = ParquetStore(ready, f"{tmp_path}/store")
    for k in (1, 2):
        store.save_lineage(parse(ready, "INSERT OVERWRITE TABLE seg_daily SELECT c_mktsegment, c_acctbal, 'x' FROM customer", event_id="same", when_ms=1000 * k))
    assert {r["last_seen_time"] for r in store.table("latest_column_instance_flows_to_column_instance").collect()} == {2}


def test_schema_differences(ready):
    shape = bundle.EDGE["table_has_column"]
    df = ready.createDataFrame([("a", 1)], "src string, rank int")
    assert reconciled(df, shape).collect()[0].asDict() == {"src": "a", "dst": None, "rank": 1}
    with pytest.raises(TypeError):
        reconciled(df.withColumn("src", F.lit(2.5)), shape)


def test_store_factory(ready, tmp_path):
    assert isinstance(store_of(ready), MemoryStore)
    ready.conf.set("spark.tracewell.storage.type", "parquet")
    ready.conf.set("spark.tracewell.storage.path", str(tmp_path))
    assert isinstance(store_of(ready), ParquetStore)
    ready.conf.unset("spark.tracewell.storage.type")


def test_bundle_round_trip(ready, folder):
    made = script.ScriptImporter(ready, NOW).export_bundle(str(folder / "jobs"), f"{folder}/bundle")
    assert made["scripts"] == made["results"] == 1 and made["vertices"] > 5 and made["edges"] > 5
    store = ParquetStore(ready, f"{folder}/store")
    lines: list[str] = []
    done = bundle.import_bundle(ready, f"{folder}/bundle", store, report=lines.append)
    assert done["tables"] == 20 and len(lines) == 20
    memory = MemoryStore(ready)
    script.ScriptImporter(ready, NOW).import_path(str(folder / "jobs"), memory)
    for name, df in memory.tables().items():
        time_free = [c for c in df.columns if c not in ("last_seen_time", "capture_time")]
        assert sorted(map(str, df.select(time_free).collect())) == sorted(map(str, store.table(name).select(time_free).collect())), name
    assert "CREATE TAG IF NOT EXISTS `column_node`" in bundle.schema_text()
    with pytest.raises(ValueError):
        bundle.checked(["src", "rank"], "table_has_column")
    only = bundle.import_bundle(ready, f"{folder}/bundle", ParquetStore(ready, f"{folder}/other"), vertices_only=True)
    assert only["tables"] == 7 and only["edges"] == 0


def test_parallel_runs_stop_at_a_failure(ready):
    seen: list[str] = []
    assert run_in_parallel(ready, [("small", 1, "s"), ("large", 9, "l")], 1, lambda s, p: seen.append(p), report=lambda line: None) == 2
    assert seen == ["l", "s"]
    with pytest.raises(ZeroDivisionError):
        run_in_parallel(ready, [("a", 1, 0)], 2, lambda s, p: 1 / p, report=lambda line: None)


# --- capture


def test_capture_takes_context_and_never_fails_the_job(ready):
    store = MemoryStore(ready)
    c = capture.Capture(ready, store)
    ready.sparkContext.setLocalProperty("spark.tracewell.task.owner", "someone")
    with capture.task(task_id="job-1", run_id="r1"):
        c.sql("INSERT OVERWRITE TABLE seg_daily SELECT c_mktsegment, c_acctbal, 'x' FROM customer")
        c.write(ready.table("orders").select("o_orderkey"), lambda df: df.count())
        with pytest.raises(Exception):
            c.sql("SELECT * FROM nowhere_at_all")
    ready.sparkContext.setLocalProperty("spark.tracewell.task.owner", None)
    assert [e["status"] for e in store.list_events()].count("FAILURE") == 1
    task = store.list_results()[0].event["task"]
    assert (task["task_id"], task["run_id"], task["owner"]) == ("job-1", "r1", "someone")
    assert ready.table("seg_daily").count() == ready.table("customer").count()


def test_listener_captures_writes(ready):
    import time

    store = MemoryStore(ready)
    listener = capture.Listener(capture.Capture(ready, store)).register()
    try:
        ready.sql("INSERT OVERWRITE TABLE seg_daily SELECT c_mktsegment, c_acctbal, 'y' FROM customer")
        end = time.time() + 20
        while "default.seg_daily" not in store.latest_by_output() and time.time() < end:
            time.sleep(0.2)
    finally:
        listener.unregister()
    assert "default.seg_daily" in store.latest_by_output()


def test_streams_append_exactly_once(ready, tmp_path):
    store = ParquetStore(ready, f"{tmp_path}/store")
    rows = ready.createDataFrame([("table:a", None, None, "a", "table", "a")], bundle.VERTEX["table_node"])
    rows.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = ready.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        ingest.ingest(stream, store, "table_node", f"{tmp_path}/checkpoint").awaitTermination()
    assert [r["vid"] for r in store.table("table_node").collect()] == ["table:a"]


def test_table_neighbours(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c")], "source string, target string")
    assert {r["table"] for r in table_neighbours(e, "c").collect()} == {"b", "x"}
    assert {r["table"] for r in table_neighbours(e, "c", hops=None).collect()} == {"a", "b", "x"}
    assert {r["table"] for r in table_neighbours(e, "a", "downstream", None).collect()} == {"b", "c"}


def test_command_line(ready, folder, capsys):
    store = f"{folder}/store"
    run = lambda *a: (cli.main(["--store", store, *a], ready), capsys.readouterr().out)[1]
    assert json.loads(run("import", str(folder / "jobs")))["results"] == 1
    assert "aggregate" in run("explain", "default.seg_daily", "paid")
    assert "table:orders" in run("sql", "SELECT vid FROM table_node")
    assert json.loads(run("export-bundle", str(folder / "jobs"), f"{folder}/out"))["scripts"] == 1
    assert '"tables": 20' in run("import-bundle", f"{folder}/out")
    run("clear")
    assert ParquetStore(ready, store).table("table_node").count() == 0


def test_appends_beside_a_compaction_stay(ready, tmp_path, monkeypatch):
    store = ParquetStore(ready, f"{tmp_path}/store")
    row = lambda x: ready.createDataFrame([(f"table:{x}", x)], "vid string, name string")
    store.append({"table_node": row("a")})
    store.append({"table_node": row("b")})
    rows = store._rows

    def meanwhile(name, batches):
        out = rows(name, batches)
        monkeypatch.setattr(store, "_rows", rows)
        store.append({"table_node": row("c")})
        return out

    monkeypatch.setattr(store, "_rows", meanwhile)
    store.compact("table_node")
    assert sorted(r["name"] for r in store.table("table_node").collect()) == ["a", "b", "c"]
    assert len(store.batches("table_node")) == 2


def test_a_merged_batch_counts_once_it_is_announced(ready, tmp_path):
    store = ParquetStore(ready, f"{tmp_path}/store")
    store.append({"table_node": ready.createDataFrame([("table:a", "a")], "vid string, name string")})
    store._rows("table_node", store.batches("table_node")).write.parquet(f"{store.path}/table_node/merged-x")  # a run that died here
    assert store.batches("table_node") and all(b.startswith("batch-") for b in store.batches("table_node"))


def test_a_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from tracewell.sources.shared import shared_dir

    none = SimpleNamespace(get=lambda *a: None)
    spark = SimpleNamespace(conf=none, sparkContext=SimpleNamespace(getConf=lambda: none, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(spark)
