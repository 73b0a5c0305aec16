"""Lineage of statements: scenarios with known facts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracewell.operators.graph import closure, leaf_sources, paths
from tracewell.plans.lineage import TaskContext, column_lineage, lineage_of, parse, runtime_event_id

#: Targets of chained jobs over the driver's tables.
TARGETS = {
    "order_facts": "order_key BIGINT, cust_key BIGINT, segment STRING, revenue DOUBLE, n_lines BIGINT, size STRING",
    "return_facts": "order_key BIGINT, supp_key BIGINT, refund DOUBLE, segment STRING",
    "segment_totals": "segment STRING, n_orders BIGINT, revenue DOUBLE, refund DOUBLE",
    "nation_returns": "nation STRING, region STRING, refund DOUBLE, any_large INT",
    "board": "segment STRING, net DOUBLE, refund_share DOUBLE, worst_nation DOUBLE",
}
JOBS = {
    "order_facts": """SELECT o.o_orderkey, o.o_custkey, c.c_mktsegment, coalesce(l.revenue, 0), l.n, CASE WHEN o.o_totalprice >= 1000 THEN 'large' ELSE 'small' END
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS age FROM orders WHERE o_orderstatus <> 'P') o
        LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS revenue, count(*) AS n FROM lineitem WHERE l_quantity > 0 GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey
        LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.age <= 3""",
    "return_facts": "SELECT l.l_orderkey, l.l_suppkey, l.l_extendedprice * (1 - l.l_discount), f.segment FROM lineitem l JOIN order_facts f ON l.l_orderkey = f.order_key WHERE l.l_returnflag = 'R'",
    "segment_totals": "SELECT f.segment, count(DISTINCT f.order_key), sum(CASE WHEN f.size = 'large' THEN f.revenue END), max(r.refund) FROM order_facts f LEFT JOIN return_facts r ON f.order_key = r.order_key GROUP BY f.segment",
    "nation_returns": "SELECT n.n_name, min(g.r_name), sum(r.refund), max(if(r.refund > 500, 1, 0)) FROM return_facts r JOIN supplier s ON r.supp_key = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region g ON n.n_regionkey = g.r_regionkey GROUP BY n.n_name",
    "board": "SELECT t.segment, t.revenue - coalesce(t.refund, 0), round(t.refund / nullif(t.revenue, 0), 4), w.top FROM segment_totals t CROSS JOIN (SELECT max(refund) AS top FROM nation_returns WHERE any_large = 1) w",
}
#: What each output is made of, written down column by column.
MADE_OF = {
    "order_facts": {"order_key": "orders.o_orderkey", "cust_key": "orders.o_custkey", "segment": "customer.c_mktsegment", "revenue": "lineitem.l_extendedprice", "size": "orders.o_totalprice"},
    "return_facts": {"order_key": "lineitem.l_orderkey", "supp_key": "lineitem.l_suppkey", "refund": "lineitem.l_extendedprice lineitem.l_discount", "segment": "order_facts.segment"},
    "segment_totals": {"segment": "order_facts.segment", "n_orders": "order_facts.order_key", "revenue": "order_facts.size order_facts.revenue", "refund": "return_facts.refund"},
    "nation_returns": {"nation": "nation.n_name", "region": "region.r_name", "refund": "return_facts.refund", "any_large": "return_facts.refund"},
    "board": {"segment": "segment_totals.segment", "net": "segment_totals.revenue segment_totals.refund", "refund_share": "segment_totals.revenue segment_totals.refund", "worst_nation": "nation_returns.refund"},
}
READS = {"order_facts": "orders lineitem customer", "return_facts": "lineitem order_facts", "segment_totals": "order_facts return_facts", "nation_returns": "return_facts supplier nation region", "board": "segment_totals nation_returns"}


@pytest.fixture(scope="module")
def chain(spark, data, tmp_path_factory):
    """Views of the driver's tables, the targets as tables, and the lineage of every job."""
    for name in ("customer", "orders", "lineitem", "supplier", "nation", "region"):
        spark.read.parquet(f"{data}/{name}.parquet").createOrReplaceTempView(name)
    folder = tmp_path_factory.mktemp("targets")
    for name, columns in TARGETS.items():
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet LOCATION '{folder}/{name}'")
    yield {name: parse(spark, f"INSERT OVERWRITE TABLE {name} {job}") for name, job in JOBS.items()}
    for name in TARGETS:
        spark.sql(f"DROP TABLE {name}")


def full(names: str) -> set[str]:
    """Targets are tables of the default database, all others are views."""
    return {f"default.{n}" if n.split(".")[0] in TARGETS else n for n in names.split()}


def sources(result) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for column, source in result.column_sources:
        out.setdefault(column, set()).add(source)
    return out


@pytest.mark.parametrize("target", JOBS)
def test_jobs_have_their_tables(chain, target):
    rows = chain[target].rows
    by_usage = {u: {t["normalized_name"] for t in rows["table_ref"] if t["usage"] == u} for u in ("input", "output")}
    assert by_usage == {"input": full(READS[target]), "output": {f"default.{target}"}}
    assert {(e["source"], e["target"], e["write_mode"]) for e in rows["table_edge"]} == {(s, f"default.{target}", "INSERT") for s in full(READS[target])}
    assert rows["warning"] == []


@pytest.mark.parametrize("target", JOBS)
def test_jobs_have_their_columns(chain, target):
    assert {c: s for c, s in sources(chain[target]).items() if c in MADE_OF[target]} == {c: full(s) for c, s in MADE_OF[target].items()}


def test_tables_of_the_chain_lead_back_to_the_first_ones(spark, chain):
    edges = spark.createDataFrame([(e["source"], e["target"]) for r in chain.values() for e in r.rows["table_edge"]], "src string, dst string")
    leaves = leaf_sources(edges, spark.createDataFrame([("default.board",)], "seed string"))
    assert {r["leaf"] for r in leaves.collect()} == {"orders", "lineitem", "customer", "supplier", "nation", "region"}


def test_join_and_filter(spark, chain):
    rows = chain["order_facts"].rows
    kinds = {(o["operator_type"], o["operator_sub_type"]) for o in rows["operator_instance"]}
    assert kinds >= {("join", "left outer"), ("filter", "where"), ("aggregate", None), ("window", None)}
    assert sorted(p["predicate_type"] for p in rows["predicate"]) == ["FILTER"] * 3 + ["JOIN"] * 2
    roles = {e["role"] for e in rows["edge"]}
    assert {"left_input", "right_input", "join_condition", "filter_condition", "leftouter_join", "group_key", "aggregate_expression"} <= roles


def test_named_plans(spark, chain):
    sql = """WITH rate AS (SELECT n_regionkey AS r, max(n_nationkey) AS top FROM nation WHERE n_name > 'A' GROUP BY n_regionkey), spent AS (SELECT s_nationkey, sum(s_acctbal) AS total FROM supplier GROUP BY s_nationkey),
      shares AS (SELECT p.s_nationkey AS k, p.total / q.top AS share FROM spent p LEFT JOIN rate q ON p.s_nationkey = q.r) SELECT k, share FROM shares"""
    result = parse(spark, sql)
    assert {s["scope_name"] for s in result.rows["scope"] if s["scope_type"] == "CTE"} == {"rate", "spent", "shares"}
    assert {"p", "q", "shares"} <= {r["instance_name"] for r in result.rows["relation_instance"] if r["source_type"] == "named_plan"}
    assert {("(p.s_nationkey = q.r)", "join_on"), ("(nation.n_name > 'a')", "where")} <= {(p["normalized_predicate"], p["predicate_role"]) for p in result.rows["predicate"]}
    assert sources(result) == {"k": {"supplier.s_nationkey"}, "share": {"supplier.s_acctbal", "nation.n_nationkey"}}


def test_a_view_is_made_of_its_query(spark, chain):
    assert parse(spark, "CREATE VIEW never_made AS SELECT n_name FROM nation").statement_type == "CREATE_VIEW_COMMAND"


def test_producers_and_derived_facts(spark, data):
    for t in ("customer", "orders"):
        spark.read.parquet(f"{data}/{t}.parquet").createOrReplaceTempView(t)
    f = lineage_of(spark, "WITH a AS (SELECT o_custkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 5) SELECT a.p AS p FROM a JOIN customer c ON a.k = c.c_custkey", TaskContext(task_id="t", run_id=" "))
    edges = f["edge"]
    assert edges.filter("role = 'query_block_output_reference'").count() > 0
    derived = edges.filter("edge_type like '%DERIVED%'").join(f["column_instance"].select(F.col("node_id").alias("target"), "column_name", "output"), "target")
    assert derived.filter("column_name = 'p' and edge_type like 'PREDICATE%'").count() > 0 and derived.filter("edge_type like 'RELATION%'").count() > 0
    assert derived.filter("not output").count() == 0


def test_dataframes_and_udfs(spark, data):
    from pyspark.sql.functions import udf

    double = udf(lambda x: x, "double")
    df = spark.read.parquet(f"{data}/orders.parquet").select(double("o_totalprice").alias("p"), F.lit(1).alias("one"))
    result = parse(spark, df)
    assert sources(result) == {"p": {"orders.o_totalprice"}}
    assert [(e["category"], e["black_box"]) for e in result.rows["expression"] if "o_totalprice" in e["normalized_expression"]] == [("udf", True)]
    assert [w["code"] for w in result.rows["warning"]] == ["NO_OUTPUT_TABLE"]


def test_wide_chain_keeps_apart_equal_names(spark, data):
    spark.read.parquet(f"{data}/nation.parquet").createOrReplaceTempView("nation")
    sql = "SELECT a.x AS one, b.x AS two FROM (SELECT n_nationkey AS k, n_name AS x FROM nation) a JOIN (SELECT n_nationkey AS k, n_regionkey AS x FROM nation) b ON a.k = b.k"
    got = {tuple(r) for r in column_lineage(spark, sql).collect()}
    assert got == {("one", "nation", "n_name"), ("two", "nation", "n_regionkey")}


def test_event_ids():
    c = TaskContext(task_id="t")
    assert runtime_event_id(c, "SUCCESS", "f", "plan", "x") == runtime_event_id(c, "SUCCESS", "f", "plan", "y") != runtime_event_id(c, "FAILURE", "f", "plan", "y")
    assert TaskContext(task_id=" ", owner="o").merged(TaskContext(task_id="b", owner="p")) == TaskContext(task_id="b", owner="o")


def test_graph_walks_are_safe_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("z", "a"), ("b", "b")], "src string, dst string")
    s = spark.createDataFrame([("c",)], "seed string")
    assert {(r["node"], r["depth"]) for r in closure(e, s).collect()} == {("c", 0), ("b", 1), ("a", 2), ("z", 3)}
    assert [tuple(r) for r in leaf_sources(e, s).collect()] == [("c", "z")]
    assert [r["path"] for r in paths(e, s, limit=5).collect()] == [["c", "b", "a", "z"]]


def test_paths_say_where_they_are_cut(spark):
    e = spark.createDataFrame([(f"n{k + 1}", f"n{k}") for k in range(6)] + [("m", "n0")], "src string, dst string")
    s = spark.createDataFrame([("n0",)], "seed string")
    assert {(tuple(r["path"]), r["whole"]) for r in paths(e, s, max_depth=2).collect()} == {(("n0", "m"), True), (("n0", "n1", "n2"), False)}
    assert [r["path"] for r in paths(e, s, limit=1).collect()] == [["n0", "m"]]
    assert {(r["hops"], r["whole"]) for r in paths(e, s, max_depth=6).collect()} == {(1, True), (6, True)}


@pytest.mark.parametrize("target", JOBS)
def test_names_alone_give_the_same_columns(spark, chain, target):
    from tracewell.plans.lineage import parse_plan
    from tracewell.plans.names import Names
    from tracewell.plans.reader import Reader

    reader = Reader(spark)
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(f"INSERT OVERWRITE TABLE {target} {JOBS[target]}")
    found = parse_plan(spark, reader, parsed, parsed, TaskContext(), None, "sql", plan=Names(reader).read(parsed))
    bare = lambda s: {x.removeprefix("default.") for x in s}
    assert {c: bare(s) for c, s in sources(found).items() if c in MADE_OF[target]} == {c: set(s.split()) for c, s in MADE_OF[target].items()}
    assert bare(t["normalized_name"] for t in found.rows["table_ref"] if t["usage"] == "input") == set(READS[target].split())


def test_missing_tables_are_read_by_name(spark, chain):
    sql = "WITH a AS (SELECT g.k, sum(g.v) AS s FROM gone.facts g WHERE g.day = '1' GROUP BY g.k) INSERT INTO gone.target SELECT a.k, a.s * 2, n.n_name, CASE WHEN other.x > 0 THEN y ELSE 0 END FROM a JOIN nation n ON a.k = n.n_nationkey LEFT JOIN other ON other.k = a.k"
    with pytest.raises(Exception, match="gone"):
        parse(spark, sql)
    result = parse(spark, sql, by_name=True)
    refs = {(t["normalized_name"], t["usage"]) for t in result.rows["table_ref"]}
    assert refs == {("gone.facts", "input"), ("nation", "input"), ("other", "input"), ("gone.target", "output")}
    made = [s for _, s in sorted(sources(result).items())]
    assert {frozenset(s) for s in made} >= {frozenset({"gone.facts.k"}), frozenset({"gone.facts.v"}), frozenset({"nation.n_name"})}
    assert any("other.x" in s for s in made) and [w["code"] for w in result.rows["warning"]] == ["NOT_ANALYZED"]
    assert {p["predicate_role"] for p in result.rows["predicate"]} == {"where", "join_on"}


def test_a_name_that_fits_two_tables_stays_unbound(spark, chain):
    result = parse(spark, "SELECT x, a.y FROM gone_a a JOIN gone_b b ON a.k = b.k", by_name=True)
    assert {c: s for c, s in sources(result).items()} == {"y": {"gone_a.y"}}
