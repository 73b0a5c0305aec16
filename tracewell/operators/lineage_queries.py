"""Lineage of statements over the driver tables; the SQL lists the facts that follow from each statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import graph
from tracewell.operators.registry import Registry, Tables
from tracewell.plans import classify
from tracewell.plans.lineage import column_lineage, lineage_of, parse
from tracewell.plans.schema import RESULT
from tracewell.sources.shared import own_folder

REGISTRY = Registry()
ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")

JOIN_FILTER = "SELECT c.c_mktsegment AS segment, sum(CASE WHEN o.o_orderstatus = 'F' THEN o.o_totalprice ELSE 0 END) AS paid, count(DISTINCT o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_acctbal > 0 GROUP BY c.c_mktsegment"
STATEMENTS = {
    "join_filter": JOIN_FILTER,
    "ctes": "WITH spend AS (SELECT o_custkey AS k, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), best AS (SELECT k, total FROM spend WHERE total > 10) SELECT x.k AS k, x.total + y.total AS both FROM best x JOIN spend y ON x.k = y.k",
    "union": "SELECT k, name FROM (SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, upper(s_name) FROM supplier) u",
    "window": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS rn, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS total FROM orders",
    "generator": "SELECT c_custkey, part FROM customer LATERAL VIEW explode(split(c_name, '#')) x AS part",
    "subqueries": "SELECT c_name, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS dearest FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey) AND c_nationkey IN (SELECT n_nationkey FROM nation)",
    "self_join": "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey",
    "star": "SELECT *, l_quantity * 2 AS twice FROM (SELECT l_orderkey, l_quantity FROM lineitem) x",
    "functions": "SELECT coalesce(nullif(c_mktsegment, 'X'), 'none') AS segment, CAST(c_acctbal AS BIGINT) AS whole, concat_ws('-', c_name, c_mktsegment) AS both, 1 AS one FROM customer",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 3",
    "set_operations": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "ordered": "SELECT DISTINCT upper(x) AS word FROM customer LATERAL VIEW explode(split(c_name, '#')) e AS x WHERE c_acctbal > 0 ORDER BY word LIMIT 5",
    "ranked": "SELECT sum(o_totalprice * 2) + 1 AS total, row_number() OVER (ORDER BY max(o_orderdate)) AS rn FROM orders GROUP BY o_custkey",
    "udf": "SELECT plain_udf(c_name) AS seen, c_custkey AS k FROM customer",
    "grouping_sets": "SELECT o_orderstatus, o_orderpriority, sum(o_totalprice) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
}
_SOURCES = {
    "join_filter": [("segment", "customer", "c_mktsegment"), ("paid", "orders", "o_orderstatus"), ("paid", "orders", "o_totalprice"), ("n", "orders", "o_orderkey")],
    "ctes": [("k", "orders", "o_custkey"), ("both", "orders", "o_totalprice")],
    "union": [("k", "customer", "c_custkey"), ("k", "supplier", "s_suppkey"), ("name", "customer", "c_name"), ("name", "supplier", "s_name")],
    "window": [("o_orderkey", "orders", "o_orderkey"), ("rn", "orders", "o_custkey"), ("rn", "orders", "o_orderdate"), ("total", "orders", "o_totalprice"), ("total", "orders", "o_custkey")],
    "generator": [("c_custkey", "customer", "c_custkey"), ("part", "customer", "c_name")],
    "self_join": [("left_name", "nation", "n_name"), ("right_name", "nation", "n_name")],
    "star": [("l_orderkey", "lineitem", "l_orderkey"), ("l_quantity", "lineitem", "l_quantity"), ("twice", "lineitem", "l_quantity")],
    "functions": [("segment", "customer", "c_mktsegment"), ("whole", "customer", "c_acctbal"), ("both", "customer", "c_name"), ("both", "customer", "c_mktsegment")],
    "having": [("o_custkey", "orders", "o_custkey")],
    "set_operations": [("k", "customer", "c_nationkey"), ("k", "supplier", "s_nationkey")],
    "grouping_sets": [("o_orderstatus", "orders", "o_orderstatus"), ("o_orderpriority", "orders", "o_orderpriority"), ("total", "orders", "o_totalprice")],
}


def views(t: Tables) -> SparkSession:
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        getattr(t, name).createOrReplaceTempView(name)
    return t.spark


def _values(rows: list[tuple], columns: str) -> str:
    shown = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) v({columns})"


def _add_sources(name: str, rows: list[tuple]) -> None:
    REGISTRY.add(f"l_columns_{name}", lambda t: column_lineage(views(t), STATEMENTS[name]), _values(rows, "output_column, source_table, source_column"))


for _name, _rows in _SOURCES.items():
    _add_sources(_name, _rows)


def _rows(t: Tables, statement: str, kind: str) -> DataFrame:
    spark = views(t)
    return graph.frames_of(spark, parse(spark, statement).rows, RESULT, [kind])[kind]


def _frames(t: Tables, statement: str, *kinds: str) -> list[DataFrame]:
    """Rows of several kinds of one reading, so that ids agree."""
    spark = views(t)
    frames = graph.frames_of(spark, parse(spark, statement).rows, RESULT, list(kinds))
    return [frames[k] for k in kinds]


def _fact(name: str, statement: str, kind: str, columns: list[str], expected: list[tuple]) -> None:
    REGISTRY.add(f"l_{name}", lambda t: _rows(t, STATEMENTS[statement], kind).select(*columns).distinct(), _values(expected, ", ".join(columns)))


_fact("input_tables", "join_filter", "table_ref", ["normalized_name", "usage"], [("customer", "input"), ("orders", "input")])
_fact("input_tables_of_ctes", "ctes", "table_ref", ["normalized_name", "usage"], [("orders", "input")])
_fact("input_tables_of_subqueries", "subqueries", "table_ref", ["normalized_name"], [("customer",), ("nation",), ("orders",), ("supplier",)])
_fact("warnings", "join_filter", "warning", ["code"], [("NO_OUTPUT_TABLE",)])
_fact("scopes", "ctes", "scope", ["scope_type", "scope_name"], [("ROOT_QUERY", "WITH_CTE"), ("CTE", "spend"), ("CTE", "best")])
_fact("union_scopes", "union", "scope", ["scope_type", "scope_name"], [("ROOT_QUERY", "PROJECT"), ("SUBQUERY_ALIAS", "u"), ("UNION_BRANCH", "branch_0"), ("UNION_BRANCH", "branch_1")])
_fact("relations", "join_filter", "relation_instance", ["source_table_id", "alias_name", "source_type"], [("table:customer", "c", "view"), ("table:orders", "o", "view")])
_fact("named_relations", "ctes", "relation_instance", ["instance_name", "source_type", "subquery_source"], [("orders", "view", False), ("spend", "named_plan", True), ("x", "named_plan", True), ("y", "named_plan", True)])
_fact("self_join_relations", "self_join", "relation_instance", ["source_table_id", "alias_name"], [("table:nation", "a"), ("table:nation", "b")])
_fact("operators", "join_filter", "operator_instance", ["operator_type", "operator_sub_type"], [("aggregate", None), ("filter", "where"), ("join", "left outer")])
_fact("predicates", "join_filter", "predicate", ["predicate_type", "predicate_role", "normalized_predicate"], [("JOIN", "join_on", "(c.c_custkey = o.o_custkey)"), ("FILTER", "where", "(c.c_acctbal > cast(0 as double))")])
_fact("having", "having", "predicate", ["predicate_type", "predicate_role"], [("FILTER", "having")])
_fact("expression_categories", "functions", "expression", ["expression_type", "category"], [("coalesce", "coalesce"), ("concat_ws", "arithmetic"), ("1", "arithmetic")][:2] + [("literal", "arithmetic")])
_fact("literals", "join_filter", "literal", ["literal_type", "literal_value"], [("string", "F"), ("int", "0")])


_fact("operators_of_other_nodes", "ordered", "operator_instance", ["operator_type", "operator_path"], [("globallimit", "0"), ("locallimit", "0.0"), ("sort", "0.0.0"), ("distinct", "0.0.0.0"), ("project", "0.0.0.0.0"), ("filter", "0.0.0.0.0.0"), ("generate", "0.0.0.0.0.0.0")])
_fact("columns_of_scopes", "ctes", "column", ["owner_type", "name"], [("TABLE", c) for c in ORDERS] + [("SCOPE", "k"), ("SCOPE", "total"), ("EXECUTION_OUTPUT", "k"), ("EXECUTION_OUTPUT", "both")])
_fact("output_instances", "ctes", "column_instance", ["instance_type", "column_name", "ordinal"], [("OUTPUT", "k", 0), ("OUTPUT", "total", 1), ("OUTPUT", "both", 1), ("EXPRESSION_INPUT", "o_custkey", None), ("EXPRESSION_INPUT", "o_totalprice", None), ("EXPRESSION_INPUT", "k", None), ("EXPRESSION_INPUT", "total", None), ("PREDICATE_INPUT", "k", None), ("PREDICATE_INPUT", "total", None)])
_fact("instance_roles", "ranked", "column_instance", ["instance_type", "column_name", "instance_role"], [("OUTPUT", "total", "output"), ("OUTPUT", "rn", "output"), ("EXPRESSION_INPUT", "o_custkey", "group_key"), ("EXPRESSION_INPUT", "o_totalprice", "agg_input"), ("EXPRESSION_INPUT", "o_orderdate", "agg_input")])


def _edges(name: str, statement: str, types: list[str], expected: list[tuple]) -> None:
    def build(t: Tables) -> DataFrame:
        return _rows(t, STATEMENTS[statement], "edge").filter(F.col("edge_type").isin(*types)).groupBy("edge_type", "role").agg(F.count("*").alias("n"))

    REGISTRY.add(f"l_{name}", build, _values(expected, "edge_type, role, n"))


_edges("join_edges", "join_filter", ["RELATION_INSTANCE_TO_RELATION_INSTANCE"], [("RELATION_INSTANCE_TO_RELATION_INSTANCE", "leftouter_join", 2)])
_edges("group_edges", "having", ["OPERATOR_TO_EXPRESSION"], [("OPERATOR_TO_EXPRESSION", "group_key", 1), ("OPERATOR_TO_EXPRESSION", "aggregate_expression", 2)])
_edges("window_context", "window", ["COLUMN_TO_EXPRESSION"], [("COLUMN_TO_EXPRESSION", "source_column", 1), ("COLUMN_TO_EXPRESSION", "window_partition", 2), ("COLUMN_TO_EXPRESSION", "window_order", 1)])


_edges("operator_edges", "join_filter", ["SCOPE_TO_OPERATOR_INSTANCE", "OPERATOR_TO_OPERATOR_INSTANCE"], [("SCOPE_TO_OPERATOR_INSTANCE", "contains_operator", 3), ("OPERATOR_TO_OPERATOR_INSTANCE", "child_operator", 2)])
_edges("operator_inputs", "join_filter", ["OPERATOR_TO_RELATION_INSTANCE"], [("OPERATOR_TO_RELATION_INSTANCE", r, n) for r, n in (("reads_relation", 2), ("left_input", 1), ("right_input", 1), ("filter_input", 2), ("aggregate_input", 2))])
_edges("operator_inputs_of_other_nodes", "ordered", ["OPERATOR_TO_RELATION_INSTANCE"], [("OPERATOR_TO_RELATION_INSTANCE", r, n) for r, n in (("reads_relation", 1), ("input", 6), ("filter_input", 1))])
_edges("predicate_edges", "having", ["OPERATOR_TO_PREDICATE"], [("OPERATOR_TO_PREDICATE", "having_condition", 1)])
_edges("flow_edge_types", "star", ["COLUMN_TO_COLUMN", "COLUMN_TO_EXPRESSION", "EXPRESSION_TO_COLUMN", "EXPRESSION_TO_EXPRESSION"], [("COLUMN_TO_COLUMN", "value", 4), ("COLUMN_TO_EXPRESSION", "source_column", 1), ("EXPRESSION_TO_COLUMN", "value", 1)])


@REGISTRY.query(_values([("customer.c_mktsegment", "segment")], "source, name"))
def l_direct_copies(t: Tables) -> DataFrame:
    """A column taken as it is has no expression."""
    rows = _rows(t, STATEMENTS["join_filter"], "edge").filter("edge_type = 'COLUMN_TO_COLUMN' and role = 'value'")
    return rows.select("source", F.element_at(F.split("target", "[.]"), -1).alias("name"))


@REGISTRY.query(_values([("explode(split(customer.c_name, '#', -1))", "upper(e.x)", "source_expression:0")], "inner_sql, outer_sql, role"))
def l_expression_chain(t: Tables) -> DataFrame:
    """An expression over what another made, not over a column."""
    e, x = _frames(t, STATEMENTS["ordered"], "edge", "expression")
    sql = lambda name: x.select(F.col("node_id").alias(name), F.col("display_sql").alias(f"{name}_sql"))
    e = e.filter("edge_type = 'EXPRESSION_TO_EXPRESSION'").select(F.col("source").alias("inner"), F.col("target").alias("outer"), "role")
    return e.join(sql("inner"), "inner").join(sql("outer"), "outer").select("inner_sql", "outer_sql", "role")


@REGISTRY.query(_values([("left_name", "a", "n_name"), ("right_name", "b", "n_name")], "output, relation, read"))
def l_instance_binding(t: Tables) -> DataFrame:
    """Two reads of one table stay apart: each output reads the instance of its own relation."""
    edge, inst, rel = _frames(t, STATEMENTS["self_join"], "edge", "column_instance", "relation_instance")
    e = edge.filter("edge_type = 'COLUMN_INSTANCE_TO_COLUMN_INSTANCE'")
    read = inst.select(F.col("node_id").alias("source"), F.col("column_name").alias("read"), "relation_instance_id")
    return e.join(read, "source").join(inst.select(F.col("node_id").alias("target"), F.col("column_name").alias("output")), "target").join(rel.select(F.col("node_id").alias("relation_instance_id"), F.col("alias_name").alias("relation")), "relation_instance_id").select("output", "relation", "read")


@REGISTRY.query(_values([("SELECT", "AGGREGATE", None), ("INSERT", "INSERT", "INSERT"), ("CREATE", "CREATE_TABLE_AS_SELECT", "CREATE"), ("VIEW", "CREATE_VIEW_COMMAND", "CREATE"), ("ORDER", "SORT", None)], "statement, statement_type, write_mode"))
def l_statement_types(t: Tables) -> DataFrame:
    spark = _written(t)
    texts = {"SELECT": JOIN_FILTER, "INSERT": "INSERT INTO lineage_target_segment SELECT 'a', 1D, 2L", "CREATE": "CREATE TABLE lineage_never_made AS SELECT n_name FROM nation", "VIEW": "CREATE VIEW lineage_never_made AS SELECT 1 AS one", "ORDER": "SELECT n_name FROM nation ORDER BY n_name"}
    types = {k: parse(spark, q).statement_type for k, q in texts.items()}
    return spark.createDataFrame([(k, v, classify.write_mode(v)) for k, v in types.items()], "statement string, statement_type string, write_mode string")


@REGISTRY.query(_values([("udf", True)], "category, black_box"))
def l_black_box(t: Tables) -> DataFrame:
    views(t).udf.register("plain_udf", lambda x: x, "string")
    return _rows(t, STATEMENTS["udf"], "expression").select("category", "black_box")


def _written(t: Tables) -> SparkSession:
    spark = views(t)
    if not spark.catalog.tableExists("default.lineage_target_segment"):
        spark.sql(f"CREATE TABLE default.lineage_target_segment (segment STRING, paid DOUBLE, n BIGINT) USING parquet LOCATION '{own_folder(spark, 'lineage_target_segment')}'")
    return spark


@REGISTRY.query(_values([("customer", "default.lineage_target_segment", "INSERT", "HIGH"), ("orders", "default.lineage_target_segment", "INSERT", "HIGH")], "source, target, write_mode, confidence"))
def l_table_edges(t: Tables) -> DataFrame:
    spark = _written(t)
    rows = parse(spark, f"INSERT OVERWRITE TABLE lineage_target_segment {JOIN_FILTER}").rows
    return graph.frames_of(spark, rows, RESULT, ["table_edge"])["table_edge"].select("source", "target", "write_mode", "confidence")


@REGISTRY.query(_values([("segment", "customer", "c_mktsegment"), ("paid", "orders", "o_orderstatus"), ("paid", "orders", "o_totalprice"), ("n", "orders", "o_orderkey")], "output_column, source_table, source_column"))
def l_insert_columns(t: Tables) -> DataFrame:
    return column_lineage(_written(t), f"INSERT OVERWRITE TABLE lineage_target_segment {JOIN_FILTER}")


@REGISTRY.query(_values([("k", "predicate", "(spend.total > cast(10 as double))"), ("both", "predicate", "(spend.total > cast(10 as double))"), ("k", "predicate", "(x.k = y.k)"), ("both", "predicate", "(x.k = y.k)")], "column_name, kind, fact"))
def l_derived_predicates(t: Tables) -> DataFrame:
    """Predicates that shape the outputs, those inside CTEs among them."""
    f = lineage_of(views(t), STATEMENTS["ctes"], event_id="derived")
    root = f["scope"].filter("scope_type = 'ROOT_QUERY'").select(F.col("node_id").alias("scope_id"))
    outputs = f["column_instance"].filter("instance_type = 'OUTPUT'").join(root, "scope_id").select(F.col("node_id").alias("target"), "column_name")
    e = f["edge"].filter("edge_type = 'PREDICATE_TO_DERIVED_COLUMN_INSTANCE'").join(outputs, "target")
    return e.join(f["predicate"].select(F.col("node_id").alias("source"), F.col("normalized_predicate").alias("fact")), "source").select("column_name", F.lit("predicate").alias("kind"), "fact").distinct()


@REGISTRY.query(_values([("orders", "o_orderstatus"), ("orders", "o_totalprice")], "source_table, source_column"))
def l_dataframe_columns(t: Tables) -> DataFrame:
    """A DataFrame without SQL: files are tables by the last part of their path."""
    df = t.orders.filter("o_totalprice > 5").select(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("paid"))
    return column_lineage(t.spark, df).select("source_table", "source_column")


_GONE = "WITH a AS (SELECT g.k, sum(g.v) AS s FROM gone_facts g WHERE g.day = '1' GROUP BY g.k) SELECT a.k AS k, a.s * 2 AS twice, n.n_name AS nation, CASE WHEN o.x > 0 THEN o.y ELSE 0 END AS y FROM a JOIN nation n ON a.k = n.n_nationkey LEFT JOIN gone_others o ON o.k = a.k"


@REGISTRY.query(_values([("k", "gone_facts.k"), ("twice", "gone_facts.v"), ("nation", "nation.n_name"), ("y", "gone_others.x"), ("y", "gone_others.y")], "output_column, source"))
def l_columns_by_name(t: Tables) -> DataFrame:
    """A statement over missing tables, read by qualifiers and names."""
    spark = views(t)
    return spark.createDataFrame(parse(spark, _GONE, by_name=True).column_sources, "output_column string, source string")


@REGISTRY.query(_values([("NO_OUTPUT_TABLE",), ("NOT_ANALYZED",)], "code"))
def l_warnings_by_name(t: Tables) -> DataFrame:
    spark = views(t)
    return graph.frames_of(spark, parse(spark, _GONE, by_name=True).rows, RESULT, ["warning"])["warning"].select("code")
