"""Graph, identity and classification operators on graphs that come from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import graph
from tracewell.operators.registry import Registry, Tables
from tracewell.plans import classify, ids
from tracewell.plans.schema import CONVERGED

REGISTRY = Registry()
query = REGISTRY.query

# The place hierarchy: customers and suppliers flow into nations, nations into regions.
_HIERARCHY = "edges AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'customer' AS edge_type FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey, 'supplier' FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'nation' FROM nation)"
_REGIONS = "seeds AS (SELECT 'r' || r_regionkey AS seed FROM region)"
_WALK = "walk(seed, node, depth) AS (SELECT seed, seed, 0 FROM seeds UNION SELECT w.seed, e.src, w.depth + 1 FROM walk w JOIN edges e ON e.dst = w.node {})"


def hierarchy(t: Tables) -> DataFrame:
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    parts = [t.customer.select(key("c", "c_custkey").alias("src"), key("n", "c_nationkey").alias("dst"), F.lit("customer").alias("edge_type")), t.supplier.select(key("s", "s_suppkey"), key("n", "s_nationkey"), F.lit("supplier")), t.nation.select(key("n", "n_nationkey"), key("r", "n_regionkey"), F.lit("nation"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


def regions(t: Tables) -> DataFrame:
    return t.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("seed"))


def turns(t: Tables) -> DataFrame:
    """Each conversation as a chain: a turn flows into the next."""
    key = lambda shift: F.concat_ws(":", F.col("conv_id"), F.col("turn") + shift)
    return t.conversations.filter("conv_id is not null and turn is not null").select(key(0).alias("src"), key(1).alias("dst")).distinct()


_TURNS = "edges AS (SELECT DISTINCT conv_id || ':' || turn AS src, conv_id || ':' || (turn + 1) AS dst FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)"


@query(f"WITH RECURSIVE {_HIERARCHY}, {_REGIONS}, {_WALK.format('')} SELECT seed, node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY seed, node")
def g_closure(t: Tables) -> DataFrame:
    return graph.closure(hierarchy(t), regions(t))


@query(f"WITH RECURSIVE {_HIERARCHY}, {_REGIONS}, {_WALK.format('')} SELECT DISTINCT seed, node AS leaf FROM walk WHERE node NOT IN (SELECT dst FROM edges)")
def g_leaf_sources(t: Tables) -> DataFrame:
    return graph.leaf_sources(hierarchy(t), regions(t))


@query(f"WITH RECURSIVE {_TURNS}, seeds AS (SELECT dst AS seed FROM edges WHERE dst LIKE '%:3'), {_WALK.format('WHERE w.depth < 2')} SELECT seed, node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY seed, node")
def g_backtrace_to_depth(t: Tables) -> DataFrame:
    e = turns(t)
    return graph.closure(e, e.filter("dst like '%:3'").select(F.col("dst").alias("seed")), max_depth=2)


@query(f"WITH RECURSIVE {_TURNS}, seeds AS (SELECT src AS seed FROM edges WHERE src LIKE '%:0'), walk(seed, node, depth) AS (SELECT seed, seed, 0 FROM seeds UNION SELECT w.seed, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node) SELECT seed, node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY seed, node")
def g_downstream(t: Tables) -> DataFrame:
    e = turns(t)
    return graph.closure(e, e.filter("src like '%:0'").select(F.col("src").alias("seed")), reverse=False)


@query(f"WITH RECURSIVE {_HIERARCHY}, {_REGIONS}, walk(seed, node, path) AS (SELECT seed, seed, [seed] FROM seeds UNION ALL SELECT w.seed, e.src, list_append(w.path, e.src) FROM walk w JOIN edges e ON e.dst = w.node) SELECT seed, array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS hops FROM walk WHERE node NOT IN (SELECT dst FROM edges)")
def g_paths(t: Tables) -> DataFrame:
    return graph.paths(hierarchy(t), regions(t)).filter("whole").select("seed", F.array_join("path", ">").alias("path"), "hops")


@query(f"WITH {_HIERARCHY} SELECT edge_type, count(*) AS n FROM edges GROUP BY edge_type")
def g_edge_histogram(t: Tables) -> DataFrame:
    return graph.histogram(hierarchy(t))


_FEED = "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts {0}, event_id {0}) AS rn FROM events) WHERE rn = 1"


def _merged(t: Tables, keep: str) -> DataFrame:
    e = t.events.select("user_id", "event_type", "event_id", "value", "ts")
    return graph.merge_latest(e.filter("event_id % 3 = 0"), e.filter("event_id % 3 <> 0"), ["user_id", "event_type"], ["ts", "event_id"], keep).drop("ts")


@query(_FEED.format("DESC"))
def g_merge_keep_last(t: Tables) -> DataFrame:
    return _merged(t, "last")


@query(_FEED.format("ASC"))
def g_merge_keep_first(t: Tables) -> DataFrame:
    return _merged(t, "first")


@query("SELECT 'u' || user_id AS target, arg_max('e' || event_id, (epoch_us(ts) // 1000000, 'e' || event_id)) AS event_id, CAST(max(epoch_us(ts) // 1000000) AS BIGINT) AS seen FROM events GROUP BY user_id")
def g_anchor_event(t: Tables) -> DataFrame:
    dst = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    e = t.events.select(dst.alias("dst"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("last_event_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint").alias("last_seen_time") if dict(t.events.dtypes)["ts"] == "timestamp" else F.floor(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts)") / 1_000_000).cast("bigint").alias("last_seen_time"))
    return graph.anchor_event(e, e.select(F.col("dst").alias("target")))


_TYPES = [*CONVERGED, "SCOPE_TO_SCOPE", "COLUMN_TO_COLUMN", "OPERATOR_TO_EXPRESSION"]
_TYPE_SQL = "CASE CAST(user_id % " + str(len(_TYPES)) + " AS INTEGER) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_TYPES)) + " END"
_NAME_SQL = "CASE edge_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CONVERGED.items()) + " END"
_RANK_SQL = "CAST(('0x' || substr(sha1(CASE WHEN edge_name LIKE 'latest_%' THEN edge_name || '|' || role ELSE edge_name || '|' || role || '|' || event_id END), 1, 15)) AS BIGINT)"


@query(f"WITH e AS (SELECT {_TYPE_SQL} AS edge_type, 'a' || user_id AS source, 'b' || event_id % 7 AS target, event_type AS role, CAST(event_id AS VARCHAR) AS event_id FROM events), c AS (SELECT *, {_NAME_SQL} AS edge_name FROM e) SELECT edge_name, source AS src, target AS dst, {_RANK_SQL} AS rank, event_id AS last_event_id, 't1' AS last_task_id, CAST(NULL AS VARCHAR) AS last_run_id, CAST(5 AS BIGINT) AS last_seen_time, role FROM c WHERE edge_name IS NOT NULL")
def g_converge(t: Tables) -> DataFrame:
    e = t.events.select(F.expr(_TYPE_SQL.replace("VARCHAR", "STRING")).alias("edge_type"), F.expr("'a' || user_id").alias("source"), F.expr("'b' || event_id % 7").alias("target"), F.col("event_type").alias("role"), F.col("event_id").cast("string").alias("event_id"))
    return graph.converge(e, 5, "t1")


@query("SELECT 'table:' || r_name AS src, r_name || '.' || n_name AS dst, CAST(0 AS BIGINT) AS rank FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 3")
def g_table_has_column(t: Tables) -> DataFrame:
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    columns = n.select(F.col("r_name").alias("owner_id"), F.when(F.col("r_regionkey") == 4, "SCOPE").otherwise("TABLE").alias("owner_type"), F.concat_ws(".", "r_name", "n_name").alias("node_id"))
    return graph.table_has_column(columns, t.region.filter("r_regionkey < 3").select(F.col("r_name").alias("normalized_name")))


@query("SELECT DISTINCT least(a.n_nationkey, b.n_nationkey) AS a, greatest(a.n_nationkey, b.n_nationkey) AS b, 'inner_join' AS role FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey WHERE a.n_nationkey < 12 AND b.n_nationkey < 12")
def g_joined_pairs(t: Tables) -> DataFrame:
    a, b = t.nation.alias("a"), t.nation.alias("b")
    joins = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") != F.col("b.n_nationkey"))).select(F.col("a.n_nationkey").alias("src"), F.col("b.n_nationkey").alias("dst"), F.lit("inner_join").alias("role"))
    return graph.joined_pairs(joins, t.nation.filter("n_nationkey < 12").select(F.col("n_nationkey").alias("relation")))


_SCOPES = "scopes AS (SELECT 'r' || r_regionkey AS node_id, CAST(NULL AS VARCHAR) AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"
_UNDER = "under(ancestor, scope) AS (SELECT node_id, node_id FROM scopes UNION SELECT s.parent, u.scope FROM under u JOIN scopes s ON s.node_id = u.ancestor WHERE s.parent IS NOT NULL)"


def _scopes(t: Tables) -> DataFrame:
    return t.region.select(F.expr("'r' || r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_scope_id")).union(t.nation.selectExpr("'n' || n_nationkey", "'r' || n_regionkey")).union(t.supplier.selectExpr("'s' || s_suppkey", "'n' || s_nationkey"))


@query(f"WITH RECURSIVE {_SCOPES}, {_UNDER} SELECT ancestor, scope FROM under")
def g_scope_closure(t: Tables) -> DataFrame:
    return graph.scope_closure(_scopes(t))


@query(f"WITH RECURSIVE {_SCOPES}, {_UNDER}, made AS (SELECT 'out:' || s_suppkey AS source, 'col' || s_suppkey % 4 AS c, 's' || s_suppkey AS scope FROM supplier), reads AS (SELECT 'in:' || n_nationkey AS target, 'col' || n_nationkey % 4 AS c, 'n' || n_nationkey AS scope FROM nation) SELECT DISTINCT source, target, 'COLUMN_INSTANCE_TO_COLUMN_INSTANCE' AS edge_type, 'query_block_output_reference' AS role FROM made JOIN under ON under.scope = made.scope JOIN reads ON reads.scope = under.ancestor AND reads.c = made.c")
def g_producer_links(t: Tables) -> DataFrame:
    made = t.supplier.selectExpr("'out:' || s_suppkey AS node_id", "'col' || s_suppkey % 4 AS column_id", "'s' || s_suppkey AS scope_id", "'OUTPUT' AS instance_type")
    read = t.nation.selectExpr("'in:' || n_nationkey AS node_id", "'col' || n_nationkey % 4 AS column_id", "'n' || n_nationkey AS scope_id", "'EXPRESSION_INPUT' AS instance_type")
    return graph.producer_links(made.union(read), _scopes(t))


@query("WITH i AS (SELECT o_orderkey % 5 AS event_id, 'in' || o_custkey % 4 AS source FROM orders UNION SELECT o_orderkey % 5, 'same' FROM orders), o AS (SELECT DISTINCT o_orderkey % 5 AS event_id, CASE WHEN o_orderkey % 5 = 0 THEN 'same' ELSE 'out' || o_orderkey % 5 END AS target FROM orders) SELECT DISTINCT event_id, source, target FROM i JOIN o USING (event_id) WHERE source <> target")
def g_table_edges(t: Tables) -> DataFrame:
    i = t.orders.selectExpr("o_orderkey % 5 AS event_id", "'in' || o_custkey % 4 AS normalized_name").union(t.orders.selectExpr("o_orderkey % 5", "'same'"))
    o = t.orders.selectExpr("o_orderkey % 5 AS event_id", "CASE WHEN o_orderkey % 5 = 0 THEN 'same' ELSE 'out' || o_orderkey % 5 END AS normalized_name")
    return graph.table_edges(i, o)


@query("SELECT event_type AS output, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY event_type")
def g_latest_result_per_output(t: Tables) -> DataFrame:
    e = t.events.select(F.col("event_type").alias("output"), "event_id", "ts")
    return graph.merge_latest(e.limit(0), e, ["output"], ["ts", "event_id"]).drop("ts")


@query("SELECT c_custkey, 'expr:' || sha1(c_name || '|' || lower(c_mktsegment)) AS id, CAST(('0x' || substr(sha1(c_name || '|' || c_mktsegment), 1, 15)) AS BIGINT) AS rank FROM customer")
def i_identities(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", ids.made_column("expr", F.col("c_name"), F.lower("c_mktsegment")).alias("id"), ids.rank_column(F.col("c_name"), F.col("c_mktsegment")).alias("rank"))


@query("SELECT p_partkey, lower(trim(regexp_replace('  Sum( ' || p_name || '   +  1)', '\\s+', ' ', 'g'))) AS expression, lower(replace(trim(' `' || p_brand || '`.`X` '), '`', '')) AS identifier FROM part")
def i_normal_texts(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", ids.normal_expression_column(F.concat(F.lit("  Sum( "), "p_name", F.lit("   +  1)"))).alias("expression"), ids.normal_identifier_column(F.concat(F.lit(" `"), "p_brand", F.lit("`.`X` "))).alias("identifier"))


_STATEMENTS = "(VALUES ('INSERT'), ('InsertOverwrite'), ('CREATE_TABLE_AS_SELECT'), ('APPEND_DATA_WRITE'), ('PROJECT')) v(s)"


@query(f"SELECT s, CASE WHEN upper(s) LIKE '%OVERWRITE%' THEN 'OVERWRITE' WHEN upper(s) LIKE '%INSERT%' THEN 'INSERT' WHEN upper(s) LIKE '%CREATE%' THEN 'CREATE' WHEN upper(s) LIKE '%WRITE%' THEN 'WRITE' END AS mode FROM {_STATEMENTS}")
def k_write_mode(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(s, classify.write_mode(s)) for s in ("INSERT", "InsertOverwrite", "CREATE_TABLE_AS_SELECT", "APPEND_DATA_WRITE", "PROJECT")], "s string, mode string")


_KINDS = [("CaseWhen", "case_when"), ("If", "case_when"), ("AggregateExpression", "aggregate"), ("WindowExpression", "window"), ("Cast", "cast"), ("Coalesce", "coalesce"), ("Nvl", "coalesce"), ("PythonUDF", "udf"), ("Alias", "projection"), ("AttributeReference", "projection"), ("Add", "arithmetic")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{c}', {str(c == 'udf').lower()})" for k, c in _KINDS) + ") v(kind, category, black_box)")
def k_category(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(k, c := classify.category(k), classify.black_box(c)) for k, _ in _KINDS], "kind string, category string, black_box boolean")


@query("SELECT * FROM (VALUES ('OUTPUT', NULL, 'output'), ('EXPRESSION_INPUT', NULL, 'source'), ('EXPRESSION_INPUT', 'group_key', 'group_key'), ('EXPRESSION_INPUT', 'aggregate_expression', 'agg_input'), ('PREDICATE_INPUT', 'other', 'derived')) v(kind, operator, role)")
def k_instance_role(t: Tables) -> DataFrame:
    rows = [("OUTPUT", None), ("EXPRESSION_INPUT", None), ("EXPRESSION_INPUT", "group_key"), ("EXPRESSION_INPUT", "aggregate_expression"), ("PREDICATE_INPUT", "other")]
    return t.spark.createDataFrame([(*r, classify.instance_role(*r)) for r in rows], "kind string, operator string, role string")


@query("SELECT * FROM (VALUES ('Join', false, false, 'join_on', 'join_condition'), ('Filter', false, false, 'where', 'filter_condition'), ('Filter', true, false, 'having', 'having_condition'), ('Filter', false, true, 'qualify', 'qualify_condition'), ('Sort', false, false, 'other', 'other_condition')) v(node, agg, win, role, edge_role)")
def k_predicate_role(t: Tables) -> DataFrame:
    rows = [("Join", False, False), ("Filter", False, False), ("Filter", True, False), ("Filter", False, True), ("Sort", False, False)]
    return t.spark.createDataFrame([(*r, role := classify.predicate_role(*r), classify.predicate_edge_role(role)) for r in rows], "node string, agg boolean, win boolean, role string, edge_role string")


@query("SELECT * FROM (VALUES ('INNER', 0, 'inner_join', 'left_input'), ('LEFT OUTER', 1, 'leftouter_join', 'right_input'), ('LEFT ANTI', 2, 'leftanti_join', 'join_input_2')) v(kind, ordinal, role, input)")
def k_join_role(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(j, k, classify.join_role(j), classify.input_role("Join", k)) for j, k in (("INNER", 0), ("LEFT OUTER", 1), ("LEFT ANTI", 2))], "kind string, ordinal int, role string, input string")


@query("SELECT a AS source, b AS sink, upper(a) || '_TO_' || upper(b) AS edge_type FROM (VALUES ('column'), ('expression')) x(a) CROSS JOIN (VALUES ('column'), ('expression')) y(b)")
def k_flow_edge_type(t: Tables) -> DataFrame:
    kinds = ("column", "expression")
    return t.spark.createDataFrame([(a, b, classify.flow_edge_type(a, b)) for a in kinds for b in kinds], "source string, sink string, edge_type string")
