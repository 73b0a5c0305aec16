"""Queries over the kept graph: what explains a field, which tables lie around one, what a script holds."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.explain import Explainer, table_neighbours
from tracewell.operators.lineage_queries import JOIN_FILTER, _values, _written
from tracewell.operators.registry import Registry, Tables
from tracewell.plans.lineage import parse
from tracewell.sources.script import ScriptImporter, split_statements
from tracewell.sources.store import MemoryStore

REGISTRY = Registry()
query = REGISTRY.query
TARGET = "default.lineage_target_segment"

_FACTS = [
    ("value_column", "orders.o_orderstatus"), ("value_column", "orders.o_totalprice"), ("upstream_column", "customer.c_custkey"), ("upstream_column", "orders.o_custkey"), ("upstream_column", "orders.o_orderstatus"), ("upstream_column", "orders.o_totalprice"),
    ("expression", "aggregate"), ("source", "o(orders).o_orderstatus"), ("source", "o(orders).o_totalprice"), ("literal", "F"), ("literal", "0"), ("join", "c leftouter_join o"), ("relation", "table:customer"), ("relation", "table:orders"),
    ("predicate", "where (c.c_acctbal > CAST(0 AS DOUBLE))"), ("predicate", "join_on (c.c_custkey = o.o_custkey)"),
]


def _kept(t: Tables) -> MemoryStore:
    spark = _written(t)
    store = MemoryStore(spark)
    result = parse(spark, f"INSERT OVERWRITE TABLE lineage_target_segment {JOIN_FILTER}", event_id="kept", when_ms=5000)
    store.save_batch([result.event], [result])
    return store


@query(_values(_FACTS, "kind, fact"))
def q_explain_field(t: Tables) -> DataFrame:
    found = Explainer(_kept(t).tables()).explain(TARGET, "paid")
    rows = [("value_column", c) for c in found["valueColumns"]] + [("upstream_column", c) for c in found["upstreamColumns"]] + [("expression", e["category"]) for e in found["expressions"]]
    rows += [(kind, x) for e in found["expressions"] for kind, key in (("source", "source_columns"), ("literal", "literals")) for x in e[key]]
    rows += [("join", j) for j in found["joins"]] + [("relation", r) for r in found["relations"]] + [("predicate", f"{p['kind']} {p['sql']}") for p in found["predicates"]]
    return t.spark.createDataFrame(sorted(set(rows)), "kind string, fact string")


@query(_values([("table_node", 3), ("relation_instance_node", 2), ("predicate_node", 2), ("literal_node", 2)], "name, n"))
def g_kept_vertices(t: Tables) -> DataFrame:
    tables = _kept(t).tables()
    counts = [tables[n].agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("table_node", "relation_instance_node", "predicate_node", "literal_node")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


_TABLE_EDGES = "e AS (SELECT DISTINCT 'part' || (l_partkey % 7) AS source, 'supp' || (l_suppkey % 5) AS target FROM lineitem UNION SELECT DISTINCT 'supp' || (l_suppkey % 5), 'flag' || l_returnflag FROM lineitem)"


def _table_edges(t: Tables) -> DataFrame:
    a = t.lineitem.selectExpr("'part' || (l_partkey % 7) AS source", "'supp' || (l_suppkey % 5) AS target")
    return a.union(t.lineitem.selectExpr("'supp' || (l_suppkey % 5)", "'flag' || l_returnflag")).distinct()


@query(f"WITH {_TABLE_EDGES} SELECT source AS \"table\", CAST(1 AS INTEGER) AS hops FROM e WHERE target = 'flagA'")
def q_one_hop_upstream(t: Tables) -> DataFrame:
    return table_neighbours(_table_edges(t), "flagA")


@query(f"WITH RECURSIVE {_TABLE_EDGES}, w(node, hops) AS (SELECT 'flagA', 0 UNION SELECT e.source, w.hops + 1 FROM w JOIN e ON e.target = w.node) SELECT node AS \"table\", CAST(min(hops) AS INTEGER) AS hops FROM w WHERE hops > 0 GROUP BY node")
def q_all_upstream(t: Tables) -> DataFrame:
    return table_neighbours(_table_edges(t), "flagA", hops=None)


@query(f"WITH RECURSIVE {_TABLE_EDGES}, w(node, hops) AS (SELECT 'part3', 0 UNION SELECT e.target, w.hops + 1 FROM w JOIN e ON e.source = w.node) SELECT node AS \"table\", CAST(min(hops) AS INTEGER) AS hops FROM w WHERE hops > 0 GROUP BY node")
def q_all_downstream(t: Tables) -> DataFrame:
    return table_neighbours(_table_edges(t), "part3", "downstream", None)


SCRIPT = "SET day='2026-03-19'; -- set ; up\nDROP TABLE x;\nINSERT INTO t SELECT ';', \"a--b\", '${DAY}', '${end_date}' /* ; */ FROM s;\nWITH a AS (SELECT 1) SELECT * FROM a"


@query(_values([(1, "SET day='2026-03-19'"), (2, "DROP TABLE x"), (3, "INSERT INTO t SELECT ';', \"a--b\", '${DAY}', '${end_date}'  FROM s"), (4, "WITH a AS (SELECT 1) SELECT * FROM a")], "number, statement"))
def i_script_statements(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(list(enumerate(split_statements(SCRIPT), 1)), "number int, statement string")


@query(_values([(3, "INSERT INTO t SELECT ';', \"a--b\", '20260319', '20260320'  FROM s")], "number, statement"))
def i_script_lineage_statements(t: Tables) -> DataFrame:
    importer = ScriptImporter(t.spark, lambda: datetime.datetime(2026, 3, 20))
    return t.spark.createDataFrame(importer.statements(SCRIPT), "number int, statement string")
