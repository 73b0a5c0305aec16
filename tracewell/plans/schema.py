"""Row shapes of the lineage graph, and of the tables that are kept of it."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType())}


def _type(text: str) -> T.DataType:
    if text.startswith("struct<"):
        return T.StructType([T.StructField(n, _type(t)) for n, t in (f.split(":") for f in text[7:-1].split(","))])
    return _TYPES[text]


def _struct(ddl: str) -> T.StructType:
    """From `name type, name type`; needs no session, unlike Spark's own parser."""
    return T.StructType([T.StructField(n, _type(t)) for n, t in (f.split(" ") for f in ddl.split(", "))])


#: Rows that a statement yields.
RESULT = {
    "table_ref": _struct("catalog string, database string, name string, source_type string, normalized_name string, usage string"),
    "table_edge": _struct("source string, target string, task_id string, run_id string, event_id string, write_mode string, capture_time bigint, confidence string"),
    "column": _struct("node_id string, owner_id string, owner_type string, name string, data_type string, qualifier array<string>"),
    "column_instance": _struct("node_id string, column_id string, column_name string, scope_id string, relation_instance_id string, instance_type string, data_type string, ordinal int, instance_role string, output boolean, query_block_id string, plan_node_id string"),
    "expression": _struct("node_id string, expression_type string, expression_sql string, normalized_expression string, category string, display_sql string, black_box boolean, query_block_id string, plan_node_id string"),
    "literal": _struct("node_id string, literal_type string, literal_value string, normalized_value string"),
    "predicate": _struct("node_id string, predicate_type string, predicate_sql string, normalized_predicate string, scope_id string, plan_node_name string, predicate_role string, display_sql string, query_block_id string, plan_node_id string"),
    "relation_instance": _struct("node_id string, instance_name string, scope_id string, source_table_id string, source_type string, alias_name string, plan_node_name string, query_block_id string, plan_node_id string, join_type string, null_supply_side boolean, subquery_source boolean"),
    "scope": _struct("node_id string, scope_name string, scope_type string, parent_scope_id string, plan_node_name string"),
    "operator_instance": _struct("node_id string, scope_id string, operator_type string, operator_sub_type string, operator_path string, parent_operator_id string, plan_node_name string"),
    "edge": _struct("source string, target string, edge_type string, role string, event_id string"),
    "warning": _struct("code string, message string"),
}

EVENT = _struct(
    "event_id string, status string, task struct<task_id:string,task_name:string,run_id:string,biz_date:string,owner:string,script_path:string>, "
    "app struct<app_id:string,app_name:string,user:string,master:string>, func_name string, duration_ns bigint, capture_time_ms bigint, error_message string, "
    "plans struct<logical:string,analyzed:string,optimized:string,physical:string>"
)

_SEEN = "last_event_id string, last_task_id string, last_run_id string, last_seen_time bigint, role string"
#: Kept vertices: `vid` and properties. Times are epoch seconds.
VERTEX = {
    "table_node": _struct("vid string, catalog string, database string, name string, source_type string, normalized_name string"),
    "column_node": _struct("vid string, owner_id string, owner_type string, name string, data_type string, qualifier string"),
    "expression_node": _struct("vid string, expression_type string, expression_sql string, normalized_expression string, category string, display_sql string, black_box boolean, query_block_id string, plan_node_id string"),
    "literal_node": _struct("vid string, literal_type string, literal_value string, normalized_value string"),
    "column_instance_node": _struct("vid string, column_id string, column_name string, scope_id string, relation_instance_id string, instance_type string, data_type string, ordinal int, instance_role string, output boolean, query_block_id string, plan_node_id string"),
    "relation_instance_node": _struct("vid string, instance_name string, scope_id string, source_table_id string, source_type string, alias_name string, plan_node_name string, query_block_id string, plan_node_id string, join_type string, null_supply_side boolean, subquery_source boolean"),
    "predicate_node": _struct("vid string, predicate_type string, predicate_sql string, normalized_predicate string, scope_id string, plan_node_name string, predicate_role string, display_sql string, query_block_id string, plan_node_id string"),
}
#: Which rows of a statement become which kept vertices.
VERTEX_OF = {"column": "column_node", "expression": "expression_node", "literal": "literal_node", "column_instance": "column_instance_node", "relation_instance": "relation_instance_node", "predicate": "predicate_node"}

#: Internal edge type -> kept edge; all other types are dropped.
CONVERGED = {
    "COLUMN_TO_COLUMN_INSTANCE": "column_has_instance",
    "RELATION_INSTANCE_TO_RELATION_INSTANCE": "latest_relation_instance_joins_relation_instance",
    "LITERAL_TO_EXPRESSION": "latest_literal_flows_to_expression",
    "COLUMN_INSTANCE_TO_EXPRESSION": "latest_column_instance_flows_to_expression",
    "EXPRESSION_TO_EXPRESSION": "latest_expression_flows_to_expression",
    "EXPRESSION_TO_COLUMN_INSTANCE": "latest_expression_flows_to_column_instance",
    "COLUMN_INSTANCE_TO_COLUMN_INSTANCE": "latest_column_instance_flows_to_column_instance",
    "COLUMN_INSTANCE_TO_PREDICATE": "latest_column_instance_flows_to_predicate",
    "RELATION_INSTANCE_TO_PREDICATE": "latest_relation_instance_flows_to_predicate",
    "RELATION_INSTANCE_TO_DERIVED_COLUMN_INSTANCE": "latest_relation_instance_flows_to_column_instance",
    "PREDICATE_TO_DERIVED_COLUMN_INSTANCE": "latest_predicate_flows_to_column_instance",
    "LITERAL_TO_PREDICATE": "latest_literal_flows_to_predicate",
}
EDGE = {
    "table_has_column": _struct("src string, dst string, rank bigint"),
    "column_has_instance": _struct("src string, dst string, rank bigint, event_id string, capture_time bigint, role string"),
    **{name: _struct(f"src string, dst string, rank bigint, {_SEEN}") for name in CONVERGED.values() if name.startswith("latest_")},
}
