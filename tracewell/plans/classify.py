"""Classification of lineage facts: categories, roles and edge types. The resolver takes all of them from here."""

from __future__ import annotations


def write_mode(statement_type: str | None) -> str | None:
    t = (statement_type or "").upper()
    return next((mode for word, mode in (("OVERWRITE", "OVERWRITE"), ("INSERT", "INSERT"), ("CREATE", "CREATE"), ("WRITE", "WRITE")) if word in t), None)


def category(kind: str, inside: set[str] | frozenset[str] = frozenset(), pretty: str = "") -> str:
    """Category of an expression by its node kind, the kinds of all nodes in it, and its pretty name."""
    if kind in ("CaseWhen", "If"):
        return "case_when"
    if kind == "WindowExpression" or "WindowExpression" in inside:
        return "window"
    if kind == "AggregateExpression" or "AggregateExpression" in inside:
        return "aggregate"
    if kind in ("Cast", "AnsiCast", "TryCast"):
        return "cast"
    if kind in ("Coalesce", "Nvl"):
        return "coalesce"
    if "udf" in kind.lower() or "udf" in pretty:
        return "udf"
    return "projection" if kind in ("AttributeReference", "Alias") else "arithmetic"


def black_box(category_: str) -> bool:
    return category_ == "udf"


def instance_role(instance_type: str, use: str | None = None) -> str:
    """Of a column instance; use: in what its reader stands (group_key, aggregate_expression, or none for a plain value)."""
    if instance_type == "OUTPUT":
        return "output"
    return {None: "source", "group_key": "group_key", "aggregate_expression": "agg_input"}.get(use, "derived")


def predicate_role(node: str, over_aggregate: bool = False, with_window: bool = False) -> str:
    if node != "Filter":
        return "join_on" if node == "Join" else "other"
    return "having" if over_aggregate else "qualify" if with_window else "where"


def predicate_edge_role(role: str) -> str:
    return {"where": "filter_condition", "join_on": "join_condition"}.get(role, f"{role}_condition")


def join_role(join_type: str | None) -> str:
    return f"{(join_type or 'inner').lower().replace(' ', '')}_join"


def input_role(node: str, ordinal: int, inputs: int = 2) -> str:
    """Role of an operator's input: a join tells its sides apart."""
    if node == "Join":
        return ("left_input", "right_input")[ordinal] if ordinal < 2 <= inputs else f"join_input_{ordinal}"
    return {"Filter": "filter_input", "Aggregate": "aggregate_input"}.get(node, "input")


def flow_edge_type(source_kind: str, sink_kind: str) -> str:
    return f"{source_kind.upper()}_TO_{sink_kind.upper()}"
