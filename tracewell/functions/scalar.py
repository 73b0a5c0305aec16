"""Scalar functions: one query each over a driver table, with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators.registry import Registry

REGISTRY = Registry()

#: name -> (table, key, Spark expression, DuckDB expression)
#: Spark signs years beyond 9999 and pads negative ones to four digits; strftime does neither.
_EXPRESSIONS = {
    "nvl": ("customer", "c_custkey", "nvl(nullif(c_mktsegment, 'BUILDING'), 'none')", "coalesce(nullif(c_mktsegment, 'BUILDING'), 'none')"),
    "coalesce": ("customer", "c_custkey", "coalesce(nullif(c_mktsegment, 'BUILDING'), nullif(c_name, ''), 'none')", "coalesce(nullif(c_mktsegment, 'BUILDING'), nullif(c_name, ''), 'none')"),
    "case_searched": ("orders", "o_orderkey", "CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END", None),
    "case_simple": ("orders", "o_orderkey", "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END", None),
    "if": ("orders", "o_orderkey", "if(o_orderstatus = 'F', 'done', 'open')", "CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END"),
    "cast_decimal": ("part", "p_partkey", "CAST(CAST(p_size AS DECIMAL(18, 2)) * 2 AS STRING)", "CAST(CAST(CAST(p_size AS DECIMAL(18, 2)) * 2 AS DECIMAL(18, 2)) AS VARCHAR)"),
    "cast_bigint": ("events", "event_id", "CAST(get_json_object(props, '$.k') AS BIGINT)", "CAST(json_extract_string(props, '$.k') AS BIGINT)"),
    "substr": ("customer", "c_custkey", "substr(c_name, 2, 5)", None),
    "concat_ws": ("customer", "c_custkey", "concat_ws('-', c_name, nullif(c_mktsegment, 'BUILDING'), 'x')", None),
    "lower": ("customer", "c_custkey", "lower(c_mktsegment)", None),
    "split": ("part", "p_partkey", "array_join(split(p_type, ' '), '|')", "array_to_string(string_split(p_type, ' '), '|')"),
    "regexp_extract": ("part", "p_partkey", "regexp_extract(p_name, '([0-9]+)', 1)", "regexp_extract(p_name, '([0-9]+)', 1)"),
    "get_json_object": ("events", "event_id", "get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"),
    "to_date": ("orders", "o_orderkey", "to_date(o_orderdate)", "CAST(o_orderdate AS DATE)"),
    "date": ("events", "event_id", "date(ts)", "CAST(ts AS DATE)"),
    "date_format": ("orders", "o_orderkey", "date_format(o_orderdate, 'yyyy/MM/dd')", "strftime(o_orderdate, '%Y/%m/%d')"),
    "from_unixtime": ("orders", "o_orderkey", "regexp_replace(from_unixtime(o_orderkey * 86400), '^[+]|(?<=^-)0+', '')", "strftime(make_timestamp(o_orderkey * 86400 * 1000000), '%Y-%m-%d %H:%M:%S')"),
    "last_day": ("orders", "o_orderkey", "last_day(o_orderdate)", "last_day(o_orderdate)"),
    "day": ("orders", "o_orderkey", "day(o_orderdate)", "CAST(day(o_orderdate) AS INTEGER)"),
    "date_add": ("orders", "o_orderkey", "date_add(to_date(o_orderdate), 10)", "CAST(CAST(o_orderdate AS DATE) + INTERVAL 10 DAY AS DATE)"),
    "datediff": ("lineitem", "l_orderkey, l_linenumber", "datediff(l_shipdate, DATE'1995-01-01')", "CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INTEGER)"),
    "least": ("part", "p_partkey", "least(p_size, 20, nullif(p_size, 5))", "least(p_size, 20, nullif(p_size, 5))"),
    "floor_divide": ("part", "p_partkey", "floor(p_size / 7)", "CAST(floor(p_size / 7) AS BIGINT)"),
    "round": ("part", "p_partkey", "round(p_size / 8, 2)", "round(p_size / 8, 2)"),
    "array_explode": ("region", "r_regionkey", "explode(array(r_regionkey, r_regionkey + 10))", "unnest([r_regionkey, r_regionkey + 10])"),
    "string_literal": ("region", "r_regionkey", "concat(r_name, \"'s\")", "concat(r_name, '''s')"),
    "quoted_identifier": ("region", "r_regionkey", "`地区`", '"地区"'),
}
_RENAMED = {"quoted_identifier": ("r_name", "地区")}


def _add(name: str, table: str, key: str, spark: str, duck: str | None) -> None:
    keys = key.split(", ")
    old, new = _RENAMED.get(name, (None, None))
    source = f'(SELECT *, {old} AS "{new}" FROM {table})' if old else table

    def build(t):
        frame = getattr(t, table)
        return (frame.withColumn(new, F.col(old)) if old else frame).select(*keys, F.expr(spark).alias("value"))

    REGISTRY.add(f"f_{name}", build, f"SELECT {key}, {duck or spark} AS value FROM {source}")


for _name, _spec in _EXPRESSIONS.items():
    _add(_name, *_spec)

REGISTRY.add("f_random", lambda t: t.region.select("r_regionkey", F.rand(7).between(0, 1).alias("value")), "SELECT r_regionkey, true AS value FROM region")
REGISTRY.add("f_current_date", lambda t: t.region.select("r_regionkey", (F.datediff(F.current_date(), F.current_date()) == 0).alias("value")), "SELECT r_regionkey, true AS value FROM region")
