"""The relational surface: scans, filters, joins, aggregates, windows, set operations, writes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.operators.registry import Registry, Tables
from tracewell.sources.shared import own_folder

REGISTRY = Registry()
query = REGISTRY.query


def cents(name: str) -> Column:
    """Money as whole cents: sums are exact, whatever their order."""
    return F.round(F.col(name) * 100).cast("bigint")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def r01_scan(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT CAST(id AS INTEGER) AS id, status, CAST(amount AS INTEGER) AS amount FROM (VALUES (1001, 'PAID', 120), (1002, 'NEW', 80), (1003, NULL, 45)) v(id, status, amount)")
def r02_values(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT * FROM VALUES (1001, 'PAID', 120), (1002, 'NEW', 80), (1003, NULL, 45) AS v(id, status, amount)")


@query("SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) - CAST(round(l_tax * 100) AS BIGINT) AS net, l_quantity * 2 AS double_quantity FROM lineitem")
def r03_projection(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", (cents("l_extendedprice") - cents("l_tax")).alias("net"), (F.col("l_quantity") * 2).alias("double_quantity"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity >= 10 AND l_quantity < 30 AND l_returnflag <> 'R') OR l_linestatus = 'F'")
def r04_filter(t: Tables) -> DataFrame:
    return t.lineitem.filter("(l_quantity >= 10 AND l_quantity < 30 AND l_returnflag <> 'R') OR l_linestatus = 'F'").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
def r05_in_list(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_orderstatus").isin("F", "P") & ~F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).select("o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'")
def r06_between(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_shipdate BETWEEN TIMESTAMP_NTZ'1995-01-01' AND TIMESTAMP_NTZ'1996-12-31'").select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%E%' AND p_name NOT LIKE '%1'")
def r07_like(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_type").like("%E%") & ~F.col("p_name").like("%1")).select("p_partkey", "p_name")


@query("SELECT c_custkey, o_orderkey IS NULL AS without_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 WHERE o_orderkey IS NULL OR o_orderstatus IS NOT NULL")
def r08_is_null(t: Tables) -> DataFrame:
    joined = t.customer.join(t.orders.filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.filter(F.col("o_orderkey").isNull() | F.col("o_orderstatus").isNotNull()).select("c_custkey", F.col("o_orderkey").isNull().alias("without_order"))


@query("SELECT o_orderkey, l_linenumber, o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def r09_inner_join(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "o_custkey")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND c_nationkey = o_orderkey % 25 AND o_orderstatus = 'O'")
def r10_left_join_many_keys(t: Tables) -> DataFrame:
    on = (F.col("c_custkey") == F.col("o_custkey")) & (F.col("c_nationkey") == F.col("o_orderkey") % 25) & (F.col("o_orderstatus") == "O")
    return t.customer.join(t.orders, on, "left").select("c_custkey", "o_orderkey")


@query("SELECT o_orderkey, n_nationkey FROM orders LEFT JOIN nation ON month(o_orderdate) = n_nationkey + 1")
def r11_join_on_expressions(t: Tables) -> DataFrame:
    return t.orders.join(t.nation, F.month("o_orderdate") == F.col("n_nationkey") + 1, "left").select("o_orderkey", "n_nationkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def r12_cross_join(t: Tables) -> DataFrame:
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


_ANTI = "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL"


@query(_ANTI)
def r13_anti_join(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(_ANTI)
def r13_anti_join_idiom(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").filter("o_orderkey IS NULL").select("c_custkey")


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 30 DAY")
def r14_range_filter_after_join(t: Tables) -> DataFrame:
    joined = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.filter("l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 30 DAY").select("o_orderkey", "l_linenumber")


@query("WITH m AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders) SELECT a.o_custkey, count(DISTINCT a.o_orderkey) AS n_f, count(DISTINCT b.o_orderkey) AS n_o FROM m a LEFT JOIN m b ON a.o_custkey = b.o_custkey AND b.o_orderstatus = 'O' WHERE a.o_orderstatus = 'F' GROUP BY a.o_custkey")
def r15_cte_read_twice(t: Tables) -> DataFrame:
    m = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus")
    a, b = m.filter("o_orderstatus = 'F'").alias("a"), m.filter("o_orderstatus = 'O'").alias("b")
    joined = a.join(b, F.col("a.o_custkey") == F.col("b.o_custkey"), "left")
    return joined.groupBy(F.col("a.o_custkey").alias("o_custkey")).agg(F.countDistinct("a.o_orderkey").alias("n_f"), F.countDistinct("b.o_orderkey").alias("n_o"))


@query("SELECT o_orderkey, o_orderpriority, c_name, c_mktsegment, n_name, r_name, n_lines, s_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, min(l_suppkey) AS s FROM lineitem GROUP BY l_orderkey) x ON o_orderkey = l_orderkey LEFT JOIN supplier ON s = s_suppkey")
def r15_star_of_left_joins(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.min("l_suppkey").alias("s"))
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    joined = joined.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(t.supplier, F.col("s") == F.col("s_suppkey"), "left")
    return joined.select("o_orderkey", "o_orderpriority", "c_name", "c_mktsegment", "n_name", "r_name", "n_lines", "s_name")


@query("SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c RIGHT JOIN orders ON c_custkey = o_custkey")
def r16_right_join(t: Tables) -> DataFrame:
    return t.customer.filter("c_acctbal > 5000").join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "right").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 3")
def r16_full_join(t: Tables) -> DataFrame:
    return t.customer.join(t.supplier, F.col("c_custkey") == F.col("s_suppkey") * 3, "full").select("c_custkey", "s_suppkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def r16_semi_join(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT r.r_name, n.n_name FROM region r JOIN nation n ON n.n_nationkey < r.r_regionkey * 5")
def r16_theta_join(t: Tables) -> DataFrame:
    return t.region.join(t.nation, F.col("n_nationkey") < F.col("r_regionkey") * 5).select("r_name", "n_name")


@query("SELECT o_custkey, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS total FROM orders GROUP BY o_custkey")
def r17_group_by(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(cents("o_totalprice")).alias("total"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def r18_group_by_expression(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("orders_by_month")
    return t.spark.sql("SELECT date_format(o_orderdate, 'yyyy-MM') AS month, count(*) AS n FROM orders_by_month GROUP BY 1")


@query("SELECT count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END)::BIGINT AS f_total, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS n_open, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)::BIGINT AS n_urgent FROM orders")
def r19_conditional_aggregate(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    return t.orders.agg(F.count("*").alias("n"), F.sum(F.when(status == "F", cents("o_totalprice")).otherwise(0)).alias("f_total"), F.count(F.when(status == "O", 1)).alias("n_open"), F.sum(F.expr("if(o_orderpriority = '1-URGENT', 1, 0)")).alias("n_urgent"))


@query("SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS f_customers FROM orders GROUP BY o_orderpriority")
def r20_count_distinct(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.countDistinct(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))).alias("f_customers"))


@query("SELECT l_returnflag, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity, max(l_extendedprice) AS highest FROM lineitem GROUP BY l_returnflag")
def r21_sum_max(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"), F.max("l_extendedprice").alias("highest"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest FROM orders GROUP BY o_custkey")
def r22_max_by(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("dearest"))


@query("SELECT o_custkey, round(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / nullif(count(*), 0), 4) AS f_rate, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT - max(CAST(round(o_totalprice * 100) AS BIGINT)) AS rest FROM orders GROUP BY o_custkey")
def r23_ratio(t: Tables) -> DataFrame:
    done = F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    return t.orders.groupBy("o_custkey").agg(F.round(F.try_divide(done, F.count("*")), 4).alias("f_rate"), (F.sum(cents("o_totalprice")) - F.max(cents("o_totalprice"))).alias("rest"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def r24_having(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 12")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def r25_distinct(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def r26_row_number(t: Tables) -> DataFrame:
    latest = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return t.orders.withColumn("rn", F.row_number().over(latest)).filter("rn = 1").select("o_custkey", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey)::BIGINT AS quantity, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS highest, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem")
def r27_aggregate_window(t: Tables) -> DataFrame:
    of_order = W.partitionBy("l_orderkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.sum(F.col("l_quantity").cast("bigint")).over(of_order).alias("quantity"), F.max("l_extendedprice").over(of_order).alias("highest"), F.count("*").over(of_order).alias("n"))


@query("SELECT o_orderkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate)::BIGINT AS running FROM orders")
def r28_running_window(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.sum(cents("o_totalprice")).over(W.partitionBy("o_custkey").orderBy("o_orderdate")).alias("running"))


@query("SELECT o_orderkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) OVER (PARTITION BY o_custkey) AS dearest FROM orders")
def r29_max_by_window(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).over(W.partitionBy("o_custkey")).alias("dearest"))


_BOTH = "SELECT c_nationkey AS nationkey, 'customer' AS kind FROM customer {} SELECT s_nationkey, 'supplier' FROM supplier"


def _both_kinds(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("nationkey"), F.lit("customer").alias("kind")).union(t.supplier.select("s_nationkey", F.lit("supplier")))


@query(_BOTH.format("UNION ALL"))
def r30_union_all(t: Tables) -> DataFrame:
    return _both_kinds(t)


@query(" UNION ".join(f"SELECT o_custkey % 50 AS k FROM orders WHERE o_orderkey % 5 = {i}" for i in range(5)))
def r31_union_of_five(t: Tables) -> DataFrame:
    parts = [t.orders.filter(f"o_orderkey % 5 = {i}").select((F.col("o_custkey") % 50).alias("k")) for i in range(5)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


@query("SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def r32_intersect(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("nationkey")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT n_nationkey AS nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier")
def r32_except(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("nationkey")).subtract(t.supplier.select("s_nationkey"))


@query("WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT c_nationkey, sum(n)::BIGINT AS n FROM a JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey), c AS (SELECT n_name, n FROM b JOIN nation ON c_nationkey = n_nationkey) SELECT n_name, n FROM c")
def r33_chained_ctes(t: Tables) -> DataFrame:
    a = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    b = a.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("n").alias("n"))
    return b.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "n")


@query("SELECT *, band || '!' AS shout FROM (SELECT *, CASE WHEN balance > 500000 THEN 'high' ELSE 'low' END AS band FROM (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS balance FROM customer))")
def r34_nested_tables(t: Tables) -> DataFrame:
    inner = t.customer.select("c_custkey", cents("c_acctbal").alias("balance"))
    middle = inner.select("*", F.when(F.col("balance") > 500000, "high").otherwise("low").alias("band"))
    return middle.select("*", F.concat("band", F.lit("!")).alias("shout"))


@query("SELECT n_nationkey, unnest([1, 2]) AS copy FROM nation")
def r35_explode(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))


@query("SELECT p_partkey, string_split(p_type, ' ')[1] AS first_word, string_split(p_type, ' ')[9] AS ninth_word FROM part")
def r36_split_index(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.get(F.split("p_type", " "), 0).alias("first_word"), F.get(F.split("p_type", " "), 8).alias("ninth_word"))


def _scratch(kind: str) -> str:
    return f"{kind}_{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_orderstatus, '2026-03-20' AS dt FROM orders WHERE o_orderstatus = 'F'")
def r37_insert_overwrite(t: Tables) -> DataFrame:
    """Two overwrites of a static partition: only the second one's rows stay."""
    name = _scratch("insert_overwrite")
    t.orders.createOrReplaceTempView(f"{name}_source")
    t.spark.sql(f"CREATE TABLE {name} (o_orderkey BIGINT, o_orderstatus STRING, dt STRING) USING parquet PARTITIONED BY (dt) LOCATION '{own_folder(t.spark, name)}'")
    for status in "OF":
        t.spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (dt = '2026-03-20') SELECT o_orderkey, o_orderstatus FROM {name}_source WHERE o_orderstatus = '{status}'")
    return t.spark.table(name)


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def r38_create_table_as(t: Tables) -> DataFrame:
    name = _scratch("ctas")
    t.customer.createOrReplaceTempView(f"{name}_source")
    t.spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{own_folder(t.spark, name)}' AS SELECT c_mktsegment, count(*) AS n FROM {name}_source GROUP BY c_mktsegment")
    return t.spark.table(name)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def r39_top_k(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def r40_coalesce_hint(t: Tables) -> DataFrame:
    t.nation.createOrReplaceTempView("nation_hinted")
    return t.spark.sql("SELECT /*+ COALESCE(1) */ n_regionkey, count(*) AS n FROM nation_hinted GROUP BY n_regionkey")
