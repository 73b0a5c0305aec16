"""Operators on graphs kept as DataFrames: closures, paths, latest-state merges, convergence of lineage edges.

Closures are semi-naive: each round joins only the newest rows with the edges, drops what is known by an anti-join, and
writes the round to the shared folder. Edges are never broadcast by hint; Spark decides by their measured size.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.plans import ids
from tracewell.plans.schema import CONVERGED
from tracewell.sources.shared import stored

FLOWS = tuple(v for v in CONVERGED.values() if v.startswith("latest_") and "_joins_" not in v)


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, reverse: bool = True) -> DataFrame:
    """(seed, node, depth): nodes reached from each seed with the fewest hops, seeds at depth 0. Safe on cycles.

    edges: (src, dst); reverse walks from dst to src. seeds: one column `seed`.
    """
    step = edges.select(F.col("dst" if reverse else "src").alias("_at"), F.col("src" if reverse else "dst").alias("_to")).distinct()
    step = stored(step, "closure-edges")
    front = stored(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct(), "closure")
    known, depth = front, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = front.join(step, F.col("node") == F.col("_at")).select("seed", F.col("_to").alias("node"), F.lit(depth).alias("depth")).distinct()
        front = stored(new.join(known.select("seed", "node"), ["seed", "node"], "left_anti"), "closure")
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known


def leaf_sources(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, leaf): reached nodes that no edge enters."""
    reached = closure(edges, seeds).select("seed", F.col("node").alias("leaf"))
    return reached.join(edges.select(F.col("dst").alias("leaf")).distinct(), "leaf", "left_anti").select("seed", "leaf")


def paths(edges: DataFrame, seeds: DataFrame, max_depth: int = 20, limit: int | None = None) -> DataFrame:
    """(seed, path, hops, whole): simple reverse paths to where no edge leads on. One that has max_depth hops and could go
    on is cut there, and not whole. With `limit`, so many of the shortest (then by seed and path), and no step beyond them."""
    step = stored(edges.select(F.col("dst").alias("_at"), F.col("src").alias("_to")).distinct(), "path-edges")
    front = seeds.select("seed", F.array("seed").alias("path"))
    done, found = None, 0
    for depth in range(max_depth + 1):
        out = front.join(step, (F.element_at("path", -1) == F.col("_at")) & ~F.array_contains("path", F.col("_to")), "left")
        out = stored(out, "paths")
        ended = out.filter("_to is null").select("seed", "path", F.lit(True).alias("whole"))
        if depth == max_depth:
            ended = ended.unionByName(out.filter("_to is not null").select("seed", "path", F.lit(False).alias("whole")).distinct())
        done = ended if done is None else done.unionByName(ended)
        found += ended.count() if limit is not None else 0
        front = out.filter("_to is not null").select("seed", F.concat("path", F.array("_to")).alias("path"))
        if limit is not None and found >= limit or front.isEmpty():
            break
    out = done.select("seed", "path", (F.size("path") - 1).alias("hops"), "whole")
    return out.orderBy("hops", "seed", "path").limit(limit) if limit is not None else out


def histogram(edges: DataFrame, by: str = "edge_type") -> DataFrame:
    return edges.groupBy(by).agg(F.count("*").alias("n"))


def merge_latest(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[str], keep: str = "last") -> DataFrame:
    """One row a key over both inputs: the `last` by `order` (edges, bundles) or the `first` (vertices of the online path).

    A partial aggregate, so a key that is written again and again costs each task one row. Missing columns are null.
    """
    both = current.unionByName(incoming, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    pick = {"last": F.max_by, "first": F.min_by}[keep]
    out = both.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return out.select(*keys, *(F.col("_row")[c].alias(c) for c in rest)).select(*both.columns)


def converge(edges: DataFrame, capture_time: Column | int, task_id: str | None = None, run_id: str | None = None) -> DataFrame:
    """Internal edges -> kept edges (edge_name, src, dst, rank, last_*): the mapping has twelve rows, all else is dropped.

    Structural edges rank by event, role; latest edges by name and role alone, so a new run overwrites the same edge.
    """
    spark = edges.sparkSession
    mapping = F.broadcast(spark.createDataFrame(list(CONVERGED.items()), "edge_type string, edge_name string"))
    e = edges.join(mapping, "edge_type")
    latest = F.col("edge_name").startswith("latest_")
    rank = F.when(latest, ids.rank_column(F.col("edge_name"), F.col("role"))).otherwise(ids.rank_column(F.col("edge_name"), F.col("role"), F.col("event_id")))
    time = F.lit(capture_time).cast("bigint") if isinstance(capture_time, int) else capture_time.cast("bigint")
    return e.select("edge_name", F.col("source").alias("src"), F.col("target").alias("dst"), rank.alias("rank"), F.col("event_id").alias("last_event_id"), F.lit(task_id).cast("string").alias("last_task_id"), F.lit(run_id).cast("string").alias("last_run_id"), time.alias("last_seen_time"), "role")


def table_has_column(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Edges from known tables to their columns."""
    owners = columns.filter(F.col("owner_type").isin("TABLE", "TABLE_OR_SUBQUERY"))
    known = tables.select(F.col("normalized_name").alias("owner_id")).distinct()
    return owners.join(known, "owner_id").select(F.concat(F.lit("table:"), F.col("owner_id")).alias("src"), F.col("node_id").alias("dst"), F.lit(0).cast("bigint").alias("rank"))


def scope_closure(scopes: DataFrame) -> DataFrame:
    """(ancestor, scope): every scope under itself and all that contain it."""
    up = scopes.filter("parent_scope_id is not null").select(F.col("parent_scope_id").alias("src"), F.col("node_id").alias("dst"))
    return closure(up, scopes.select(F.col("node_id").alias("seed"))).select(F.col("node").alias("ancestor"), F.col("seed").alias("scope"))


def producer_links(instances: DataFrame, scopes: DataFrame) -> DataFrame:
    """Edges from OUTPUT instances to the instances that read the same column in the same scope or one above it."""
    made = instances.filter("instance_type = 'OUTPUT'").select(F.col("node_id").alias("source"), "column_id", F.col("scope_id").alias("scope"))
    read = instances.filter("instance_type <> 'OUTPUT'").select(F.col("node_id").alias("target"), "column_id", F.col("scope_id").alias("ancestor"))
    linked = made.join(scope_closure(scopes), "scope").join(read, ["column_id", "ancestor"])
    return linked.filter("source <> target").select("source", "target", F.lit("COLUMN_INSTANCE_TO_COLUMN_INSTANCE").alias("edge_type"), F.lit("query_block_output_reference").alias("role")).distinct()


_UPSTREAM = ("COLUMN_INSTANCE_TO_COLUMN_INSTANCE", "EXPRESSION_TO_COLUMN_INSTANCE", "COLUMN_INSTANCE_TO_EXPRESSION", "EXPRESSION_TO_EXPRESSION")


def derived_attribution(instances: DataFrame, edges: DataFrame) -> DataFrame:
    """Relations and predicates that shape each OUTPUT instance, over everything upstream of it.

    A predicate met directly on an upstream instance hides the predicates that only its relation has.
    """
    outputs = instances.filter("instance_type = 'OUTPUT'").select(F.col("node_id").alias("seed"))
    flow = edges.filter(F.col("edge_type").isin(*_UPSTREAM)).select(F.col("source").alias("src"), F.col("target").alias("dst"))
    reached = stored(closure(flow, outputs).select("seed", "node"), "upstream")
    of = instances.select(F.col("node_id").alias("node"), F.col("relation_instance_id").alias("relation")).filter("relation is not null")
    relation = stored(reached.join(of, "node").select("seed", "relation", "node").distinct(), "upstream-relations")
    on_instance = edges.filter("edge_type = 'COLUMN_INSTANCE_TO_PREDICATE'").select(F.col("source").alias("node"), F.col("target").alias("predicate"))
    columns = instances.select(F.col("node_id").alias("node"), "column_id", F.coalesce("relation_instance_id", "scope_id").alias("place"))
    # An instance of the same column at the same place that a predicate reads counts as met directly.
    met = reached.join(columns, "node").select("seed", "column_id", "place").distinct()
    direct = met.join(on_instance.join(columns, "node").select("column_id", "place", "predicate").distinct(), ["column_id", "place"])
    by_relation = edges.filter("edge_type = 'RELATION_INSTANCE_TO_PREDICATE'").select(F.col("source").alias("relation"), F.col("target").alias("predicate"))
    suppressed = direct.select("seed", F.col("place").alias("relation")).distinct()
    indirect = relation.select("seed", "relation").distinct().join(suppressed, ["seed", "relation"], "left_anti").join(by_relation, "relation")
    predicates = direct.select("predicate", "seed").unionByName(indirect.select("predicate", "seed")).distinct()
    a = relation.select(F.col("relation").alias("source"), F.col("seed").alias("target")).distinct().withColumns({"edge_type": F.lit("RELATION_INSTANCE_TO_DERIVED_COLUMN_INSTANCE"), "role": F.lit("source_relation")})
    b = predicates.select(F.col("predicate").alias("source"), F.col("seed").alias("target")).withColumns({"edge_type": F.lit("PREDICATE_TO_DERIVED_COLUMN_INSTANCE"), "role": F.lit("derived_predicate")})
    return a.unionByName(b)


def anchor_event(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, event_id, seen): the newest event, by time and then id, over the edges that enter each target."""
    newest = F.max(F.struct("last_seen_time", "last_event_id")).alias("m")
    return edges.join(targets.select(F.col("target").alias("dst")).distinct(), "dst").groupBy(F.col("dst").alias("target")).agg(newest).select("target", F.col("m.last_event_id").alias("event_id"), F.col("m.last_seen_time").alias("seen"))


def joined_pairs(joins: DataFrame, relations: DataFrame) -> DataFrame:
    """Join edges between given relations (column `relation`), each unordered pair and role once."""
    r = relations.select("relation").distinct()
    both = joins.join(r.select(F.col("relation").alias("src")), "src").join(r.select(F.col("relation").alias("dst")), "dst")
    return both.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "role").distinct()


def table_edges(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Every input table to every output table of the same event, self-loops left out."""
    i = inputs.select("event_id", F.col("normalized_name").alias("source")).distinct()
    o = outputs.select("event_id", F.col("normalized_name").alias("target")).distinct()
    return i.join(o, "event_id").filter("source <> target")


def frames_of(spark: SparkSession, rows: dict[str, list[dict]], shapes: dict, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    return {n: spark.createDataFrame([tuple(r.get(f.name) for f in shapes[n].fields) for r in rows.get(n, [])], shapes[n]) for n in (names or shapes)}
