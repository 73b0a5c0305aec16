"""Explaining one field: the columns, expressions, predicates, joins and literals behind an output column.

Works on the kept tables (a dict of DataFrames). The walk upstream is one closure; only what explains the one field
comes to the driver, for the report.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import graph
from tracewell.plans import ids
from tracewell.sources.shared import stored

#: Flows of values alone, without what filters and joins decide.
_VALUE = tuple(f for f in graph.FLOWS if "predicate" not in f and "relation" not in f)


class FieldNotFound(LookupError):
    pass


def display_reference(alias, instance, table, node):
    """Columns or plain strings: the first that is not blank of alias, instance name and table, else the id."""
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in (alias, instance, table)), node)


def alias_hints(sql: str) -> list[tuple[str, str]]:
    """(alias, column) pairs that an SQL text mentions."""
    import re

    return list(dict.fromkeys(re.findall(r"\b([A-Za-z_]\w*)\.`?([A-Za-z_]\w*)`?", sql)))


class Explainer:
    def __init__(self, tables: dict[str, DataFrame]):
        # Each question asks the same tables: they are kept once computed, and the flow edges are one table.
        self.t = {name: df.persist() for name, df in tables.items()}
        self._flow = reduce(DataFrame.unionByName, (self.edges(n).select("src", "dst", "role", "last_event_id", "last_seen_time", F.lit(n).alias("kind")) for n in graph.FLOWS)).persist()

    # --- look-ups

    def table(self, name: str) -> DataFrame:
        return self.t["table_node"].filter(F.col("vid") == ids.table_id(name))

    def column(self, table: str, column: str) -> DataFrame:
        """Columns of the table by name, whatever its case."""
        of = self.t["table_has_column"].filter(F.col("src") == ids.table_id(table)).select(F.col("dst").alias("vid"))
        return self.t["column_node"].join(of, "vid").filter(F.lower("name") == column.lower())

    def edges(self, name: str, anchor: str | None = None) -> DataFrame:
        """Kept edges of a type, of the anchor event alone if one is given; a type that is not kept is empty."""
        if name not in self.t:
            spark = next(iter(self.t.values())).sparkSession
            return spark.createDataFrame([], "src string, dst string, rank bigint, last_event_id string, last_seen_time bigint, role string")
        e = self.t[name]
        return e.filter(F.col("last_event_id") == anchor) if anchor and "last_event_id" in e.columns else e

    def flow(self, anchor: str | None = None) -> DataFrame:
        """All flow edges, of the anchor event alone if one is given."""
        return self._flow.filter(F.col("last_event_id") == anchor) if anchor else self._flow

    def instances(self, column_ids: DataFrame) -> DataFrame:
        """OUTPUT instances of the columns (`vid`), else all their instances."""
        all_ = self.t["column_has_instance"].join(column_ids.select(F.col("vid").alias("src")), "src").select(F.col("dst").alias("vid")).distinct().join(self.t["column_instance_node"], "vid")
        outputs = all_.filter("instance_type = 'OUTPUT'")
        return all_ if outputs.isEmpty() else outputs

    def anchor(self, column_ids: DataFrame) -> str | None:
        targets = column_ids.select(F.col("vid").alias("target")).unionByName(self.instances(column_ids).select(F.col("vid").alias("target")))
        newest = graph.anchor_event(self.flow(), targets).agg(F.max(F.struct("seen", "event_id"))["event_id"]).collect()
        return newest[0][0] if newest else None

    # --- walks

    def upstream(self, column_ids: DataFrame, anchor: str | None = None) -> DataFrame:
        """(seed, node, depth) over all flow edges into the columns' output instances."""
        seeds = self.instances(column_ids)
        if anchor:
            touched = self.flow(anchor).select(F.col("dst").alias("vid")).distinct()
            held = seeds.join(touched, "vid", "left_semi")
            seeds = seeds if held.isEmpty() else held
        return stored(graph.closure(self.flow(anchor).select("src", "dst"), seeds.select(F.col("vid").alias("seed"))), "upstream")

    def of(self, reached: DataFrame, name: str) -> DataFrame:
        """Rows of a vertex table among the reached nodes."""
        return self.t[name].join(reached.select(F.col("node").alias("vid")).distinct(), "vid")

    def upstream_columns(self, reached: DataFrame, own: DataFrame) -> DataFrame:
        columns = self.of(reached, "column_instance_node").select(F.col("column_id").alias("vid")).distinct()
        return self.t["column_node"].join(columns, "vid").join(own.select("vid"), "vid", "left_anti")

    def value_columns(self, own: DataFrame, anchor: str | None) -> list[str]:
        """Columns whose values reach the field, as owner.name."""
        flow = self.flow(anchor).filter(F.col("kind").isin(*_VALUE)).select("src", "dst")
        reached = graph.closure(flow, self.instances(own).select(F.col("vid").alias("seed")))
        return sorted(f"{r['owner_id']}.{r['name']}" for r in self.upstream_columns(reached, own).collect() if not r["owner_id"].startswith("scope:"))

    def source_columns(self, expression: str, anchor: str | None = None) -> DataFrame:
        """Columns that an expression reads, through its instances; (owner, name) once."""
        read = self.edges("latest_column_instance_flows_to_expression", anchor).filter(F.col("dst") == expression)
        inst = self.t["column_instance_node"].join(read.select(F.col("src").alias("vid")).distinct(), "vid")
        return self.t["column_node"].join(inst.select(F.col("column_id").alias("vid")).distinct(), "vid").select("owner_id", "name").distinct()

    def relations_of(self, predicate: str, anchor: str | None = None) -> DataFrame:
        e = self.edges("latest_relation_instance_flows_to_predicate", anchor).filter(F.col("dst") == predicate)
        return e.select(F.col("src").alias("vid"), "role").distinct().join(self.t["relation_instance_node"], "vid")

    def joins(self, reached: DataFrame, anchor: str | None = None) -> DataFrame:
        relations = self.of(reached, "relation_instance_node").select(F.col("vid").alias("relation"))
        return graph.joined_pairs(self.edges("latest_relation_instance_joins_relation_instance", anchor).select("src", "dst", "role"), relations)

    def filters(self, reached: DataFrame, anchor: str | None = None) -> DataFrame:
        """Predicates on the reached instances or their relations, each (predicate, role) once."""
        nodes = reached.select(F.col("node").alias("src")).distinct()
        both = self.edges("latest_column_instance_flows_to_predicate", anchor).unionByName(self.edges("latest_relation_instance_flows_to_predicate", anchor)).select("src", F.col("dst").alias("vid"), "role")
        return both.join(nodes, "src").select("vid", "role").distinct().join(self.t["predicate_node"].select("vid", "predicate_sql", "predicate_role"), "vid")

    # --- reports

    def explain(self, table: str, column: str) -> dict:
        """target, value_path, conditions, relations, upstream: everything about one field."""
        if self.table(table).isEmpty():
            raise FieldNotFound(f"table {table} is not in the store")
        own = stored(self.column(table, column), "column")
        if own.isEmpty():
            raise FieldNotFound(f"table {table} has no column {column}")
        anchor = self.anchor(own)
        reached = self.upstream(own, anchor)
        relations = {r["vid"]: r.asDict() for r in self.of(reached, "relation_instance_node").collect()}
        shown = {k: r["alias_name"] or r["instance_name"] or r["source_table_id"] or k for k, r in relations.items()}
        expressions = []
        flows = self.edges("latest_literal_flows_to_expression", anchor).select("src", F.col("dst").alias("vid"))
        literal = {}
        for r in flows.join(self.t["literal_node"].select(F.col("vid").alias("src"), "literal_value"), "src").join(reached.select(F.col("node").alias("vid")).distinct(), "vid").collect():
            literal.setdefault(r["vid"], []).append(r["literal_value"])
        read = self.edges("latest_column_instance_flows_to_expression", anchor).select(F.col("src").alias("iid"), F.col("dst").alias("vid"))
        instance = self.t["column_instance_node"].select(F.col("vid").alias("iid"), "column_id", "column_name", "relation_instance_id")
        sources: dict[str, list[str]] = {}
        for r in read.join(instance, "iid").join(reached.select(F.col("node").alias("vid")).distinct(), "vid").collect():
            sources.setdefault(r["vid"], []).append(f"{shown.get(r['relation_instance_id']) or 'unresolved'}({r['column_id'].rsplit('.', 1)[0]}).{r['column_name']}" if r["relation_instance_id"] else r["column_id"])
        for r in self.of(reached, "expression_node").orderBy("vid").collect():
            expressions.append({"id": r["vid"], "category": r["category"], "sql": r["display_sql"], "black_box": r["black_box"], "source_columns": sorted(set(sources.get(r["vid"], []))), "literals": sorted(set(literal.get(r["vid"], [])))})
        target = own.first().asDict()
        return {
            "target": {"table": table, "column": target["name"], "id": target["vid"], "data_type": target["data_type"], "anchor_event": anchor},
            "expressions": expressions,
            "upstreamColumns": sorted(f"{r['owner_id']}.{r['name']}" for r in self.upstream_columns(reached, own).collect() if not r["owner_id"].startswith("scope:")),
            "valueColumns": self.value_columns(own, anchor),
            "predicates": sorted(({"sql": r["predicate_sql"], "role": r["role"], "kind": r["predicate_role"]} for r in self.filters(reached, anchor).collect()), key=lambda p: (p["kind"], p["sql"], p["role"])),
            "joins": sorted({f" {r['role']} ".join(sorted((shown.get(r["a"], r["a"]), shown.get(r["b"], r["b"])))) for r in self.joins(reached, anchor).collect()}),
            "relations": sorted({r["source_table_id"] for r in relations.values()}),
            "value_path": self.value_path(own, anchor, expressions),
            "conditions": self.conditions(reached, anchor, shown),
        }

    def value_path(self, own: DataFrame, anchor: str | None, expressions: list[dict]) -> list[dict]:
        """Steps from source columns over expressions to the field, along values alone: step 0 is what nothing feeds."""
        flow = self.flow(anchor).filter(F.col("kind").isin(*_VALUE)).select("src", "dst")
        walked = graph.closure(flow, self.instances(own).select(F.col("vid").alias("seed")))
        depth = {r["node"]: r["depth"] for r in walked.groupBy("node").agg(F.max("depth").alias("depth")).collect()}
        known = {e["id"]: e for e in expressions}
        columns = self.of(walked, "column_instance_node").select("vid", "column_id", "instance_type").collect()
        read = [r for r in columns if r["instance_type"] != "OUTPUT" and not r["column_id"].startswith("scope:")]
        nodes = [(depth[r["vid"]], "column", r["column_id"]) for r in read] + [(d, known[n]["category"], known[n]["sql"]) for n, d in depth.items() if n in known]
        order = {d: k for k, d in enumerate(sorted({d for d, *_ in nodes}, reverse=True))}
        field = own.first()["name"]
        return [{"step": order[d], "kind": kind, "shown": text, "into": field} for d, kind, text in sorted(set(nodes), key=lambda x: (order[x[0]], x[1:]))]

    def conditions(self, reached: DataFrame, anchor: str | None, shown: dict[str, str]) -> list[dict]:
        """Filters and join conditions on the way, each with the relations that it is about."""
        found = {}
        for r in self.filters(reached, anchor).collect():
            found[r["vid"], r["role"]] = {"kind": r["predicate_role"], "role": r["role"], "sql": r["predicate_sql"], "relations": []}
        about = self.edges("latest_relation_instance_flows_to_predicate", anchor).select("src", F.col("dst").alias("vid"), "role").distinct()
        for r in about.join(reached.sparkSession.createDataFrame([(v,) for v, _ in found], "vid string").distinct(), "vid").collect() if found else []:
            if (r["vid"], r["role"]) in found:
                found[r["vid"], r["role"]]["relations"].append(shown.get(r["src"], r["src"]))
        return [c | {"relations": sorted(set(c["relations"]))} for c in sorted(found.values(), key=lambda c: (c["kind"], c["sql"], c["role"]))]

    def tree(self, table: str, column: str) -> str:
        """Indented upstream walk, each node printed once."""
        own = self.column(table, column)
        anchor = self.anchor(own)
        reached = self.upstream(own, anchor)
        nodes = reached.select(F.col("node").alias("dst")).distinct()
        into: dict[str, list[tuple[str, str]]] = {}
        for r in self.flow(anchor).join(nodes, "dst").select("src", "dst", "role").distinct().orderBy("dst", "src").collect():
            into.setdefault(r["dst"], []).append((r["src"], r["role"]))
        text = {}
        for name, label, shown in (("column_instance_node", "COL_INST", "column_id"), ("relation_instance_node", "RELATION", "instance_name"), ("expression_node", "EXPR", "display_sql"), ("literal_node", "LITERAL", "literal_value"), ("predicate_node", "PREDICATE", "predicate_sql")):
            text.update({r["vid"]: f"{label} {r[shown]}" for r in self.of(reached, name).select("vid", shown).collect()})
        lines, seen = [f"{table}.{column}"], set()
        stack = [(r["vid"], 1) for r in self.instances(own).select("vid").orderBy(F.desc("vid")).collect()]
        while stack:
            node, depth = stack.pop()
            if node in seen:
                continue
            seen.add(node)
            lines.append("  " * depth + text.get(node, node))
            stack += [(src, depth + 1) for src, _ in reversed(into.get(node, []))]
        return "\n".join(lines)

    def report(self, table: str, column: str, form: str = "text") -> str:
        found = self.explain(table, column)
        if form == "json":
            return json.dumps(found, ensure_ascii=False, indent=2)
        lines = [f"field {found['target']['id']} ({found['target']['data_type']})", "expressions:"]
        for e in found["expressions"]:
            lines += [f"  [{e['category']}] {e['sql']}", *(f"    from {s}" for s in e["source_columns"]), *(f"    literal {x}" for x in e["literals"])]
        for title, key in (("upstream columns", "upstreamColumns"), ("joins", "joins"), ("relations", "relations")):
            lines += [f"{title}:", *(f"  {x}" for x in found[key])]
        lines += ["predicates:", *(f"  [{p['kind']}] {p['sql']} ({p['role']})" for p in found["predicates"])]
        return "\n".join(lines)


def table_neighbours(edges: DataFrame, table: str, direction: str = "upstream", hops: int | None = 1) -> DataFrame:
    """(table, hops): tables before or after one, to a number of hops or (None) to the end."""
    e = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    seed = edges.sparkSession.createDataFrame([(table,)], "seed string")
    return graph.closure(e, seed, hops, reverse=direction == "upstream").filter("depth > 0").select(F.col("node").alias("table"), F.col("depth").alias("hops"))
