"""Hierarchies: a graph whose nodes are collapsed into meta-nodes, level by level.

Level 0 is the base graph.  Every level above is the graph of meta-nodes over the one below, and one frame
of memberships (level, meta_id, node_id) links them; a meta-node's name is unique in its level.  A node
that a level doesn't collapse stands for itself there.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.graph import Graph, assign_edge_ids
from quillgraph.operators.table import aggregate
from quillgraph.plans.staging import cut

#: What becomes of edges: aggregate: one edge between two meta-nodes; keep_external: those that leave a
#: meta-node stay one by one; drop_all: none; contract_all: as aggregate, with edges inside as loops.
EDGE_STRATEGIES = ("aggregate", "keep_external", "drop_all", "contract_all")


def named_aggregate(how: str, column: str) -> Column:
    """An aggregate of an attribute by name; ``concat:,`` joins values in their order, ``concat_unique:,``
    distinct ones."""
    name, _, by = how.partition(":")
    if name == "concat":
        return F.array_join(F.array_sort(F.collect_list(F.col(column).cast("string"))), by or ",")
    if name == "concat_unique":
        return F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), by or ",")
    if name == "count":
        return F.count(F.lit(1))
    return aggregate(name, column)


@dataclass(frozen=True)
class Plan:
    """How to collapse: {new attribute: (function, attribute)} for nodes and edges, and edge handling.

    ``defaults`` stand in for aggregates of nothing.
    """

    nodes: Mapping[str, tuple[str, str]]
    edges: Mapping[str, tuple[str, str]]
    strategy: str = "aggregate"
    min_edges: int = 1
    defaults: Mapping[str, object] | None = None

    def preview(self, g: Graph, parts: DataFrame) -> DataFrame:
        """One row: meta_nodes and nodes they take, edges inside, edges that leave them."""
        p = parts.toDF("node_id", "part")
        e = g.edges.join(p.toDF("source", "p"), "source", "left").join(p.toDF("target", "q"), "target", "left")
        inside = F.col("p").isNotNull() & (F.col("p") == F.col("q"))
        out = e.agg(F.count_if(inside).alias("inside"), F.count_if(~F.coalesce(inside, F.lit(False)) & (F.col("p").isNotNull() | F.col("q").isNotNull())).alias("leaving"))
        return p.agg(F.count_distinct("part").alias("meta_nodes"), F.count(F.lit(1)).alias("nodes")).crossJoin(F.broadcast(out))


def preset(name: str, node_attr: str = "weight", edge_attr: str = "weight") -> Plan:
    """Plans for common kinds of graphs, over one attribute of nodes and one of edges."""
    presets = {
        "social_network": Plan({"size": ("count", "node_id"), f"mean_{node_attr}": ("mean", node_attr)}, {f"mean_{edge_attr}": ("mean", edge_attr)}),
        "org_hierarchy": Plan({"size": ("count", "node_id"), f"sum_{node_attr}": ("sum", node_attr)}, {f"sum_{edge_attr}": ("sum", edge_attr)}, "contract_all"),
        "flow_network": Plan({f"sum_{node_attr}": ("sum", node_attr)}, {f"sum_{edge_attr}": ("sum", edge_attr)}, "aggregate"),
    }
    if name not in presets:
        raise ValueError(f"presets are {', '.join(presets)}")
    return presets[name]


def collapse(g: Graph, parts: DataFrame, plan: Plan) -> Graph:
    """The graph of meta-nodes of (node_id, part) under a plan."""
    if plan.strategy not in EDGE_STRATEGIES:
        raise ValueError(f"edge strategies are {', '.join(EDGE_STRATEGIES)}")
    nodes = {n: named_aggregate(how, c) for n, (how, c) in plan.nodes.items()}
    edges = {n: named_aggregate(how, c) for n, (how, c) in plan.edges.items()}
    meta, _ = g.collapse(parts, nodes, edges, plan.min_edges, plan.strategy == "contract_all")
    if plan.strategy == "keep_external":
        p = parts.toDF("node_id", "part")
        e = g.edges.join(p.toDF("source", "__p"), "source", "left").join(p.toDF("target", "__q"), "target", "left")
        e = e.withColumns({"source": F.coalesce("__p", "source"), "target": F.coalesce("__q", "target")}).where("source <> target")
        meta = Graph(meta.nodes, e.select(*g.edges.columns), g.directed)
    elif plan.strategy == "drop_all":
        meta = Graph(meta.nodes, meta.edges.where(F.lit(False)), g.directed)
    if plan.defaults:
        meta = Graph(meta.nodes.na.fill({k: v for k, v in plan.defaults.items() if k in meta.nodes.columns}), meta.edges, g.directed)
    return meta


@dataclass(frozen=True)
class Hierarchy:
    """Graphs by level, the base first, and memberships (level, meta_id, node_id) of the levels above."""

    levels: tuple[Graph, ...]
    members: DataFrame | None = None

    @property
    def top(self) -> Graph:
        return self.levels[-1]

    def collapse(self, parts: DataFrame, plan: Plan) -> Hierarchy:
        """One level more: parts (node_id, part) of the top level become its nodes."""
        p = parts.toDF("node_id", "part")
        alone = self.top.nodes.select("node_id").join(p, "node_id", "left_anti").select(F.col("node_id").alias("meta_id"), "node_id")
        own = cut(p.select(F.col("part").alias("meta_id"), "node_id").unionByName(alone).select(F.lit(len(self.levels)).alias("level"), "meta_id", "node_id"), "hierarchy")
        members = own if self.members is None else self.members.unionByName(own)
        return Hierarchy((*self.levels, collapse(self.top, parts, plan)), members)

    def _at(self, level: int) -> DataFrame:
        return self.members.where(F.col("level") == level).select("meta_id", "node_id")

    def parent(self, level: int) -> DataFrame:
        """(node_id, parent) of the nodes of a level below the top."""
        return self._at(level + 1).select("node_id", F.col("meta_id").alias("parent"))

    def children(self, level: int) -> DataFrame:
        """(meta_id, node_id) of a level above the base."""
        return self._at(level)

    def is_meta(self, level: int) -> DataFrame:
        """(node_id, is_meta): whether a node of a level stands for others, or for one under another name."""
        if level == 0:
            return self.levels[0].nodes.select("node_id", F.lit(False).alias("is_meta"))
        return self._at(level).groupBy(F.col("meta_id").alias("node_id")).agg((F.count(F.lit(1)) > 1).alias("many"), F.bool_or(F.col("meta_id") != F.col("node_id")).alias("other")).select("node_id", (F.col("many") | F.col("other")).alias("is_meta"))

    def base_nodes(self, level: int | None = None) -> DataFrame:
        """(meta_id, node_id): base nodes that the nodes of a level (the top) stand for."""
        level = len(self.levels) - 1 if level is None else level
        if level == 0:
            return self.levels[0].nodes.select(F.col("node_id").alias("meta_id"), "node_id")
        out = self._at(level)
        for k in range(level - 1, 0, -1):
            below = self._at(k).select(F.col("meta_id").alias("mid"), F.col("node_id").alias("below"))
            out = out.join(below, out["node_id"] == below["mid"]).select("meta_id", F.col("below").alias("node_id"))
        return out

    def root(self) -> DataFrame:
        """(node_id, root) of every base node: what stands for it at the top."""
        return self.base_nodes().select("node_id", F.col("meta_id").alias("root"))

    def expand(self, meta_id, level: int | None = None) -> Graph:
        """The base subgraph that a node of a level stands for."""
        return self.levels[0].induced(self.base_nodes(level).where(F.col("meta_id") == meta_id).select("node_id"))

    def re_aggregate(self, aggs: Mapping[str, tuple[str, str]], level: int | None = None) -> DataFrame:
        """(node_id, new attributes) of a level, from the base nodes' attributes."""
        rows = self.base_nodes(level).join(self.levels[0].nodes, "node_id")
        return rows.groupBy(F.col("meta_id").alias("__m")).agg(*[named_aggregate(how, c).alias(n) for n, (how, c) in aggs.items()]).withColumnRenamed("__m", "node_id")

    def meta_edges(self, level: int | None = None) -> DataFrame:
        """(source, target, edge_id): the base edges that an edge between two nodes of a level comes from."""
        own = self.base_nodes(level)
        e = self.levels[0].edges.join(own.toDF("a", "source"), "source").join(own.toDF("b", "target"), "target")
        a, b = (F.col("a"), F.col("b")) if self.levels[0].directed else (F.least("a", "b"), F.greatest("a", "b"))
        return e.where("a <> b").select(a.alias("source"), b.alias("target"), "edge_id")


def add_subgraphs(g: Graph, subgraphs: Mapping[int, DataFrame], plan: Plan) -> Graph:
    """The graph with one more node for each subgraph {new id: ids}, and edges to what its nodes touch outside.

    The members stay; new nodes have ``is_meta`` and the plan's aggregates.  A new node's edge to a node
    outside has ``edge_count`` and the plan's aggregates.
    """
    parts = None
    for name, ids in subgraphs.items():
        own = ids.toDF("node_id").distinct().withColumn("part", F.lit(name).cast("long"))
        parts = own if parts is None else parts.unionByName(own)
    taken = g.nodes.join(parts.select(F.col("part").alias("node_id")), "node_id", "left_semi")
    if not taken.isEmpty():
        raise ValueError("the id of a new node is taken")
    made = parts.join(g.nodes, "node_id").groupBy("part").agg(F.count(F.lit(1)).alias("members"), *[named_aggregate(how, c).alias(n) for n, (how, c) in plan.nodes.items()])
    made = made.withColumnRenamed("part", "node_id").withColumn("is_meta", F.lit(True))
    attrs = [c for c in g.edges.columns if c not in ("edge_id", "source", "target")]
    both = g.edges.select("source", "target", *attrs).unionByName(g.edges.select(F.col("target").alias("source"), F.col("source").alias("target"), *attrs))
    ends = both.join(parts.select(F.col("node_id").alias("source"), "part"), "source")
    outside = ends.join(parts.select(F.col("node_id").alias("target"), "part"), ["target", "part"], "left_anti")
    e = outside.groupBy(F.col("part").alias("source"), "target").agg(F.count(F.lit(1)).alias("edge_count"), *[named_aggregate(how, c).alias(n) for n, (how, c) in plan.edges.items()]).where(F.col("edge_count") >= plan.min_edges)
    top = g.edges.agg(F.coalesce(F.max("edge_id"), F.lit(-1)) + 1).first()[0]
    e = assign_edge_ids(e).withColumn("edge_id", F.col("edge_id") + top)
    return Graph(g.nodes.withColumn("is_meta", F.lit(False)).unionByName(made, allowMissingColumns=True), g.edges.unionByName(e, allowMissingColumns=True), g.directed)
