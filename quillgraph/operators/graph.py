"""Graphs: a frame of nodes and a frame of edges.

Nodes have ``node_id``, edges ``edge_id, source, target``; all other columns are attributes.  Graphs are
values: every operator returns a new one or a frame.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.predicate import parse
from quillgraph.operators import local
from quillgraph.operators.components import connected_components
from quillgraph.plans.ordering import with_position
from quillgraph.plans.staging import cut


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    directed: bool = False

    # --- construction and change ---

    @classmethod
    def from_edges(cls, edges: DataFrame, directed: bool = False, source: str = "source", target: str = "target") -> Graph:
        """Nodes are the endpoints; edge ids are assigned where there are none."""
        e = edges.withColumnsRenamed({source: "source", target: "target"})
        if "edge_id" not in e.columns:
            e = assign_edge_ids(e)
        nodes = e.select(F.col("source").alias("node_id")).union(e.select("target")).distinct()
        return cls(nodes, e, directed)

    def add_nodes(self, nodes: DataFrame) -> Graph:
        """Nodes whose ids are new; attributes that they lack are null."""
        new = nodes.join(self.nodes, "node_id", "left_anti")
        return Graph(self.nodes.unionByName(new, allowMissingColumns=True), self.edges, self.directed)

    def add_edges(self, edges: DataFrame) -> Graph:
        """Edges both ends of which are nodes; the others are left out."""
        ids = self.nodes.select("node_id")
        ok = edges.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")
        return Graph(self.nodes, self.edges.unionByName(ok, allowMissingColumns=True), self.directed)

    def remove_nodes(self, ids: DataFrame) -> Graph:
        """Drops nodes (ids: one column) and all edges at them."""
        gone = ids.toDF("node_id").distinct()
        e = self.edges
        for end in ("source", "target"):
            e = e.join(gone.withColumnRenamed("node_id", end), end, "left_anti")
        return Graph(self.nodes.join(gone, "node_id", "left_anti"), e.select(*self.edges.columns), self.directed)

    def remove_edges(self, ids: DataFrame) -> Graph:
        return Graph(self.nodes, self.edges.join(ids.toDF("edge_id"), "edge_id", "left_anti").select(*self.edges.columns), self.directed)

    def set_node_attrs(self, updates: DataFrame) -> Graph:
        """Attributes overwritten for the ids that ``updates`` has (nulls leave the old value)."""
        return Graph(_update(self.nodes, updates, "node_id"), self.edges, self.directed)

    def set_edge_attrs(self, updates: DataFrame) -> Graph:
        return Graph(self.nodes, _update(self.edges, updates, "edge_id"), self.directed)

    def proper(self) -> Graph:
        """Without null node ids and without edges an end of which is null or no node."""
        nodes = self.nodes.where("node_id IS NOT NULL")
        ids = nodes.select("node_id").distinct()
        e = self.edges
        for end in ("source", "target"):
            e = e.join(ids.withColumnRenamed("node_id", end), end, "left_semi")
        return Graph(nodes, e.select(*self.edges.columns), self.directed)

    # --- adjacency and counts ---

    def adjacency(self, direction: str = "auto") -> DataFrame:
        """(node_id, neighbor_id, edge_id): out, in, both; auto is out for directed graphs, else both."""
        out = self.edges.select(F.col("source").alias("node_id"), F.col("target").alias("neighbor_id"), "edge_id")
        into = self.edges.select(F.col("target").alias("node_id"), F.col("source").alias("neighbor_id"), "edge_id")
        direction = ("out" if self.directed else "both") if direction == "auto" else direction
        if direction == "both":
            return out.unionByName(into.where("node_id <> neighbor_id"))
        return out if direction == "out" else into

    def neighbors(self, ids: DataFrame | None = None, direction: str = "auto") -> DataFrame:
        """Distinct (node_id, neighbor_id), of the given nodes or of all."""
        adj = self.adjacency(direction).select("node_id", "neighbor_id")
        if ids is not None:
            adj = adj.join(ids.toDF("node_id"), "node_id", "left_semi")
        return adj.distinct()

    def degree(self, kind: str = "all") -> DataFrame:
        """(node_id, degree): all (a self-loop counts once), in or out; nodes without edges have 0."""
        adj = self.adjacency({"all": "both", "in": "in", "out": "out"}[kind])
        count = adj.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
        return self.nodes.select("node_id").join(count, "node_id", "left").na.fill(0, ["degree"])

    def weighted_degree(self, weight: str, default: float = 1.0) -> DataFrame:
        """(node_id, weighted_degree): weights added at both ends; a missing one counts as ``default``."""
        w = F.coalesce(F.col(weight).cast("double"), F.lit(default))
        ends = self.edges.select(F.explode(F.array("source", "target")).alias("node_id"), w.alias("w"))
        total = ends.groupBy("node_id").agg(F.sum("w").alias("weighted_degree"))
        return self.nodes.select("node_id").join(total, "node_id", "left").na.fill(0.0, ["weighted_degree"])

    def density(self) -> DataFrame:
        """One row ``density``: e / n(n - 1), doubled for undirected graphs; 0 for less than two nodes."""
        n = self.nodes.agg(F.count(F.lit(1)).cast("double").alias("n"))
        e = self.edges.agg(F.count(F.lit(1)).cast("double").alias("e"))
        pairs = F.col("n") * (F.col("n") - 1) / (1 if self.directed else 2)
        return n.crossJoin(F.broadcast(e)).select(F.when(F.col("n") > 1, F.col("e") / pairs).otherwise(0.0).alias("density"))

    def edge_stats(self) -> DataFrame:
        """One row: edges, self_loops, distinct sources, targets and endpoints."""
        ends = self.edges.select(F.explode(F.array("source", "target")).alias("x")).agg(F.count_distinct("x").alias("endpoints"))
        own = self.edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("source") == F.col("target")).alias("self_loops"), F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets"))
        return own.crossJoin(F.broadcast(ends))

    def parallel_edges(self) -> DataFrame:
        """Edges that share both endpoints with another (in either order, if undirected)."""
        a, b = (F.col("source"), F.col("target")) if self.directed else (F.least("source", "target"), F.greatest("source", "target"))
        keyed = self.edges.withColumns({"__a": a, "__b": b})
        many = keyed.groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__a", "__b")
        return keyed.join(many, ["__a", "__b"], "left_semi").drop("__a", "__b")

    # --- subgraphs ---

    def induced(self, ids: DataFrame) -> Graph:
        """The given nodes (one column) and the edges among them."""
        keep = ids.toDF("node_id").distinct()
        e = self.edges
        for end in ("source", "target"):
            e = e.join(keep.withColumnRenamed("node_id", end), end, "left_semi")
        return Graph(self.nodes.join(keep, "node_id", "left_semi"), e.select(*self.edges.columns), self.directed)

    def filter_nodes(self, condition: str | Column) -> Graph:
        cond = parse(condition, self.nodes.columns) if isinstance(condition, str) else condition
        return self.induced(self.nodes.where(cond).select("node_id"))

    def filter_edges(self, condition: str | Column) -> Graph:
        """The edges that match, and their endpoints."""
        cond = parse(condition, self.edges.columns) if isinstance(condition, str) else condition
        e = self.edges.where(cond)
        ends = e.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
        return Graph(self.nodes.join(ends, "node_id", "left_semi"), e, self.directed)

    def filter_edges_by_endpoint(self, condition: str, which: str = "either") -> Graph:
        """Edges whose source, target, both or either endpoint is a node that matches."""
        hits = self.nodes.where(parse(condition, self.nodes.columns)).select("node_id")
        flag = lambda end: hits.select(F.col("node_id").alias(end), F.lit(True).alias(f"__{end}"))
        e = self.edges.join(flag("source"), "source", "left").join(flag("target"), "target", "left")
        s, t = (F.col(f"__{x}").isNotNull() for x in ("source", "target"))
        e = e.where({"source": s, "target": t, "both": s & t, "either": s | t}[which]).select(*self.edges.columns)
        return Graph(self.nodes, e, self.directed).filter_edges(F.lit(True))

    def filter_degree(self, low: int, high: int | None = None) -> Graph:
        d = self.degree().where((F.col("degree") >= low) & (F.col("degree") <= high if high is not None else F.lit(True)))
        return self.induced(d.select("node_id"))

    def union(self, other: Graph) -> Graph:
        return Graph(self.nodes.unionByName(other.nodes, allowMissingColumns=True).dropDuplicates(["node_id"]), self.edges.unionByName(other.edges, allowMissingColumns=True).dropDuplicates(["edge_id"]), self.directed)

    def intersect(self, other: Graph) -> Graph:
        return Graph(self.nodes.join(other.nodes, "node_id", "left_semi"), self.edges.join(other.edges, "edge_id", "left_semi").select(*self.edges.columns), self.directed)

    def subtract(self, other: Graph) -> Graph:
        return self.induced(self.nodes.join(other.nodes, "node_id", "left_anti").select("node_id"))

    def similarity(self, other: Graph) -> DataFrame:
        """One row: jaccard, dice, overlap and cosine of the node sets."""
        a = self.nodes.select("node_id", F.lit(1).alias("a")).distinct()
        b = other.nodes.select("node_id", F.lit(1).alias("b")).distinct()
        n = a.join(b, "node_id", "full").agg(F.count("a").alias("a"), F.count("b").alias("b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("i"))
        div = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
        a, b, i = F.col("a"), F.col("b"), F.col("i")
        return n.select(div(i, a + b - i).alias("jaccard"), div(2 * i, a + b).alias("dice"), div(i, F.least(a, b)).alias("overlap"), div(i, F.sqrt(a * b)).alias("cosine"))

    def k_hop(self, seeds: DataFrame, k: int, direction: str = "auto") -> DataFrame:
        """(seed, node_id, hop) of all nodes within k steps of each seed, with the least number of steps."""
        adj = self.neighbors(direction=direction)
        known = seeds.toDF("seed").distinct().select("seed", F.col("seed").alias("node_id"), F.lit(0).alias("hop"))
        front = known
        for h in range(1, k + 1):
            step = front.join(adj, "node_id").select("seed", F.col("neighbor_id").alias("node_id")).distinct()
            front = cut(step.join(known.select("seed", "node_id"), ["seed", "node_id"], "left_anti").withColumn("hop", F.lit(h)), "k-hop")
            known = known.unionByName(front)
        return known

    def neighborhood(self, seeds: DataFrame, k: int = 1) -> Graph:
        return self.induced(self.k_hop(seeds, k).select("node_id"))

    def boundary(self, ids: DataFrame) -> DataFrame:
        """Members of a node set that have a neighbour outside."""
        keep = ids.toDF("node_id").distinct()
        adj = self.neighbors(keep, "both")
        return adj.join(keep.withColumnRenamed("node_id", "neighbor_id"), "neighbor_id", "left_anti").select("node_id").distinct()

    def components(self, local_edges: int | None = None) -> DataFrame:
        """(node_id, component): weak components, named by their least node; lone nodes are their own.

        Null node ids, and edges an end of which is null or no node, are left out at every size.  Graphs of up to ``local_edges`` (see ``local``; 0: never) are done in one task.
        """
        small = local.small(self.edges, self.nodes, local_edges)
        if small is not None:
            return local.one_task(small, local.components, "node_id bigint, component bigint")
        g = self.proper()
        found = connected_components(g.edges)
        out = g.nodes.select("node_id").distinct().join(found.withColumnRenamed("node", "node_id"), "node_id", "left")
        return out.withColumn("component", F.coalesce("component", "node_id"))

    def largest_component(self) -> Graph:
        comp = cut(self.components(), "components")
        top = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
        return self.induced(comp.join(top, "component", "left_semi").select("node_id"))

    def is_connected(self) -> bool:
        return self.components().select("component").distinct().limit(2).count() <= 1

    def has_edge(self, a, b) -> bool:
        """Whether an edge joins two nodes (from a to b, if directed)."""
        hit = (F.col("source") == a) & (F.col("target") == b)
        return not self.edges.where(hit if self.directed else hit | ((F.col("source") == b) & (F.col("target") == a))).isEmpty()

    def contains(self, ids: DataFrame) -> DataFrame:
        """(node_id, found) for each id asked for."""
        own = self.nodes.select("node_id", F.lit(True).alias("found"))
        return ids.toDF("node_id").join(own, "node_id", "left").na.fill(False, ["found"])

    def incident_edges(self, ids: DataFrame, direction: str = "both") -> DataFrame:
        """Edges at the given nodes: those out of them, into them, or both."""
        keep = ids.toDF("__n").distinct()
        ends = {"out": ["source"], "in": ["target"], "both": ["source", "target"]}[direction]
        found = [self.edges.join(keep, self.edges[e] == keep["__n"], "left_semi") for e in ends]
        return found[0] if len(found) == 1 else found[0].unionByName(found[1]).dropDuplicates(["edge_id"])

    def adjacency_list(self, direction: str = "auto") -> DataFrame:
        """(node_id, neighbors) with ascending ids; long lists of hubs are one row, as asked for."""
        near = self.neighbors(direction=direction).groupBy("node_id").agg(F.array_sort(F.collect_list("neighbor_id")).alias("neighbors"))
        return self.nodes.select("node_id").join(near, "node_id", "left").withColumn("neighbors", F.coalesce("neighbors", F.array().cast(near.schema["neighbors"].dataType)))

    def sample(self, k: int, seed: int = 0) -> Graph:
        """k nodes drawn by a seeded hash, and the edges among them."""
        return self.induced(self.nodes.select("node_id").orderBy(F.xxhash64("node_id", F.lit(seed)), "node_id").limit(k))

    def group_by_node_attr(self, attr: str) -> tuple[DataFrame, DataFrame]:
        """Subgraphs by a node attribute: nodes and edges with a ``part`` column; edges have both ends in it."""
        parts = self.nodes.select("node_id", F.col(attr).alias("part"))
        e = self.edges.join(parts.toDF("source", "part"), "source").join(parts.toDF("target", "__q"), "target")
        return self.nodes.withColumn("part", F.col(attr)), e.where(F.col("part").eqNullSafe(F.col("__q"))).drop("__q")

    def group_by_edge_attr(self, attr: str) -> tuple[DataFrame, DataFrame]:
        """Subgraphs by an edge attribute: the endpoints of each value's edges, and these edges."""
        e = self.edges.withColumn("part", F.col(attr))
        ends = e.select("part", F.explode(F.array("source", "target")).alias("node_id")).distinct()
        return ends.join(self.nodes, "node_id"), e

    def expand(self, members: DataFrame, meta_id) -> Graph:
        """The subgraph that a meta-node of ``collapse`` stands for."""
        return self.induced(members.where(F.col("meta_id") == meta_id).select("node_id"))

    def transition(self) -> DataFrame:
        """(source, target, p): the chance of each step of a walk along edges."""
        adj = self.neighbors()
        d = adj.groupBy("node_id").agg(F.count(F.lit(1)).alias("d"))
        return adj.join(d, "node_id").select(F.col("node_id").alias("source"), F.col("neighbor_id").alias("target"), (1.0 / F.col("d")).alias("p"))

    def overlaps(self, others: dict[str, Graph]) -> DataFrame:
        """(name, nodes): how many nodes each of the others shares, where it shares any."""
        named = [g.nodes.select("node_id", F.lit(n).alias("name")) for n, g in others.items()]
        return reduce(DataFrame.unionByName, named).join(self.nodes.select("node_id"), "node_id", "left_semi").groupBy("name").agg(F.count_distinct("node_id").alias("nodes"))

    def partition(self, parts: DataFrame) -> DataFrame:
        """Per part of (node_id, part): nodes, edges inside, density."""
        e = self.edges.join(parts.toDF("source", "p"), "source").join(parts.toDF("target", "q"), "target").where(F.col("p").eqNullSafe(F.col("q")))
        inside = e.groupBy(F.col("p").alias("part")).agg(F.count(F.lit(1)).alias("edges"))
        nodes = parts.toDF("node_id", "part").groupBy("part").agg(F.count(F.lit(1)).alias("nodes"))
        return nodes.join(inside, "part", "left").na.fill(0, ["edges"])

    def collapse(self, parts: DataFrame, node_aggs: dict[str, Column] | None = None, edge_aggs: dict[str, Column] | None = None, min_edges: int = 1, keep_inside: bool = False) -> tuple[Graph, DataFrame]:
        """Each part of (node_id, part) becomes a meta-node; edges between parts become one each.

        Meta-nodes have ``members`` and what ``node_aggs`` makes; meta-edges ``edge_count`` and what
        ``edge_aggs`` makes.  Edges inside a part go, unless they are kept as a loop.  Nodes outside all
        parts stay.  Returns the graph of meta-nodes and the membership (meta_id, node_id).
        """
        p = parts.toDF("node_id", "part")
        members = p.select(F.col("part").alias("meta_id"), "node_id")
        joined = self.nodes.join(p, "node_id")
        meta = joined.groupBy(F.col("part").alias("node_id")).agg(F.count(F.lit(1)).alias("members"), *[c.alias(n) for n, c in (node_aggs or {}).items()])
        e = self.edges.join(p.toDF("source", "__p"), "source", "left").join(p.toDF("target", "__q"), "target", "left")
        e = e.withColumns({"__a": F.coalesce("__p", "source"), "__b": F.coalesce("__q", "target")})
        if not keep_inside:
            e = e.where("__a <> __b")
        a, b = (F.col("__a"), F.col("__b")) if self.directed else (F.least("__a", "__b"), F.greatest("__a", "__b"))
        grouped = e.groupBy(a.alias("source"), b.alias("target")).agg(F.count(F.lit(1)).alias("edge_count"), *[c.alias(n) for n, c in (edge_aggs or {}).items()])
        kept = assign_edge_ids(grouped.where(F.col("edge_count") >= min_edges))
        rest = self.nodes.join(p, "node_id", "left_anti").select("node_id")
        return Graph(meta.unionByName(rest, allowMissingColumns=True), kept, self.directed), members

    # --- local structure ---

    def canonical_edges(self) -> DataFrame:
        """Distinct undirected edges (a < b), without loops."""
        return self.edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()

    def _oriented(self) -> DataFrame:
        """Canonical edges from the end of lower (degree, id) to the higher: no node has many out of it."""
        e = self.canonical_edges()
        d = e.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("d"))
        both = e.join(d.toDF("a", "da"), "a").join(d.toDF("b", "db"), "b")
        up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
        return both.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"))

    def triangles(self) -> DataFrame:
        """(node_id, triangles): each triangle is found once, from its end of least degree."""
        o = cut(self._oriented(), "oriented")
        wedge = o.select("u", F.col("v").alias("x")).join(o.select("u", F.col("v").alias("y")), "u")
        closed = wedge.join(o.select(F.col("u").alias("x"), F.col("v").alias("y")), ["x", "y"], "left_semi")
        count = closed.select(F.explode(F.array("u", "x", "y")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("triangles"))
        return self.nodes.select("node_id").join(count, "node_id", "left").na.fill(0, ["triangles"])

    def clustering(self) -> DataFrame:
        """(node_id, clustering): links among neighbours over pairs of neighbours; 0 below two."""
        d = self.canonical_edges().select(F.explode(F.array("a", "b")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("k"))
        t = self.triangles().join(d, "node_id", "left")
        return t.select("node_id", F.when(F.col("k") > 1, 2.0 * F.col("triangles") / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("clustering"))

    def transitivity(self) -> DataFrame:
        """One row ``transitivity``: three times the triangles over connected triples."""
        d = self.canonical_edges().select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("k"))
        triples = d.agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("triples"))
        t = self.triangles().agg(F.sum("triangles").alias("t"))
        return t.crossJoin(F.broadcast(triples)).select(F.when(F.col("triples") > 0, F.col("t") / F.col("triples")).otherwise(0.0).alias("transitivity"))

    def validate(self) -> DataFrame:
        """(problem, n): null or repeated ids, dangling endpoints, loops, parallel edges."""
        dup = lambda df, k: df.groupBy(k).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("n"))
        count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
        ids = self.nodes.select("node_id")
        parts = {
            "null node id": count(self.nodes.where("node_id IS NULL")),
            "repeated node id": dup(self.nodes, "node_id"),
            "null edge field": count(self.edges.where("edge_id IS NULL OR source IS NULL OR target IS NULL")),
            "repeated edge id": dup(self.edges, "edge_id"),
            "dangling source": count(self.edges.join(ids.toDF("source"), "source", "left_anti")),
            "dangling target": count(self.edges.join(ids.toDF("target"), "target", "left_anti")),
            "self loop": count(self.edges.where("source = target")),
            "parallel edge": count(self.parallel_edges()),
        }
        return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("problem"), "n") for k, df in parts.items()])

    def conform(self) -> Graph:
        """The graph, if ids are unique and endpoints exist; else an error."""
        bad = [r for r in self.validate().where("n > 0").collect() if r["problem"] not in ("self loop", "parallel edge")]
        if bad:
            raise ValueError("; ".join(f"{r['problem']}: {r['n']}" for r in bad))
        return self


def _update(df: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    names = [c for c in updates.columns if c != key]
    out = df.join(updates.select(key, *[F.col(n).alias(f"__{n}") for n in names]), key, "left")
    return out.withColumns({n: F.coalesce(f"__{n}", n) if n in df.columns else F.col(f"__{n}") for n in names}).drop(*[f"__{n}" for n in names])


def assign_edge_ids(edges: DataFrame) -> DataFrame:
    """Edges with dense ids from 0 in the order of their endpoints."""
    return with_position(edges, [F.asc("source"), F.asc("target")], "edge_id")


def merge(first: Graph, second: Graph, strategy: str = "remap", domains: tuple[str, str] = ("a", "b")) -> Graph:
    """Two graphs as one.

    remap: the second's ids start after the first's, ``_domain`` and ``_original_id`` tell where a node
    came from; fail: shared ids are an error; first, second: that graph's row stays where both have the
    id; attributes: as first, but nulls are filled from the second.
    """
    if strategy == "remap":
        top = first.nodes.agg(F.coalesce(F.max("node_id"), F.lit(-1)) + 1).first()[0]
        etop = first.edges.agg(F.coalesce(F.max("edge_id"), F.lit(-1)) + 1).first()[0]
        named = lambda df, d, o: df.withColumns({"_domain": F.lit(d), "_original_id": F.col("node_id"), "node_id": F.col("node_id") + o})
        moved = second.edges.withColumns({"edge_id": F.col("edge_id") + etop, "source": F.col("source") + top, "target": F.col("target") + top})
        return Graph(named(first.nodes, domains[0], 0).unionByName(named(second.nodes, domains[1], top), allowMissingColumns=True), first.edges.unionByName(moved, allowMissingColumns=True), first.directed)
    if strategy == "fail" and not first.nodes.join(second.nodes, "node_id", "left_semi").isEmpty():
        raise ValueError("both graphs have a node of the same id")
    a, b = (second, first) if strategy == "second" else (first, second)
    nodes = a.nodes.unionByName(b.nodes.join(a.nodes, "node_id", "left_anti"), allowMissingColumns=True)
    edges = a.edges.unionByName(b.edges.join(a.edges, "edge_id", "left_anti"), allowMissingColumns=True)
    if strategy == "attributes":
        fill = b.nodes.select("node_id", *[F.col(c).alias(f"__{c}") for c in b.nodes.columns if c != "node_id"])
        names = [c for c in b.nodes.columns if c != "node_id"]
        nodes = nodes.join(fill, "node_id", "left").withColumns({c: F.coalesce(c, f"__{c}") for c in names}).drop(*[f"__{c}" for c in names])
    return Graph(nodes, edges, first.directed)
