"""Graph algorithms as supersteps of joins and aggregates.

Loops cut their lineage in shared storage.  Methods that are sequential by nature (greedy moves, edge
betweenness) run as a kernel on the driver, behind a check of the graph's size.
"""

from __future__ import annotations

import heapq
import random
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.operators import local
from quillgraph.operators import louvain as louvain_blocks
from quillgraph.operators.components import connected_components
from quillgraph.operators.graph import Graph
from quillgraph.plans.loop import iterate
from quillgraph.plans.staging import cut

#: Edges of a graph that the driver's kernels take.
KERNEL_EDGES = 500_000


def pagerank(g: Graph, damping: float = 0.85, rounds: int = 100, tol: float | None = 1e-6, personal: str | None = None, direction: str = "out", local_edges: int | None = None) -> DataFrame:
    """(node_id, rank).  Follows stored directions; rank of sinks is spread evenly.

    Stops when no rank moves by more than ``tol``, or after all rounds (100, unless told; None: only then).  ``personal`` names a node
    attribute that the teleport is in proportion to (the largest, where an id is repeated).  Null node
    ids, and edges an end of which is null or no node, count nowhere.
    """
    known = g.nodes.where("node_id IS NOT NULL")
    known = known.groupBy("node_id").agg(F.max(personal).alias("__p")) if personal else known.select("node_id").distinct()
    g = Graph(known, g.edges, g.directed)
    n = g.nodes.count()
    if not n:
        return g.nodes.select("node_id", F.lit(0.0).alias("rank"))
    if personal:
        total = g.nodes.agg(F.sum("__p")).first()[0] or 0
        base = (F.coalesce(F.col("__p"), F.lit(0)) / F.lit(total) if total else F.lit(1.0 / n)).cast("double")
    else:
        base = F.lit(1.0 / n)
    # the task leaves improper edges out by itself
    small = local.small(g.adjacency(direction).select("node_id", "neighbor_id").toDF("source", "target"), g.nodes, local_edges, base)
    if small is not None:
        return local.one_task(small, local.pagerank(damping, rounds, tol), "node_id bigint, rank double")
    adj = g.proper().adjacency(direction).select("node_id", "neighbor_id")
    out = adj.groupBy("node_id").agg(F.count(F.lit(1)).alias("out"))
    links = cut(adj.join(out, "node_id"), "pagerank")
    nodes = cut(g.nodes.select("node_id", base.alias("base")).join(out, "node_id", "left"), "pagerank")
    state = nodes.select("node_id", F.lit(1.0 / n).alias("rank"))

    def step(ranks: DataFrame, _: int) -> DataFrame:
        sent = links.join(ranks, "node_id").groupBy(F.col("neighbor_id").alias("node_id")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        held = nodes.where("out IS NULL").join(ranks, "node_id").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("sink"))
        new = (1 - damping) * F.col("base") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("sink") / n)
        return nodes.join(sent, "node_id", "left").crossJoin(F.broadcast(held)).select("node_id", new.alias("rank"))

    def settled(old: DataFrame, new: DataFrame) -> bool:
        moved = old.join(new.withColumnRenamed("rank", "new"), "node_id").agg(F.max(F.abs(F.col("rank") - F.col("new")))).first()[0]
        return moved is None or moved <= tol

    return iterate(state, step, rounds, settled if tol is not None else None, label="pagerank")


def bfs(g: Graph, seeds: DataFrame, direction: str = "auto", max_depth: int = 1 << 30) -> DataFrame:
    """(node_id, depth) of every node that a seed reaches."""
    adj = cut(g.neighbors(direction=direction), "bfs")
    known = front = seeds.toDF("node_id").distinct().withColumn("depth", F.lit(0))
    depth = 0
    while depth < max_depth:
        depth += 1
        step = front.join(adj, "node_id").select(F.col("neighbor_id").alias("node_id")).distinct()
        front = cut(step.join(known, "node_id", "left_anti").withColumn("depth", F.lit(depth)), "bfs")
        if front.isEmpty():
            break
        known = cut(known.unionByName(front), "bfs")
    return known


def weighted_edges(g: Graph, weight: str | None, direction: str = "auto", default: float = 1.0, positive: bool = False) -> DataFrame:
    """(source, target, w) in shared storage, the least weight of parallel edges.

    Missing weights count as ``default``; negative ones, and zeros if weights must be positive, are refused.
    """
    w = F.coalesce(F.col(weight).cast("double"), F.lit(default)) if weight else F.lit(1.0)
    e = g.edges.select("source", "target", w.alias("w"))
    flip = e.select(F.col("target").alias("source"), F.col("source").alias("target"), "w")
    direction = ("out" if g.directed else "both") if direction == "auto" else direction
    e = {"out": e, "in": flip, "both": e.unionByName(flip)}[direction]
    e = cut(e.groupBy("source", "target").agg(F.min("w").alias("w")), "weights")
    if weight:
        least = e.agg(F.min("w")).first()[0]
        if least is not None and (least < 0 or positive and least == 0):
            raise ValueError(f"weights must {'be positive' if positive else 'not be negative'}, and one is {least}")
    return e


def sssp(g: Graph, sources: DataFrame, weight: str | None = None, direction: str = "auto", default: float = 1.0, rounds: int = 1 << 30, target=None, bound: str | None = None) -> DataFrame:
    """(node_id, distance, via) by relaxation; ``via`` is the predecessor on a shortest path.

    Missing weights count as ``default``; negative weights are refused.  Only nodes that became nearer
    send on in the next round.  With a ``target``, nodes from which it can't be reached more cheaply than by
    the path found so far send nothing on: ``bound`` names a node attribute that is never more than
    the cost that is left from there (null: 0).
    """
    e = weighted_edges(g, weight, direction, default)
    left = g.nodes.select(F.col("node_id").alias("__n"), F.coalesce(F.col(bound).cast("double"), F.lit(0.0)).alias("__h")) if bound else None
    best = front = cut(sources.toDF("node_id").distinct().select("node_id", F.lit(0.0).alias("distance"), F.lit(None).cast("long").alias("via")), "sssp")
    for _ in range(rounds):
        if target is not None:
            limit = best.where(F.col("node_id") == target).agg(F.min("distance")).first()[0]
            if limit is not None:
                far = front.join(left, front["node_id"] == left["__n"], "left").select(*front.columns, "__h") if bound else front.withColumn("__h", F.lit(0.0))
                front = far.where(F.col("distance") + F.coalesce("__h", F.lit(0.0)) < limit).drop("__h")
        offer = front.join(e, front["node_id"] == e["source"]).groupBy(F.col("target").alias("node_id")).agg(F.min(F.struct((F.col("distance") + F.col("w")).alias("d"), F.col("source").alias("v"))).alias("o"))
        better = offer.join(best.select("node_id", F.col("distance").alias("old")), "node_id", "left").where(F.col("old").isNull() | (F.col("o.d") < F.col("old")))
        front = cut(better.select("node_id", F.col("o.d").alias("distance"), F.col("o.v").alias("via")), "sssp")
        if front.isEmpty():
            break
        best = cut(best.join(front, "node_id", "left_anti").unionByName(front), "sssp")
    return best


def shortest_path(g: Graph, source, target, weight: str | None = None, direction: str = "both", bound: str | None = None) -> list:
    """Nodes of a shortest path (empty if there is none); the trace back reads one row a step."""
    spark = g.nodes.sparkSession
    found = sssp(g, spark.createDataFrame([(source,)], "node_id long"), weight, direction, target=target, bound=bound)
    path, at = [], target
    while True:
        row = found.where(F.col("node_id") == at).first()
        if row is None:
            return []
        path.append(at)
        if row["via"] is None:
            return path[::-1]
        at = row["via"]


def astar(g: Graph, source, target, weight: str | None = None, bound: str | None = None, direction: str = "auto") -> tuple[float | None, list]:
    """Cost and nodes of a cheapest path, (None, []) if there is none.

    ``bound`` names a node attribute that never exceeds the cost left to the target, as A* asks of its
    heuristic; nodes whose distance and bound exceed the best path so far are not expanded.
    """
    path = shortest_path(g, source, target, weight, ("out" if g.directed else "both") if direction == "auto" else direction, bound)
    if not path:
        return None, []
    spark = g.nodes.sparkSession
    steps = spark.createDataFrame(list(zip(path, path[1:], strict=False)), "source long, target long")
    cost = weighted_edges(g, weight, direction).join(F.broadcast(steps), ["source", "target"]).agg(F.sum("w")).first()[0]
    return cost or 0.0, path


def all_paths(g: Graph, source, target, max_length: int, direction: str = "auto") -> DataFrame:
    """(path) simple paths of at most ``max_length`` edges."""
    adj = g.neighbors(direction=direction)
    spark = g.nodes.sparkSession
    front = spark.createDataFrame([([source],)], "path array<long>")
    done = front.where(F.lit(source == target))
    for _ in range(max_length):
        grown = front.join(adj, F.element_at("path", -1) == adj["node_id"]).where(~F.array_contains("path", F.col("neighbor_id")))
        front = cut(grown.select(F.concat("path", F.array("neighbor_id")).alias("path")), "paths")
        done = done.unionByName(front.where(F.element_at("path", -1) == target))
        front = front.where(F.element_at("path", -1) != target)
    return done


def strong_components(g: Graph, rounds: int = 1 << 20) -> DataFrame:
    """(node_id, component): strong components named by their least node.

    Every round colours nodes by the least id that reaches them, then collects, backwards from each
    colour's root, the nodes of its colour that reach the root; these are one component and leave.
    """
    left = g
    done = g.nodes.select("node_id", F.col("node_id").alias("component")).where(F.lit(False))
    for _ in range(rounds):
        nodes = cut(left.nodes.select("node_id"), "scc")
        if nodes.isEmpty():
            break
        edges = cut(left.edges.where("source <> target").select("source", "target").distinct(), "scc")
        colour = _least_reaching(nodes, edges)
        inside = edges.join(colour.toDF("source", "c"), "source").join(colour.toDF("target", "d"), "target").where("c = d").select("source", "target")
        inside = cut(inside, "scc")
        back = bfs(Graph(nodes, inside.withColumn("edge_id", F.lit(0)), True), colour.where("node_id = c").select("node_id"), "in").select("node_id")
        part = cut(colour.join(back, "node_id", "left_semi").select("node_id", F.col("c").alias("component")), "scc")
        done = done.unionByName(part)
        rest = cut(nodes.join(part, "node_id", "left_anti"), "scc")
        left = Graph(nodes, edges.withColumn("edge_id", F.lit(0)), True).induced(rest)
    return done


def _least_reaching(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, c): the least id among a node and all that reach it."""
    state = front = cut(nodes.select("node_id", F.col("node_id").alias("c")), "scc")
    while True:
        offer = front.join(edges, front["node_id"] == edges["source"]).groupBy(F.col("target").alias("node_id")).agg(F.min("c").alias("o"))
        front = cut(offer.join(state, "node_id").where("o < c").select("node_id", F.col("o").alias("c")), "scc")
        if front.isEmpty():
            return state
        state = cut(state.join(front, "node_id", "left_anti").unionByName(front), "scc")


def label_propagation(g: Graph, rounds: int = 20, tol: float = 0.01, seed_attr: str | None = None, self_vote: bool = True, local_edges: int | None = None) -> DataFrame:
    """(node_id, label): synchronous majority of neighbours, ties to the least label.

    Stops when at most ``tol`` of the nodes changed.  A node's own vote counts once, if asked for.  Without a seed
    label a node starts with its id, which is the same label as an equal seed of another node.  Null
    node ids, and edges an end of which is null or no node, count nowhere.
    """
    first = F.coalesce(seed_attr, "node_id") if seed_attr else F.col("node_id")
    known = g.nodes.where("node_id IS NOT NULL")
    g = Graph(known if seed_attr else known.select("node_id").distinct(), g.edges, g.directed)
    # labels travel as doubles here, which are exact below 2**53
    exact = not seed_attr and local_edges != 0 and g.nodes.agg(F.coalesce(F.max(F.abs("node_id")), F.lit(0)) < F.lit(1 << 53)).first()[0]
    small = local.small(g.edges, g.nodes, local_edges, first) if exact else None
    if small is not None:
        return local.one_task(small, local.label_propagation(rounds, tol, self_vote), "node_id bigint, label bigint")
    adj = cut(g.proper().adjacency("both").select("node_id", "neighbor_id"), "lpa")
    n = max(g.nodes.count(), 1)
    state = cut(g.nodes.select("node_id", first.alias("label")), "lpa")

    def step(labels: DataFrame, _: int) -> DataFrame:
        votes = adj.join(labels.withColumnRenamed("node_id", "neighbor_id"), "neighbor_id").select("node_id", "label")
        if self_vote:
            votes = votes.unionByName(labels.select("node_id", "label"))
        count = votes.groupBy("node_id", "label").agg(F.count(F.lit(1)).alias("n"))
        won = count.groupBy("node_id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("won"))
        return labels.join(won, "node_id", "left").select("node_id", F.coalesce("won", "label").alias("label"))

    def settled(old: DataFrame, new: DataFrame) -> bool:
        changed = old.join(new.withColumnRenamed("label", "new"), "node_id").where("label <> new").count()
        return changed <= tol * n

    return iterate(state, step, rounds, settled, label="lpa")


def infomap_majority(g: Graph, rounds: int = 100) -> DataFrame:
    """(node_id, label): neighbour majority without a vote of the node itself, until nothing changes."""
    return label_propagation(g, rounds, 0.0, self_vote=False)


def k_core(g: Graph, k: int) -> DataFrame:
    """(node_id, in_core) by peeling nodes of a degree below k."""
    e = cut(g.canonical_edges(), "k-core")
    while True:
        d = e.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("d"))
        thin = cut(d.where(F.col("d") < k).select("n"), "k-core")
        if thin.isEmpty():
            break
        e = cut(e.join(thin.toDF("a"), "a", "left_anti").join(thin.toDF("b"), "b", "left_anti").select("a", "b"), "k-core")
    core = e.select(F.explode(F.array("a", "b")).alias("node_id")).distinct().withColumn("in_core", F.lit(1))
    return g.nodes.select("node_id").join(core, "node_id", "left").na.fill(0, ["in_core"])


def modularity(g: Graph, parts: DataFrame, weight: str | None = None, resolution: float = 1.0) -> DataFrame:
    """One row ``modularity`` of (node_id, part), edges taken as undirected."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    p = parts.toDF("node_id", "part")
    e = g.edges.select("source", "target", w.alias("w")).join(p.toDF("source", "p"), "source").join(p.toDF("target", "q"), "target")
    inside = e.where("p = q").groupBy(F.col("p").alias("part")).agg(F.sum("w").alias("inside"))
    ends = e.select(F.explode(F.array("p", "q")).alias("part"), "w").groupBy("part").agg(F.sum("w").alias("degree"))
    m = e.agg(F.sum("w").alias("m"))
    x = ends.join(inside, "part", "left").na.fill(0.0, ["inside"]).crossJoin(F.broadcast(m))
    term = F.col("inside") / F.col("m") - resolution * F.pow(F.col("degree") / (2 * F.col("m")), 2)
    return x.agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("modularity"))


def all_distances(g: Graph, sources: DataFrame, direction: str = "auto") -> DataFrame:
    """(seed, node_id, hop, paths): steps and number of shortest paths from every source.

    One frame over all sources; choose the sources in chunks, where nodes squared is too much.
    """
    adj = cut(g.neighbors(direction=direction), "distances")
    known = front = sources.toDF("seed").distinct().select("seed", F.col("seed").alias("node_id"), F.lit(0).alias("hop"), F.lit(1.0).alias("paths"))
    h = 0
    while True:
        h += 1
        step = front.join(adj, "node_id").groupBy("seed", F.col("neighbor_id").alias("node_id")).agg(F.sum("paths").alias("paths"))
        front = cut(step.join(known.select("seed", "node_id"), ["seed", "node_id"], "left_anti").select("seed", "node_id", F.lit(h).alias("hop"), "paths"), "distances")
        if front.isEmpty():
            return known
        known = cut(known.unionByName(front), "distances")


def weighted_distances(g: Graph, sources: DataFrame, weight: str, direction: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(seed, node_id, distance) from every source, and the edges (seed, u, v) on shortest paths.

    Weights must be positive.  Paths that differ by less than a billionth of their length are equally short.
    """
    e = weighted_edges(g, weight, direction, positive=True)
    best = front = cut(sources.toDF("seed").distinct().select("seed", F.col("seed").alias("node_id"), F.lit(0.0).alias("distance")), "distances")
    while True:
        offer = front.join(e, front["node_id"] == e["source"]).groupBy("seed", F.col("target").alias("node_id")).agg(F.min(F.col("distance") + F.col("w")).alias("d"))
        better = offer.join(best.withColumnRenamed("distance", "old"), ["seed", "node_id"], "left").where("old IS NULL OR d < old")
        front = cut(better.select("seed", "node_id", F.col("d").alias("distance")), "distances")
        if front.isEmpty():
            break
        best = cut(best.join(front, ["seed", "node_id"], "left_anti").unionByName(front), "distances")
    there = best.select("seed", F.col("node_id").alias("v"), F.col("distance").alias("end"))
    steps = best.join(e, best["node_id"] == e["source"]).select("seed", F.col("node_id").alias("u"), F.col("target").alias("v"), (F.col("distance") + F.col("w")).alias("via"))
    tight = steps.join(there, ["seed", "v"]).where(F.abs(F.col("via") - F.col("end")) <= 1e-9 * F.col("end"))
    return best, cut(tight.select("seed", "u", "v"), "distances")


def _spread(tight: DataFrame, start: DataFrame, here: str, there: str) -> DataFrame:
    """(seed, node_id, x): values (seed, node_id, x) sent along the edges of shortest paths, summed over all
    numbers of steps."""
    front, total = start, [start]
    while True:
        front = cut(front.join(tight, (front["seed"] == tight["seed"]) & (front["node_id"] == tight[here])).groupBy(tight["seed"], F.col(there).alias("node_id")).agg(F.sum("x").alias("x")), "paths")
        if front.isEmpty():
            break
        total.append(front)
    out = total[0]
    for t in total[1:]:
        out = out.unionByName(t)
    return cut(out.groupBy("seed", "node_id").agg(F.sum("x").alias("x")), "paths")


def closeness(g: Graph, harmonic: bool = True, sources: DataFrame | None = None, direction: str = "auto", weight: str | None = None) -> DataFrame:
    """(node_id, closeness): sum of 1/d, or reachable nodes over the sum of d; d in steps or in weight."""
    sources = g.nodes.select("node_id") if sources is None else sources
    if weight:
        d = weighted_distances(g, sources, weight, direction)[0].where("seed <> node_id")
    else:
        d = all_distances(g, sources, direction).where("hop > 0").withColumnRenamed("hop", "distance")
    d = d.groupBy(F.col("seed").alias("node_id"))
    value = d.agg((F.sum(1.0 / F.col("distance")) if harmonic else F.count(F.lit(1)) / F.sum("distance")).alias("closeness"))
    return sources.toDF("node_id").join(value, "node_id", "left").na.fill(0.0, ["closeness"])


def betweenness(g: Graph, normalized: bool = True, sources: DataFrame | None = None, direction: str = "auto", weight: str | None = None) -> DataFrame:
    """(node_id, betweenness) by Brandes' accumulation, all sources at once, from the farthest level in.

    With weights, paths are counted along the edges of shortest paths, step by step, and the shares of
    dependency come back along the same edges.
    """
    sources = g.nodes.select("node_id") if sources is None else sources
    if weight:
        best, tight = weighted_distances(g, sources, weight, direction)
        paths = _spread(tight, best.where("seed = node_id").select("seed", "node_id", F.lit(1.0).alias("x")), "u", "v")
        # c = (1 + dependency) / paths solves c(u) = 1 / paths(u) + sum of c(v) over the edges out of u
        share = _spread(tight, paths.select("seed", "node_id", (1.0 / F.col("x")).alias("x")), "v", "u")
        every = share.withColumnRenamed("x", "c").join(paths, ["seed", "node_id"]).select("seed", "node_id", (F.col("c") * F.col("x") - 1.0).alias("delta"))
    else:
        every = _dependencies(g, sources, direction)
    n = g.nodes.count()
    scale = 0.5 * ((2.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0) if normalized else 1.0)
    total = every.where("seed <> node_id").groupBy("node_id").agg((F.sum("delta") * scale).alias("betweenness"))
    return g.nodes.select("node_id").join(total, "node_id", "left").na.fill(0.0, ["betweenness"])


def _dependencies(g: Graph, sources: DataFrame, direction: str) -> DataFrame:
    """(seed, node_id, delta) over paths of fewest steps."""
    known = cut(all_distances(g, sources, direction), "betweenness")
    adj = cut(g.neighbors(direction=direction), "betweenness")
    last = known.agg(F.max("hop")).first()[0] or 0
    delta = known.where(F.col("hop") == last).select("seed", "node_id", F.lit(0.0).alias("delta"))
    every = delta
    for h in range(last, 0, -1):
        far = known.where(F.col("hop") == h).join(delta, ["seed", "node_id"]).select("seed", F.col("node_id").alias("neighbor_id"), ((1.0 + F.col("delta")) / F.col("paths")).alias("x"))
        near = known.where(F.col("hop") == h - 1).select("seed", "node_id", "paths")
        sent = far.join(adj, "neighbor_id").join(near, ["seed", "node_id"]).groupBy("seed", "node_id").agg(F.sum(F.col("x") * F.col("paths")).alias("delta"))
        delta = cut(near.select("seed", "node_id").join(sent, ["seed", "node_id"], "left").na.fill(0.0, ["delta"]), "betweenness")
        every = every.unionByName(delta)
    return every


def modularity_gains(g: Graph, parts: DataFrame, weight: str | None = None, resolution: float = 1.0) -> DataFrame:
    """(node_id, part, gain): what modularity gains if a node of (node_id, part) moves to a part that it has
    an edge to; edges count as undirected, loops for the degree only."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    p = parts.toDF("node_id", "part")
    e = g.edges.select("source", "target", w.alias("w"))
    ends = e.select(F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("target").alias("b")), F.struct(F.col("target").alias("a"), F.col("source").alias("b")))).alias("x"), "w").select("x.a", "x.b", "w")
    degree = ends.groupBy(F.col("a").alias("node_id")).agg(F.sum("w").alias("k"))
    known = p.join(degree, "node_id", "left").na.fill(0.0, ["k"])
    size = known.groupBy("part").agg(F.sum("k").alias("size"))
    links = ends.where("a <> b").join(p.toDF("b", "part"), "b").groupBy(F.col("a").alias("node_id"), "part").agg(F.sum("w").alias("links"))
    own = known.withColumnRenamed("part", "own").join(size.toDF("own", "own_size"), "own").join(links.toDF("node_id", "own", "own_links"), ["node_id", "own"], "left").na.fill(0.0, ["own_links"])
    m = e.agg(F.sum("w").alias("m"))
    x = links.join(own, "node_id").where("part <> own").join(size, "part").crossJoin(F.broadcast(m))
    gain = (F.col("links") - F.col("own_links")) / F.col("m") - resolution * F.col("k") * (F.col("size") - F.col("own_size") + F.col("k")) / (2 * F.col("m") * F.col("m"))
    return x.select("node_id", "part", gain.alias("gain"))


def louvain_distributed(g: Graph, rounds: int | None = None, resolution: float = 1.0, weight: str | None = None) -> DataFrame:
    """(node_id, community) by parallel moves, for graphs beyond the driver's kernels; communities are named
    by their least node.

    In each round a share of the nodes, drawn by a hash, half of them at first, moves to the part of the
    highest gain (ties to the least part).  A round that doesn't raise modularity is undone and halves the
    share.  A level ends where no single move gains more than 1e-12 (or after ``rounds``, if they are given);
    communities then become nodes, and levels go on until one moves nothing.  Levels of up to
    ``louvain.ARRAY_NODES`` nodes run over packed blocks of edges, larger ones as joins.  Not the same
    communities as ``louvain``, whose moves are one after another.
    """
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    nodes = cut(g.nodes.where("node_id IS NOT NULL").select("node_id").distinct(), "louvain")
    edges, member = g.edges.select("source", "target", w.alias("w")), None
    while nodes.count() > louvain_blocks.ARRAY_NODES:
        if member is None:
            edges = cut(Graph(nodes, edges).proper().edges, "louvain")
        parts = _parallel_moves(Graph(nodes, edges), rounds, resolution)
        if parts is None:
            return nodes.select("node_id", F.col("node_id").alias("community")) if member is None else member
        least = parts.groupBy("part").agg(F.min("node_id").alias("least"))
        parts = cut(parts.join(least, "part").select("node_id", F.col("least").alias("part")), "louvain")
        member = parts.toDF("node_id", "community") if member is None else cut(member.join(parts.toDF("community", "part"), "community").select("node_id", F.col("part").alias("community")), "louvain")
        e = edges.join(parts.toDF("source", "a"), "source").join(parts.toDF("target", "b"), "target")
        edges = cut(e.groupBy(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target")).agg(F.sum("w").alias("w")), "louvain")
        nodes = cut(parts.select(F.col("part").alias("node_id")).distinct(), "louvain")
    found = louvain_blocks.communities(nodes, edges, resolution, rounds)
    return found if member is None else member.join(found.toDF("community", "last"), "community").select("node_id", F.col("last").alias("community"))


def _parallel_moves(level: Graph, rounds: int | None, resolution: float) -> DataFrame | None:
    """(node_id, part) where no single move gains, by joins; None if nothing moves."""
    start = level.nodes.select("node_id", F.col("node_id").alias("part"))

    def scan(parts):
        parts = start if parts is None else parts
        best = modularity_gains(level, parts, "w", resolution).where("gain > 1e-12").groupBy("node_id").agg(F.min(F.struct((-F.col("gain")).alias("g"), F.col("part").alias("to"))).alias("b"))
        best = cut(best.select("node_id", "b.to", "b.g"), "louvain")
        return modularity(level, parts, "w", resolution).first()[0], best, best.count()

    def draw(best, n, share, k):
        picked = cut(best.where(F.pmod(F.xxhash64("node_id", F.lit(k)), F.lit(1 << 40)) < int(share * (1 << 40))), "louvain")
        count = picked.count()
        return (picked, count == 1) if count else (cut(best.orderBy("g", "node_id").limit(1), "louvain"), True)

    def move(parts, picked):
        parts = start if parts is None else parts
        return cut(parts.join(picked, "node_id", "left").select("node_id", F.coalesce("to", "part").alias("part")), "louvain")

    return louvain_blocks.climb(scan, move, draw, rounds)


def random_walks(g: Graph, starts: DataFrame, length: int, restart: float = 0.0, seed: int = 0, direction: str = "auto") -> DataFrame:
    """(walk, step, node_id): from every start, each step to a neighbour drawn by a seeded hash."""
    adj = g.neighbors(direction=direction).groupBy("node_id").agg(F.array_sort(F.collect_set("neighbor_id")).alias("next"))
    at = starts.toDF("node_id").distinct().select(F.col("node_id").alias("walk"), "node_id")
    out = at.select("walk", F.lit(0).alias("step"), "node_id")
    for k in range(1, length + 1):
        draw = F.pmod(F.xxhash64("walk", F.lit(k), F.lit(seed)), F.lit(1 << 30))
        home = F.pmod(F.xxhash64("walk", F.lit(k), F.lit(seed), F.lit("home")), F.lit(1 << 30)) < int(restart * (1 << 30))
        moved = at.join(adj, "node_id", "left").select("walk", F.when(home, F.col("walk")).otherwise(F.get("next", F.pmod(draw, F.size("next")).cast("int"))).alias("node_id"))
        at = cut(moved.where("node_id IS NOT NULL"), "walks")
        out = out.unionByName(at.select("walk", F.lit(k).alias("step"), "node_id"))
    return out


# --- kernels on the driver -----------------------------------------------------------------------


def _local(g: Graph, weight: str | None = None) -> tuple[list, list[tuple]]:
    """Nodes and (source, target, weight) of a graph that is small enough for the driver."""
    for what, df in (("edges", g.edges), ("nodes", g.nodes)):
        if df.limit(KERNEL_EDGES + 1).count() > KERNEL_EDGES:
            raise ValueError(f"this method takes graphs of up to {KERNEL_EDGES} {what}")
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    nodes = [r[0] for r in g.nodes.select("node_id").orderBy("node_id").collect()]
    return nodes, [tuple(r) for r in g.edges.orderBy("edge_id").select("source", "target", w).collect()]


def _frame(g: Graph, rows: list[tuple], name: str, kind: str) -> DataFrame:
    return g.nodes.sparkSession.createDataFrame(rows, f"node_id {g.nodes.schema['node_id'].dataType.simpleString()}, {name} {kind}")


def dfs(g: Graph, start, direction: str = "auto") -> DataFrame:
    """(node_id, order): depth-first preorder, neighbours in id order."""
    nodes, edges = _local(g)
    direction = ("out" if g.directed else "both") if direction == "auto" else direction
    near = defaultdict(set)
    for a, b, _ in edges:
        if direction != "in":
            near[a].add(b)
        if direction != "out":
            near[b].add(a)
    order, stack = {}, [start]
    while stack:
        x = stack.pop()
        if x not in order:
            order[x] = len(order)
            stack += sorted((y for y in near[x] if y not in order), reverse=True)
    return _frame(g, list(order.items()), "order", "int")


def _greedy(nodes: list, edges: list[tuple], resolution: float, rounds: int) -> dict:
    """Greedy moves to the neighbouring community of the highest gain, nodes in id order."""
    near: dict = defaultdict(lambda: defaultdict(float))
    degree: dict = defaultdict(float)
    for a, b, w in edges:
        degree[a] += w
        degree[b] += w
        if a != b:
            near[a][b] += w
            near[b][a] += w
    m2 = sum(degree.values())
    part = {x: i for i, x in enumerate(nodes)}
    total = {i: degree[x] for x, i in part.items()}
    for _ in range(rounds):
        moved = False
        for x in nodes:
            old, weights = part[x], defaultdict(float)
            for y, w in near[x].items():
                weights[part[y]] += w
            total[old] -= degree[x]
            gain = lambda c: weights.get(c, 0.0) - resolution * total[c] * degree[x] / m2  # noqa: B023, E731
            best, value = old, gain(old)
            for c in sorted(weights):
                if gain(c) > value + 1e-9:
                    best, value = c, gain(c)
            total[best] += degree[x]
            if best != old:
                part[x], moved = best, True
        if not moved:
            break
    return part


def louvain(g: Graph, rounds: int = 20, resolution: float = 1.0, weight: str | None = None) -> DataFrame:
    """(node_id, community): greedy modularity moves, communities then merged level by level."""
    nodes, edges = _local(g, weight)
    part = {x: x for x in nodes}
    level_nodes, level_edges = nodes, edges
    while True:
        found = _greedy(level_nodes, level_edges, resolution, rounds)
        if len(set(found.values())) == len(level_nodes):
            break
        part = {x: found[p] for x, p in part.items()}
        merged: dict = defaultdict(float)
        for a, b, w in level_edges:
            merged[tuple(sorted((found[a], found[b])))] += w
        level_edges = [(a, b, w) for (a, b), w in sorted(merged.items())]
        level_nodes = sorted(set(found.values()))
    names = {c: i for i, c in enumerate(dict.fromkeys(part[x] for x in nodes))}
    return _frame(g, [(x, names[part[x]]) for x in nodes], "community", "int")


def leiden(g: Graph, rounds: int = 20, resolution: float = 1.0, weight: str | None = None) -> DataFrame:
    """(node_id, community): as louvain, and communities that fell apart are split (in Spark)."""
    found = cut(louvain(g, rounds, resolution, weight), "leiden")
    e = g.edges.select("source", "target").join(found.toDF("source", "p"), "source").join(found.toDF("target", "q"), "target").where("p = q")
    comp = connected_components(e).withColumnRenamed("node", "node_id")
    return g.nodes.select("node_id").join(comp, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("community"))


def girvan_newman(g: Graph, max_levels: int = 10, threshold: float = 1e-4, weight: str | None = None) -> DataFrame:
    """(node_id, community): removes the edge of highest betweenness until modularity falls; best split.

    With a weight, which must be positive, paths are shortest by the sum of weights (the least of parallel
    edges); modularity counts edges.
    """
    nodes, edges = _local(g, weight)
    if weight and min((w for _, _, w in edges), default=1.0) <= 0:
        raise ValueError("weights must be positive")
    cost: dict = {}
    for a, b, w in edges:
        if a != b:
            k = tuple(sorted((a, b)))
            cost[k] = min(w, cost.get(k, w))
    left = set(cost)
    degree = Counter(x for e in left for x in e)
    m = max(len(left), 1)

    def split(es: set) -> dict:
        near = defaultdict(list)
        for a, b in es:
            near[a].append(b)
            near[b].append(a)
        part: dict = {}
        for x in nodes:
            if x not in part:
                queue = [x]
                part[x] = x
                while queue:
                    for z in near[queue.pop()]:
                        if z not in part:
                            part[z] = x
                            queue.append(z)
        return part

    def quality(part: dict, es: set) -> float:
        inside, total = Counter(), Counter()
        for a, b in es:
            inside[part[a]] += part[a] == part[b]
        for x, d in degree.items():
            total[part[x]] += d
        return sum(inside[c] / m - (total[c] / (2 * m)) ** 2 for c in total)

    best = split(left)
    score, levels = quality(best, left), 0
    last = len(set(best.values()))
    while left and levels < max_levels:
        between: Counter = Counter()
        near = defaultdict(list)
        for a, b in left:
            near[a].append(b)
            near[b].append(a)
        for s in nodes:
            dist, paths, order, heap, before = {s: 0.0}, Counter({s: 1}), [], [(0.0, s)], defaultdict(list)
            settled: set = set()
            while heap:
                d, x = heapq.heappop(heap)
                if x in settled:
                    continue
                settled.add(x)
                order.append(x)
                for y in near[x]:
                    to = d + (cost[tuple(sorted((x, y)))] if weight else 1.0)
                    if y not in dist or to < dist[y] - 1e-9 * to:
                        dist[y], paths[y], before[y] = to, paths[x], [x]
                        heapq.heappush(heap, (to, y))
                    elif y not in settled and abs(to - dist[y]) <= 1e-9 * to:
                        paths[y] += paths[x]
                        before[y].append(x)
            flow: Counter = Counter()
            for y in reversed(order):
                for x in before[y]:
                    share = paths[x] / paths[y] * (1 + flow[y])
                    flow[x] += share
                    between[tuple(sorted((x, y)))] += share
        left.discard(max(sorted(between), key=lambda e: between[e]))
        part = split(left)
        if len(set(part.values())) > last:
            last = len(set(part.values()))
            levels += 1
            q = quality(part, left)
            if q > score:
                best, score = part, q
            elif q < score - threshold:
                break
    names = {c: i for i, c in enumerate(dict.fromkeys(best[x] for x in nodes))}
    return _frame(g, [(x, names[best[x]]) for x in nodes], "community", "int")


def k_shortest_paths(g: Graph, source, target, k: int, weight: str | None = None) -> list[tuple[float, list]]:
    """Yen's k shortest simple paths: (cost, nodes), cheapest first."""
    _, edges = _local(g, weight)
    near: dict = defaultdict(dict)
    for a, b, w in edges:
        near[a][b] = min(w, near[a].get(b, w))
        if not g.directed:
            near[b][a] = min(w, near[b].get(a, w))

    def cheapest(start, banned_nodes: set, banned_edges: set):
        heap, seen = [(0.0, [start])], set()
        while heap:
            d, path = heapq.heappop(heap)
            x = path[-1]
            if x == target:
                return d, path
            if x in seen:
                continue
            seen.add(x)
            for y, w in near[x].items():
                if y not in seen and y not in banned_nodes and (x, y) not in banned_edges:
                    heapq.heappush(heap, (d + w, [*path, y]))
        return None

    cost = lambda p: sum(near[a][b] for a, b in zip(p, p[1:], strict=False))
    first = cheapest(source, set(), set())
    found, spare = ([first] if first else []), []
    while found and len(found) < k:
        last = found[-1][1]
        for i in range(len(last) - 1):
            root = last[: i + 1]
            banned = {(p[i], p[i + 1]) for _, p in found if p[: i + 1] == root and len(p) > i + 1}
            got = cheapest(root[-1], set(root[:-1]), banned)
            if got:
                path = root[:-1] + got[1]
                item = (cost(path), path)
                if item not in spare and item not in found:
                    heapq.heappush(spare, item)
        if not spare:
            break
        found.append(heapq.heappop(spare))
    return found


def barabasi_albert_edges(n: int, m: int, seed: int = 0) -> list[tuple[int, int]]:
    """Preferential attachment: each new node picks m earlier ones in proportion to their degree."""
    rng, ends, out = random.Random(seed), list(range(m)), []
    for x in range(m, n):
        chosen: set = set()
        while len(chosen) < min(m, x):
            chosen.add(rng.choice(ends))
        for y in sorted(chosen):
            out.append((x, y))
            ends += [x, y]
    return out


def top_k(df: DataFrame, value: str, k: int, key: str = "node_id") -> DataFrame:
    """The k highest values with their rank from 0, ties by key."""
    top = df.orderBy(F.desc(value), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), key)) - 1)  # k rows
