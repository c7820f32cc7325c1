"""Named steps and pipelines of steps given as data.

A pipeline is a list of ``{"id": ..., "params": {...}}``.  Its state has node variables (columns of one frame),
edge variables (columns of another) and scalars (Python numbers, or columns that all rows share).  ``validate``
checks a pipeline before anything runs: unknown steps, missing parameters, variables used before they exist.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import scalar
from quillgraph.functions.expr import compile_expression
from quillgraph.operators import algorithms as A
from quillgraph.operators.builder import neighbor_aggregate
from quillgraph.operators.graph import Graph
from quillgraph.plans.ordering import with_position
from quillgraph.plans.staging import cut


@dataclass
class State:
    graph: Graph
    nodes: DataFrame
    edges: DataFrame
    scalars: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Step:
    run: Callable[..., None]
    needs: tuple[str, ...]  # parameters
    reads: tuple[str, ...]  # parameters that name variables which must exist
    writes: tuple[str, ...]  # parameters that name variables which the step makes


STEPS: dict[str, Step] = {}


def step(name: str, needs: str = "", reads: str = "", writes: str = "target"):
    def add(f):
        STEPS[name] = Step(f, tuple(needs.split()) + tuple(reads.split()) + tuple(writes.split()), tuple(reads.split()), tuple(writes.split()))
        return f

    return add


def _value(s: State, x) -> Column:
    """A node variable, a scalar, or a number."""
    if isinstance(x, str):
        return F.col(x) if x in s.nodes.columns else F.lit(s.scalars[x])
    return F.lit(x)


def _put(s: State, name: str, c: Column) -> None:
    s.nodes = s.nodes.withColumn(name, c)


def _join(s: State, name: str, made: DataFrame, column: str, default=None) -> None:
    s.nodes = s.nodes.drop(name).join(made.select("node_id", F.col(column).alias(name)), "node_id", "left")
    if default is not None:
        s.nodes = s.nodes.withColumn(name, F.coalesce(name, F.lit(default)))


# --- variables ---


@step("core.init_nodes", "value")
def _(s, target, value):
    _put(s, target, F.lit(value))


@step("core.init_nodes_with_index")
def _(s, target):
    s.nodes = with_position(s.nodes.drop(target), [F.asc("node_id")], target)


@step("core.init_scalar", "value")
def _(s, target, value):
    s.scalars[target] = value


@step("core.graph_node_count")
def _(s, target):
    s.scalars[target] = s.graph.nodes.count()


@step("core.graph_edge_count")
def _(s, target):
    s.scalars[target] = s.graph.edges.count()


@step("core.init_edges", "value")
def _(s, target, value):
    s.edges = s.edges.withColumn(target, F.lit(value))


@step("core.load_node_attr", "attr")
def _(s, target, attr, default=0):
    _join(s, target, s.graph.nodes, attr, default)


@step("core.load_edge_attr", "attr")
def _(s, target, attr, default=0):
    own = s.graph.edges.select("edge_id", F.coalesce(attr, F.lit(default)).alias(target))
    s.edges = s.edges.drop(target).join(own, "edge_id")


@step("core.attach_node_attr", "attr", "source", "")
def _(s, source, attr):
    s.graph = s.graph.set_node_attrs(s.nodes.select("node_id", F.col(source).alias(attr)))


@step("core.attach_edge_attr", "attr", "source", "")
def _(s, source, attr):
    s.graph = s.graph.set_edge_attrs(s.edges.select("edge_id", F.col(source).alias(attr)))


@step("core.update_in_place", "", "source")
@step("alias", "", "source")
def _(s, source, target):
    _put(s, target, F.col(source))


# --- arithmetic ---


def _binary(name: str, f: Callable[[Column, Column], Column]) -> None:
    STEPS[f"core.{name}"] = Step(lambda s, left, right, target: _put(s, target, f(_value(s, left), _value(s, right))), ("left", "right", "target"), (), ("target",))


for _name, _f in {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": scalar.safe_div, "pow": F.pow, "min": F.least, "max": F.greatest}.items():
    _binary(_name, _f)

for _name, _g in {"abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.ln, "recip": scalar.recip}.items():
    STEPS[f"core.{_name}"] = Step(lambda s, source, target, f=_g: _put(s, target, f(F.col(source))), ("source", "target"), ("source",), ("target",))


@step("core.compare", "op right", "left")
def _(s, left, op, right, target):
    _put(s, target, scalar.compare(F.col(left), op, _value(s, right)))


@step("core.where", "then otherwise", "mask")
def _(s, mask, then, otherwise, target):
    _put(s, target, scalar.where(F.col(mask), _value(s, then), _value(s, otherwise)))


@step("core.clip", "low high", "source")
def _(s, source, low, high, target):
    _put(s, target, scalar.clip(source, low, high))


@step("core.fused_axpy", "a x y")
def _(s, a, x, y, target):
    _put(s, target, _value(s, a) * _value(s, x) + _value(s, y))


@step("core.fused_madd", "a b c")
def _(s, a, b, c, target):
    _put(s, target, _value(s, a) * _value(s, b) + _value(s, c))


@step("core.map_nodes", "expr")
def _(s, expr, target):
    plan, t = compile_expression(expr), s.nodes
    for var, how, out in plan.neighbor:
        t = neighbor_aggregate(s.graph, t, var, how, out)
    s.nodes = t.withColumn(target, plan.column).drop(*[out for _, _, out in plan.neighbor])


# --- aggregates ---

_REDUCE = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "median": F.median, "mode": lambda c: F.mode(c, True)}


@step("core.reduce_nodes", "how", "source")
@step("core.reduce_scalar", "how", "source")
def _(s, source, how, target):
    s.scalars[target] = s.nodes.agg(_REDUCE[how](source)).first()[0] or 0


for _how in ("std", "median", "mode"):
    STEPS[f"core.{_how}"] = Step(lambda s, source, target, how=_how: STEPS["core.reduce_scalar"].run(s, source, how, target), ("source", "target"), ("source",), ("target",))


@step("core.quantile", "q", "source")
def _(s, source, q, target):
    s.scalars[target] = s.nodes.agg(F.percentile(source, q)).first()[0]


@step("core.entropy", "", "source")
def _(s, source, target):
    from quillgraph.operators.builder import entropy

    s.scalars[target] = entropy(s.nodes, source).first()[0]


@step("core.broadcast_scalar", "", "source")
def _(s, source, target):
    _put(s, target, F.lit(s.scalars[source]))


@step("core.neighbor_agg", "how", "source")
def _(s, source, how, target, direction="in", weight=None):
    s.nodes = neighbor_aggregate(s.graph, s.nodes, source, how, target, direction, weight)


@step("core.collect_neighbor_values", "", "source")
def _(s, source, target, include_self=False):
    s.nodes = neighbor_aggregate(s.graph, s.nodes, source, "list", target)
    own = F.array(F.col(source)) if include_self else F.array().cast(s.nodes.schema[target].dataType)
    _put(s, target, F.concat(F.coalesce(target, F.array().cast(s.nodes.schema[target].dataType)), own))


@step("core.mode_list", "", "source")
def _(s, source, target):
    """The most frequent value of each list, ties to the least; null for an empty list."""
    n = s.nodes.select("node_id", F.explode(source).alias("x")).groupBy("node_id", "x").agg(F.count(F.lit(1)).alias("n"))
    _join(s, target, n.groupBy("node_id").agg(F.min_by("x", F.struct(-F.col("n"), F.col("x"))).alias("m")), "m")


@step("core.neighbor_mode_update", "", "source")
@step("core.label_propagate_step", "", "source")
def _(s, source, target):
    t = neighbor_aggregate(s.graph, s.nodes, source, "mode", "__m")
    s.nodes = t.withColumn(target, F.coalesce("__m", source)).drop("__m")


@step("graph.fused_neighbor_mul_agg", "", "values multipliers")
def _(s, values, multipliers, target):
    _put(s, "__p", F.col(values) * F.col(multipliers))
    s.nodes = neighbor_aggregate(s.graph, s.nodes, "__p", "sum", target).drop("__p")


@step("core.normalize_values", "", "source")
@step("core.normalize_node_values", "", "source")
def _(s, source, target, how="sum"):
    c = F.col(source).cast("double")
    one = s.nodes.agg(F.sum(c).alias("__s"), F.max(c).alias("__h"), F.min(c).alias("__l"))
    value = {"sum": scalar.safe_div(c, F.col("__s")), "max": scalar.safe_div(c, F.col("__h")), "minmax": scalar.safe_div(c - F.col("__l"), F.col("__h") - F.col("__l"))}[how]
    s.nodes = s.nodes.crossJoin(F.broadcast(one)).withColumn(target, value).drop("__s", "__h", "__l")


@step("core.standardize", "", "source")
def _(s, source, target):
    one = s.nodes.agg(F.avg(source).alias("__m"), F.stddev_pop(source).alias("__d"))
    s.nodes = s.nodes.crossJoin(F.broadcast(one)).withColumn(target, scalar.safe_div(F.col(source) - F.col("__m"), F.col("__d"))).drop("__m", "__d")


# --- structure ---


@step("core.node_degree")
def _(s, target):
    _join(s, target, s.graph.degree("out" if s.graph.directed else "all"), "degree", 0)


@step("core.weighted_degree", "weight")
def _(s, weight, target):
    _join(s, target, s.graph.weighted_degree(weight), "weighted_degree", 0.0)


@step("core.k_core_mark", "k")
def _(s, k, target):
    _join(s, target, A.k_core(s.graph, k), "in_core", 0)


@step("core.triangle_count")
def _(s, target):
    _join(s, target, s.graph.triangles(), "triangles", 0)


@step("core.edge_weight_sum", "weight")
def _(s, weight, target):
    s.scalars[target] = s.graph.edges.agg(F.sum(weight)).first()[0] or 0.0


@step("core.edge_weight_scale", "factor", "source")
def _(s, source, factor, target):
    s.edges = s.edges.withColumn(target, F.col(source) * factor)


@step("core.sort_nodes_by_attr", "", "source")
def _(s, source, target, ascending=True):
    s.nodes = with_position(s.nodes.drop(target), [F.asc(source) if ascending else F.desc(source), F.asc("node_id")], target)


@step("core.top_k", "k", "source")
def _(s, source, k, target):
    _join(s, target, A.top_k(s.nodes, source, k), "rank")


@step("core.filter_nodes_by_attr", "predicate", "", "")
def _(s, predicate):
    s.graph = s.graph.filter_nodes(predicate)
    s.nodes = s.nodes.join(s.graph.nodes.select("node_id"), "node_id", "left_semi")
    s.edges = s.edges.join(s.graph.edges.select("edge_id"), "edge_id", "left_semi")


@step("core.filter_edges_by_attr", "predicate", "", "")
def _(s, predicate):
    kept = s.graph.filter_edges(predicate).edges
    s.graph = Graph(s.graph.nodes, kept, s.graph.directed)
    s.edges = s.edges.join(kept.select("edge_id"), "edge_id", "left_semi")


@step("core.reservoir_sample", "k")
@step("core.sample_nodes", "k")
def _(s, k, target, seed=0):
    """1 for k nodes drawn by a seeded hash, else 0."""
    drawn = s.nodes.select("node_id").orderBy(F.xxhash64("node_id", F.lit(seed)), "node_id").limit(k).withColumn("one", F.lit(1))
    _join(s, target, drawn, "one", 0)


@step("core.sample_edges", "k")
def _(s, k, target, seed=0):
    drawn = s.edges.select("edge_id").orderBy(F.xxhash64("edge_id", F.lit(seed)), "edge_id").limit(k).withColumn(target, F.lit(1))
    s.edges = s.edges.drop(target).join(drawn, "edge_id", "left").na.fill(0, [target])


@step("core.shortest_path_map", "", "source")
def _(s, source, target, weight=None):
    """Distances from the nodes where a variable is not 0; null where there is no path."""
    _join(s, target, A.sssp(s.graph, s.nodes.where(F.col(source) != 0).select("node_id"), weight), "distance")


@step("core.random_walk", "length")
def _(s, length, target, restart=0.0, seed=0):
    """The nodes of a walk from every node."""
    w = A.random_walks(s.graph, s.nodes.select("node_id"), length, restart, seed)
    path = w.groupBy(F.col("walk").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "node_id"))), lambda x: x["node_id"]).alias("p"))
    _join(s, target, path, "p")


@step("core.community_seed")
def _(s, target, how="singleton", k=2, seed=0):
    """singleton: a community each; hubs: the tenth of highest degree, others -1; random: one of k."""
    if how == "hubs":
        d = s.graph.degree()
        high = d.agg(F.percentile("degree", 0.9)).first()[0]
        _join(s, target, d.select("node_id", F.when(F.col("degree") >= high, F.col("node_id")).otherwise(-1).alias("c")), "c")
    else:
        _put(s, target, F.col("node_id") if how == "singleton" else F.pmod(F.xxhash64("node_id", F.lit(seed)), F.lit(k)))


@step("core.modularity_gain", "", "source")
def _(s, source, target):
    """Links to the other community that a node has most links to, over twice the edges."""
    own = s.nodes.select(F.col("node_id"), F.col(source).alias("c"))
    adj = s.graph.adjacency("both").join(own, "node_id").join(own.toDF("neighbor_id", "d"), "neighbor_id").where("c <> d")
    most = adj.groupBy("node_id", "d").agg(F.count(F.lit(1)).alias("n")).groupBy("node_id").agg(F.max("n").alias("n"))
    m = max(s.graph.edges.count(), 1)
    _join(s, target, most.select("node_id", (F.col("n") / (2.0 * m)).alias("g")), "g", 0.0)


@step("core.flow_update", "", "flow delta")
def _(s, flow, delta, target):
    s.edges = s.edges.withColumn(target, F.coalesce(flow, F.lit(0.0)) + F.coalesce(delta, F.lit(0.0)))


@step("core.residual_capacity", "", "capacity flow")
def _(s, capacity, flow, target):
    """Capacity less flow where that is positive, else null."""
    left = F.coalesce(capacity, F.lit(0.0)) - F.coalesce(flow, F.lit(0.0))
    s.edges = s.edges.withColumn(target, F.when(left > 0, left))


@step("graph.neighbors")
def _(s, target, direction="auto"):
    """Ascending ids of each node's neighbours."""
    _join(s, target, s.graph.adjacency_list(direction), "neighbors")


@step("graph.subgraph", "", "mask", "")
def _(s, mask):
    """Goes on with the nodes whose mask isn't 0, and the edges among them."""
    kept = cut(s.nodes.where(F.col(mask).cast("int") != 0), "steps")
    s.graph = s.graph.induced(kept.select("node_id"))
    s.nodes = kept
    s.edges = s.edges.join(s.graph.edges.select("edge_id"), "edge_id", "left_semi")


@step("graph.connected_components")
def _(s, target):
    _join(s, target, s.graph.components(), "component")


@step("attr.groupby", "how", "source labels")
def _(s, source, labels, how, target):
    """An aggregate of a variable over all nodes of the same label."""
    one = s.nodes.groupBy(F.col(labels).alias("__l")).agg(_REDUCE[how](source).alias("__v"))
    s.nodes = s.nodes.drop(target).join(one, F.col(labels).eqNullSafe(F.col("__l")), "left").withColumnRenamed("__v", target).drop("__l")


@step("core.k_shortest_paths", "from to k")
def _(s, target, k, weight=None, **ends):
    """How many of the k cheapest simple paths between two nodes each node lies on."""
    paths = A.k_shortest_paths(s.graph, ends["from"], ends["to"], k, weight)
    on = [(x,) for _, p in paths for x in p]
    made = s.nodes.sparkSession.createDataFrame(on, "node_id long").groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    _join(s, target, made, "n", 0)


@step("iter.until_converged", "watched body", "", "")
def _(s, watched, body, tol=1e-6, rounds=1000, mode="sync"):
    """The body until no value of a variable moves by more than ``tol`` in a round.

    ``mode`` may be sync only: every step sees all of the step before it.
    """
    if mode != "sync":
        raise ValueError("steps are synchronous")
    for _ in range(rounds):
        before = s.nodes.select("node_id", F.col(watched).alias("__w"))
        for b in body:
            STEPS[b["id"]].run(s, **b.get("params", {}))
        s.nodes = cut(s.nodes, "steps")
        moved = s.nodes.join(before, "node_id").agg(F.max(F.abs(F.col(watched) - F.col("__w")))).first()[0]
        if moved is None or moved <= tol:
            return


@step("iter.loop", "rounds body", "", "")
def _(s, rounds, body, every=3):
    for k in range(rounds):
        for b in body:
            STEPS[b["id"]].run(s, **b.get("params", {}))
        if (k + 1) % every == 0:
            s.nodes = cut(s.nodes, "steps")


# --- pipelines ---


def validate(pipeline: list[dict], known: set[str] | None = None) -> list[str]:
    """What is wrong with a pipeline, if anything."""
    known, bad = set(known or ()) | {"node_id"}, []
    for i, b in enumerate(pipeline):
        spec, params = STEPS.get(b.get("id", "")), b.get("params", {})
        if spec is None:
            bad.append(f"step {i}: there is no step {b.get('id')!r}")
            continue
        bad += [f"step {i} ({b['id']}): {p} is missing" for p in spec.needs if p not in params]
        bad += [f"step {i} ({b['id']}): {params[p]!r} isn't set before" for p in spec.reads if p in params and params[p] not in known]
        if b["id"] in ("iter.loop", "iter.until_converged"):
            bad += validate(params.get("body", []), known)
            known |= {x["params"][w] for x in params.get("body", []) if x.get("id") in STEPS for w in STEPS[x["id"]].writes if w in x.get("params", {})}
        known |= {params[w] for w in spec.writes if w in params}
    return bad


def run(graph: Graph, pipeline: list[dict]) -> State:
    """The state after all steps; an invalid pipeline is an error before anything runs."""
    bad = validate(pipeline)
    if bad:
        raise ValueError("; ".join(bad))
    s = State(graph, graph.nodes.select("node_id"), graph.edges.select("edge_id", "source", "target"))
    for b in pipeline:
        STEPS[b["id"]].run(s, **b.get("params", {}))
    return s
