"""A small language for graph algorithms: variables on nodes, neighbour aggregates, loops.

A builder records steps; ``build()`` gives a function from a graph to a frame of nodes.  All variables of a
run are columns of one frame, so that a run of column steps is one projection, and each neighbour
aggregate is one join and one grouped sum.  Loops cut their lineage in shared storage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import scalar
from quillgraph.functions.expr import compile_expression
from quillgraph.operators.graph import Graph
from quillgraph.plans.ordering import with_position
from quillgraph.plans.staging import cut

Step = Callable[[Graph, DataFrame], DataFrame]


def neighbor_aggregate(g: Graph, state: DataFrame, var: str, how: str, out: str, direction: str = "in", weight: str | None = None) -> DataFrame:
    """``state`` with an aggregate of ``var`` over each node's neighbours; 0 for none, but for min and max."""
    direction = direction if g.directed else "both"
    adj = g.adjacency(direction)
    if weight:
        adj = adj.join(g.edges.select("edge_id", F.coalesce(F.col(weight).cast("double"), F.lit(1.0)).alias("__w")), "edge_id")
    x = adj.join(state.select(F.col("node_id").alias("neighbor_id"), F.col(var).alias("__x")), "neighbor_id")
    value = F.col("__x") * F.col("__w") if weight else F.col("__x")
    if how == "mode":
        n = x.groupBy("node_id", "__x").agg(F.count(F.lit(1)).alias("__n"))
        got = n.groupBy("node_id").agg(F.min_by("__x", F.struct(-F.col("__n"), F.col("__x"))).alias(out))
    else:
        f = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "list": F.collect_list}[how]
        got = x.groupBy("node_id").agg(f(value).alias(out))
    joined = state.drop(out).join(got, "node_id", "left")
    return joined.withColumn(out, F.coalesce(out, F.lit(0))) if how in ("sum", "mean", "count") else joined


@dataclass(frozen=True)
class Var:
    """A variable of a builder; arithmetic on it records a step."""

    builder: AlgorithmBuilder
    name: str

    def _op(self, f: Callable[[Column, Column], Column], other, swap: bool = False) -> Var:
        b = F.col(other.name) if isinstance(other, Var) else F.lit(other)
        a = F.col(self.name)
        return self.builder.column(f(b, a) if swap else f(a, b))

    def __add__(self, o):
        return self._op(lambda a, b: a + b, o)

    def __radd__(self, o):
        return self._op(lambda a, b: a + b, o, True)

    def __sub__(self, o):
        return self._op(lambda a, b: a - b, o)

    def __rsub__(self, o):
        return self._op(lambda a, b: a - b, o, True)

    def __mul__(self, o):
        return self._op(lambda a, b: a * b, o)

    def __rmul__(self, o):
        return self._op(lambda a, b: a * b, o, True)

    def __truediv__(self, o):
        return self._op(scalar.safe_div, o)

    def __rtruediv__(self, o):
        return self._op(scalar.safe_div, o, True)

    def __pow__(self, o):
        return self._op(F.pow, o)

    def __neg__(self):
        return self._op(lambda a, b: a * b, -1)

    def __eq__(self, o):
        return self._op(lambda a, b: scalar.compare(a, "eq", b), o)

    def __ne__(self, o):
        return self._op(lambda a, b: scalar.compare(a, "ne", b), o)

    def __lt__(self, o):
        return self._op(lambda a, b: scalar.compare(a, "lt", b), o)

    def __le__(self, o):
        return self._op(lambda a, b: scalar.compare(a, "le", b), o)

    def __gt__(self, o):
        return self._op(lambda a, b: scalar.compare(a, "gt", b), o)

    def __ge__(self, o):
        return self._op(lambda a, b: scalar.compare(a, "ge", b), o)

    __hash__ = object.__hash__

    def __invert__(self):
        return self._op(lambda a, b: scalar.compare(a, "eq", b), 0)

    def where(self, a, b) -> Var:
        """``a`` where this is not 0, else ``b``."""
        pick = lambda x: F.col(x.name) if isinstance(x, Var) else F.lit(x)
        return self.builder.column(scalar.where(F.col(self.name), pick(a), pick(b)))

    def reduce(self, how: str) -> Var:
        return self.builder.reduce(self, how)

    def normalize(self, how: str = "sum") -> Var:
        return self.builder.normalize(self, how)

    def __matmul__(self, _):
        raise TypeError("write builder.neighbor_agg(var)")


class AlgorithmBuilder:
    """Records steps.  ``var(name, value)`` gives a variable a name that a loop carries on."""

    def __init__(self, name: str = "algorithm"):
        self.name, self.steps, self.made, self.out = name, [], 0, {}

    def _fresh(self) -> Var:
        self.made += 1
        return Var(self, f"v{self.made}")

    def step(self, f: Step) -> None:
        self.steps.append(f)

    def column(self, c: Column) -> Var:
        v = self._fresh()
        self.step(lambda g, s: s.withColumn(v.name, c))
        return v

    # --- sources of values ---

    def constant(self, x) -> Var:
        return self.column(F.lit(x))

    init_nodes = constant

    def init_index(self) -> Var:
        v = self._fresh()
        self.step(lambda g, s: with_position(s, [F.asc("node_id")], v.name))
        return v

    def load_attr(self, name: str, default=0) -> Var:
        v = self._fresh()
        self.step(lambda g, s: s.join(g.nodes.select("node_id", F.coalesce(name, F.lit(default)).alias(v.name)), "node_id"))
        return v

    def node_count(self) -> Var:
        v = self._fresh()
        self.step(lambda g, s: s.crossJoin(F.broadcast(g.nodes.agg(F.count(F.lit(1)).alias(v.name)))))
        return v

    def edge_count(self) -> Var:
        v = self._fresh()
        self.step(lambda g, s: s.crossJoin(F.broadcast(g.edges.agg(F.count(F.lit(1)).alias(v.name)))))
        return v

    def degrees(self, kind: str = "all") -> Var:
        v = self._fresh()
        self.step(lambda g, s: s.join(g.degree(kind).withColumnRenamed("degree", v.name), "node_id"))
        return v

    def weighted_degrees(self, weight: str) -> Var:
        v = self._fresh()
        self.step(lambda g, s: s.join(g.weighted_degree(weight).withColumnRenamed("weighted_degree", v.name), "node_id"))
        return v

    def triangles(self) -> Var:
        v = self._fresh()
        self.step(lambda g, s: s.join(g.triangles().withColumnRenamed("triangles", v.name), "node_id"))
        return v

    # --- columns ---

    def recip(self, x: Var, eps: float = 1e-9) -> Var:
        return self.column(scalar.recip(x.name, eps))

    def clip(self, x: Var, low: float, high: float) -> Var:
        return self.column(scalar.clip(x.name, low, high))

    def apply(self, x: Var, f: str) -> Var:
        """abs, sqrt, exp or log of a variable."""
        return self.column({"abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.ln}[f](F.col(x.name)))

    def least(self, a: Var, b: Var) -> Var:
        return self.column(F.least(a.name, b.name))

    def greatest(self, a: Var, b: Var) -> Var:
        return self.column(F.greatest(a.name, b.name))

    def map_nodes(self, text: str, **names: Var) -> Var:
        """An expression over named variables and their neighbours."""
        v, plan = self._fresh(), compile_expression(text)

        def run(g: Graph, s: DataFrame) -> DataFrame:
            t = s.withColumns({n: F.col(x.name) for n, x in names.items()}) if names else s
            for var, how, out in plan.neighbor:
                t = neighbor_aggregate(g, t, var, how, out)
            return t.withColumn(v.name, plan.column).drop(*names, *[out for _, _, out in plan.neighbor])

        self.step(run)
        return v

    # --- aggregates ---

    def reduce(self, x: Var, how: str) -> Var:
        """A scalar on every node: sum, mean, min, max, std (sample, 0 for one), median or entropy."""
        v = self._fresh()
        if how == "entropy":
            def run(g: Graph, s: DataFrame) -> DataFrame:
                n = s.groupBy(x.name).agg(F.count(F.lit(1)).alias("n"))
                total = s.agg(F.count(F.lit(1)).alias("t"))
                p = F.col("n") / F.col("t")
                return s.crossJoin(F.broadcast(n.crossJoin(F.broadcast(total)).agg(F.coalesce(-F.sum(p * F.log2(p)), F.lit(0.0)).alias(v.name))))
        else:
            f = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "median": F.median}[how]

            def run(g: Graph, s: DataFrame) -> DataFrame:
                return s.crossJoin(F.broadcast(s.agg(F.coalesce(f(x.name), F.lit(0)).alias(v.name))))
        self.step(run)
        return v

    def quantile(self, x: Var, q: float) -> Var:
        v = self._fresh()
        self.step(lambda g, s: s.crossJoin(F.broadcast(s.agg(F.percentile(x.name, q).alias(v.name)))))
        return v

    def neighbor_agg(self, x: Var, how: str = "sum", direction: str = "in", weight: str | None = None) -> Var:
        v = self._fresh()
        self.step(lambda g, s: neighbor_aggregate(g, s, x.name, how, v.name, direction, weight))
        return v

    def collect_neighbor_values(self, x: Var) -> Var:
        return self.neighbor_agg(x, "list")

    def neighbor_mode(self, x: Var) -> Var:
        """The most frequent value among neighbours, ties to the least; a node without any keeps its own."""
        m = self.neighbor_agg(x, "mode")
        return self.column(F.coalesce(m.name, x.name))

    def normalize(self, x: Var, how: str = "sum") -> Var:
        """sum: to 1; max: to at most 1; minmax: to [0, 1]; standard: mean 0, deviation (population) 1."""
        v, c = self._fresh(), F.col(x.name).cast("double")

        def run(g: Graph, s: DataFrame) -> DataFrame:
            one = s.agg(F.sum(c).alias("__s"), F.max(c).alias("__h"), F.min(c).alias("__l"), F.avg(c).alias("__m"), F.stddev_pop(c).alias("__d"))
            value = {"sum": scalar.safe_div(c, F.col("__s")), "max": scalar.safe_div(c, F.col("__h")), "minmax": scalar.safe_div(c - F.col("__l"), F.col("__h") - F.col("__l")), "standard": scalar.safe_div(c - F.col("__m"), F.col("__d"))}[how]
            return s.crossJoin(F.broadcast(one)).withColumn(v.name, value).drop("__s", "__h", "__l", "__m", "__d")

        self.step(run)
        return v

    def rank(self, x: Var, descending: bool = True) -> Var:
        """Position from 0 in the order of x, ties by node."""
        v = self._fresh()
        self.step(lambda g, s: with_position(s, [F.desc(x.name) if descending else F.asc(x.name), F.asc("node_id")], v.name))
        return v

    # --- loops and results ---

    def var(self, name: str, value: Var) -> Var:
        """Give a value a name (or, in a loop, the next value of that name)."""
        self.step(lambda g, s: s.withColumn(name, F.col(value.name)))
        return Var(self, name)

    def iterate(self, rounds: int, body: Callable[[], None], until: tuple[str, float] | None = None, every: int = 3) -> None:
        """The steps that ``body`` records, again and again.

        ``until`` = (name, tolerance) ends the loop when no value of that variable moves by more.
        """
        outer, self.steps = self.steps, []
        body()
        inner, self.steps = self.steps, outer

        def run(g: Graph, s: DataFrame) -> DataFrame:
            kept = s.columns
            for k in range(rounds):
                old = s
                for f in inner:
                    s = f(g, s)
                s = s.select("node_id", *[c for c in kept if c != "node_id"])  # what the body made for itself goes
                if until or (k + 1) % every == 0:
                    s = cut(s, "dsl")
                if until:
                    name, tol = until
                    moved = old.select("node_id", F.col(name).alias("__o")).join(s, "node_id").agg(F.max(F.abs(F.col(name) - F.col("__o")))).first()[0]
                    if moved is None or moved <= tol:
                        break
            return s

        self.step(run)

    def attach_as(self, name: str, value: Var) -> None:
        self.out[name] = value.name

    def build(self) -> Callable[[Graph], DataFrame]:
        steps, out = list(self.steps), dict(self.out)
        if not out:
            raise ValueError("nothing is attached")

        def run(g: Graph) -> DataFrame:
            s = g.nodes.select("node_id")
            for f in steps:
                s = f(g, s)
            return s.select("node_id", *[F.col(v).alias(n) for n, v in out.items()])

        return run


def entropy(values: DataFrame, name: str) -> DataFrame:
    """One row ``entropy``: Shannon, base 2, of a column's values."""
    n = values.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    t = n.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return n.crossJoin(F.broadcast(t)).agg(F.coalesce(-F.sum(p * F.log2(p)), F.lit(0.0)).alias("entropy"))


def histogram(values: DataFrame, name: str, bins: int) -> DataFrame:
    """(bin, count) of equal widths from least to greatest; the greatest is in the last bin; no empty bins."""
    c = F.col(name).cast("double")
    ends = values.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((c - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    return values.where(c.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


# --- templates and the registry ---

REGISTRY: dict[str, Callable[..., Callable[[Graph], DataFrame]]] = {}


def algorithm(f: Callable) -> Callable:
    """Register a function that returns a built algorithm under its own name."""
    REGISTRY[f.__name__] = f
    return f


@algorithm
def dsl_pagerank(damping: float = 0.85, rounds: int = 20) -> Callable[[Graph], DataFrame]:
    b = AlgorithmBuilder("pagerank")
    n, out = b.node_count(), b.degrees("out")
    rank, share, sinks, size = b.var("rank", 1.0 / n), b.var("share", b.recip(out)), b.var("sinks", out == 0), b.var("size", n)

    def body() -> None:
        r = Var(b, "rank")
        sent = b.neighbor_agg(b.column(F.when(F.col("sinks") == 0, F.col("rank") * F.col("share")).otherwise(0.0)), "sum")
        lost = (r * sinks).reduce("sum")
        b.var("rank", (1 - damping) / size + damping * (sent + lost / size))

    b.iterate(rounds, body)
    b.attach_as("rank", rank)
    del share
    return b.build()


@algorithm
def dsl_label_propagation(rounds: int = 10) -> Callable[[Graph], DataFrame]:
    b = AlgorithmBuilder("lpa")
    label = b.var("label", b.column(F.col("node_id")))
    b.iterate(rounds, lambda: b.var("label", b.neighbor_mode(label)))
    b.attach_as("label", label)
    return b.build()


@algorithm
def degree_centrality() -> Callable[[Graph], DataFrame]:
    b = AlgorithmBuilder("degree centrality")
    b.attach_as("centrality", b.degrees() / (b.node_count() - 1))
    return b.build()


def pipeline(*steps: Callable[[Graph], DataFrame]) -> Callable[[Graph], Graph]:
    """Algorithms in turn, each one's columns attached to the nodes for the next."""

    def run(g: Graph) -> Graph:
        for f in steps:
            g = Graph(g.nodes.join(f(g), "node_id", "left"), g.edges, g.directed)
        return g

    return run

