"""Filter criteria as values: conditions on nodes and edges that combine, and become plans.

A condition says which nodes (or edges) of a graph match, as a frame of ids; attributes, degrees, neighbours
and composites share that one form.  Conditions nest to any depth.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.predicate import parse


_TESTS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


class Condition:
    """A condition on nodes; ``&``, ``|`` and ``~`` combine conditions."""

    def ids(self, g) -> DataFrame:
        """(node_id) of the nodes that match, once each."""
        raise TypeError(f"{type(self).__name__} doesn't say which nodes match")

    def __and__(self, other: Condition) -> Condition:
        return All((self, other))

    def __or__(self, other: Condition) -> Condition:
        return Any((self, other))

    def __invert__(self) -> Condition:
        return Not(self)


@dataclass(frozen=True)
class Where(Condition):
    """A predicate on attributes, in the filter grammar."""

    text: str

    def ids(self, g) -> DataFrame:
        return g.nodes.where(parse(self.text, g.nodes.columns)).select("node_id").distinct()


@dataclass(frozen=True)
class Attribute(Condition):
    """An attribute compared with a value (op: =, !=, <, <=, > or >=); null matches nothing."""

    name: str
    op: str
    value: object

    def ids(self, g) -> DataFrame:
        return g.nodes.where(_TESTS[self.op](F.col(self.name), F.lit(self.value))).select("node_id").distinct()


@dataclass(frozen=True)
class Has(Condition):
    """The attribute isn't null."""

    name: str

    def ids(self, g) -> DataFrame:
        return g.nodes.where(F.col(self.name).isNotNull()).select("node_id").distinct()


@dataclass(frozen=True)
class Degree(Condition):
    """A degree within bounds; kind: all, in or out."""

    low: int = 0
    high: int | None = None
    kind: str = "all"

    def ids(self, g) -> DataFrame:
        d = F.col("degree")
        return g.degree(self.kind).where((d >= self.low) & (d <= self.high if self.high is not None else F.lit(True))).select("node_id").distinct()


@dataclass(frozen=True)
class Adjacent(Condition):
    """A neighbour that matches."""

    to: Condition
    direction: str = "both"

    def ids(self, g) -> DataFrame:
        near = g.neighbors(direction=self.direction)
        return near.join(self.to.ids(g).withColumnRenamed("node_id", "neighbor_id"), "neighbor_id", "left_semi").select("node_id").distinct()


@dataclass(frozen=True)
class All(Condition):
    parts: tuple[Condition, ...]

    def ids(self, g) -> DataFrame:
        out = g.nodes.select("node_id").distinct()
        for p in self.parts:
            out = out.join(p.ids(g), "node_id", "left_semi")
        return out


@dataclass(frozen=True)
class Any(Condition):
    parts: tuple[Condition, ...]

    def ids(self, g) -> DataFrame:
        out = g.nodes.select("node_id").where(F.lit(False))
        for p in self.parts:
            out = out.unionByName(p.ids(g))
        return out.distinct()


@dataclass(frozen=True)
class Not(Condition):
    part: Condition

    def ids(self, g) -> DataFrame:
        return g.nodes.select("node_id").distinct().join(self.part.ids(g), "node_id", "left_anti")


def matching(g, condition: Condition):
    """The subgraph of the nodes that match."""
    return g.induced(condition.ids(g))


def batch(g, conditions: dict[str, Condition]) -> DataFrame:
    """(name, node_id) of many conditions, as one plan."""
    out = None
    for name, c in conditions.items():
        part = c.ids(g).select(F.lit(name).alias("name"), "node_id")
        out = part if out is None else out.unionByName(part)
    return out


def edges_matching(g, text: str | None = None, source: Condition | None = None, target: Condition | None = None) -> DataFrame:
    """Edges whose attributes meet a predicate and whose ends match conditions."""
    e = g.edges.where(parse(text, g.edges.columns)) if text else g.edges
    for end, c in (("source", source), ("target", target)):
        if c is not None:
            e = e.join(c.ids(g).withColumnRenamed("node_id", end), end, "left_semi")
    return e.select(*g.edges.columns)
