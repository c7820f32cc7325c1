"""Collections: many subgraphs, components or tables as one frame with a ``part`` column.

A member of the collection is a value of ``part``; nothing loops over members on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.predicate import parse
from quillgraph.operators.graph import Graph
from quillgraph.operators.table import Table, aggregate
from quillgraph.plans.staging import cut

#: Cells of a matrix of a collection that one task decomposes.
PART_CELLS = 1_000_000


@dataclass(frozen=True)
class Subgraphs:
    """Subgraphs of one graph: memberships (part, node_id); an edge is in a part that has both its ends.

    A node may be in several parts.  A null part is no part.
    """

    graph: Graph
    members: DataFrame

    @classmethod
    def components(cls, g: Graph) -> Subgraphs:
        return cls(g, cut(g.components().select(F.col("component").alias("part"), "node_id"), "parts"))

    @classmethod
    def by_attribute(cls, g: Graph, attr: str) -> Subgraphs:
        return cls(g, g.nodes.where(F.col(attr).isNotNull()).select(F.col(attr).alias("part"), "node_id"))

    @classmethod
    def neighborhoods(cls, g: Graph, centers: DataFrame, hops: int = 1) -> Subgraphs:
        """A part for each centre: all nodes within so many steps."""
        return cls(g, g.k_hop(centers, hops).select(F.col("seed").alias("part"), "node_id"))

    # --- tables of the members ---

    def nodes_table(self) -> DataFrame:
        return self.members.join(self.graph.nodes, "node_id")

    def edges_table(self) -> DataFrame:
        """Edges of each part, which stands in front."""
        ends = lambda end: self.members.select("part", F.col("node_id").alias(end)).distinct()
        e = self.graph.edges.join(ends("source"), "source").join(ends("target"), ["part", "target"], "left_semi")
        return e.select("part", *self.graph.edges.columns)

    def endpoints(self) -> DataFrame:
        """(part, node_id) of nodes that an edge of their part touches."""
        return self.edges_table().select("part", F.explode(F.array("source", "target")).alias("node_id")).distinct()

    def sizes(self) -> DataFrame:
        """(part, nodes, edges)."""
        n = self.members.groupBy("part").agg(F.count_distinct("node_id").alias("nodes"))
        e = self.edges_table().groupBy("part").agg(F.count(F.lit(1)).alias("edges"))
        return n.join(e, "part", "left").na.fill(0, ["edges"])

    def stats(self) -> DataFrame:
        """One row: parts, total nodes and edges (as often as they are members), least, mean and most nodes."""
        return self.sizes().agg(F.count(F.lit(1)).alias("parts"), F.sum("nodes").alias("total_nodes"), F.sum("edges").alias("total_edges"), F.min("nodes").alias("least"), F.avg("nodes").alias("mean"), F.max("nodes").alias("most"))

    def attribute(self, name: str, how: str | None = None) -> DataFrame:
        """(part, node_id, value) of one attribute, or (part, value) of a named aggregate of it."""
        rows = self.nodes_table().select("part", "node_id", F.col(name).alias("value"))
        return rows if how is None else rows.groupBy("part").agg(aggregate(how, "value").alias("value"))

    # --- choosing members ---

    def _keep(self, parts: DataFrame) -> Subgraphs:
        return Subgraphs(self.graph, self.members.join(parts.select("part").distinct(), "part", "left_semi"))

    def filter(self, condition: str | Column) -> Subgraphs:
        """Parts whose size (nodes, edges) meets a condition."""
        sizes = self.sizes()
        return self._keep(sizes.where(parse(condition, sizes.columns) if isinstance(condition, str) else condition))

    def filter_by_size(self, low: int, high: int | None = None, what: str = "nodes") -> Subgraphs:
        c = F.col(what)
        return self._keep(self.sizes().where((c >= low) & (c <= high if high is not None else F.lit(True))))

    def filter_nodes(self, condition: str) -> Subgraphs:
        """Members that match, within every part; parts without any go."""
        kept = self.graph.nodes.where(parse(condition, self.graph.nodes.columns)).select("node_id")
        return Subgraphs(self.graph, self.members.join(kept, "node_id", "left_semi").select("part", "node_id"))

    def sample(self, k: int, seed: int = 0) -> Subgraphs:
        """k parts by a seeded hash of their names."""
        return self._keep(self.members.select("part").distinct().orderBy(F.xxhash64("part", F.lit(seed)), "part").limit(k))

    def neighborhood(self, hops: int = 1) -> Subgraphs:
        """Every part with all nodes within so many steps of it."""
        near = self.graph.neighbors(direction="both")
        out = self.members.select("part", "node_id").distinct()
        for _ in range(hops):
            step = out.join(near, "node_id").select("part", F.col("neighbor_id").alias("node_id"))
            out = cut(out.unionByName(step).distinct(), "parts")
        return Subgraphs(self.graph, out)

    def regroup(self, attr: str) -> Subgraphs:
        """Parts split by a node attribute: a part is then a struct of both."""
        return Subgraphs(self.graph, self.nodes_table().select(F.struct("part", F.col(attr).alias("value")).alias("part"), "node_id"))

    def as_graph(self, part) -> Graph:
        return self.graph.induced(self.members.where(F.col("part") == part).select("node_id"))

    def map(self, f: Callable, schema: str) -> DataFrame:
        """``f`` of each part's nodes as a pandas frame; a part must fit one task."""
        return self.nodes_table().groupBy("part").applyInPandas(f, schema)

    def collapse(self, node_aggs: dict[str, Column] | None = None, edge_aggs: dict[str, Column] | None = None) -> tuple[Graph, DataFrame]:
        """Each part as a meta-node; the parts must not share nodes."""
        return self.graph.collapse(self.members.select("node_id", "part"), node_aggs, edge_aggs)


@dataclass(frozen=True)
class Tables:
    """Tables of one schema with a ``part`` column."""

    df: DataFrame

    def join(self, other: Tables, on: str | list[str], how: str = "inner") -> Tables:
        """Each part with the part of the same name."""
        return Tables(Table(self.df).join(Table(other.df), ["part", *([on] if isinstance(on, str) else on)], how).df)

    def map(self, **columns: Column) -> Tables:
        """The same column expressions in every part."""
        return Tables(self.df.withColumns(columns))

    def agg(self, what: dict[str, str]) -> DataFrame:
        return self.df.groupBy("part").agg(*[aggregate(f, c).alias(f"{c}_{f}") for c, f in what.items()])

    def nrows(self) -> DataFrame:
        return self.df.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))

    def __getitem__(self, part) -> Table:
        return Table(self.df.where(F.col("part") == part).drop("part"))


@dataclass(frozen=True)
class Matrices:
    """Matrices as cells (part, i, j, v) and shapes (part, rows, cols)."""

    cells: DataFrame
    shapes: DataFrame

    def dimension_stats(self) -> DataFrame:
        """One row: matrices, and least, mean and most rows and columns."""
        return self.shapes.agg(F.count(F.lit(1)).alias("matrices"), *[f(c).alias(f"{n}_{c}") for c in ("rows", "cols") for n, f in (("least", F.min), ("mean", F.avg), ("most", F.max))])

    def filter(self, condition: str) -> Matrices:
        """Matrices whose shape (rows, cols) meets a condition."""
        kept = self.shapes.where(parse(condition, self.shapes.columns))
        return Matrices(self.cells.join(kept, "part", "left_semi"), kept)

    def eigenvalues(self) -> DataFrame:
        """(part, mean_eigenvalue): the mean of the real parts, of square matrices, in NumPy a matrix a task.

        A matrix that has more than ``PART_CELLS`` cells is an error.
        """
        kind = self.shapes.schema["part"].dataType.simpleString()

        def mean(rows):
            n = int(rows["rows"].iloc[0])
            if n * n > PART_CELLS:
                raise ValueError(f"a task takes matrices of up to {PART_CELLS} cells")
            a = np.zeros((n, n))
            given = rows.dropna(subset=["v"])
            a[given["i"].astype(int), given["j"].astype(int)] = given["v"]
            return rows[["part"]].head(1).assign(mean_eigenvalue=float(np.linalg.eigvals(a).real.mean()) if n else 0.0)

        square = self.shapes.where("rows = cols").select("part", "rows")
        return square.join(self.cells, "part", "left").select("part", "rows", "i", "j", "v").groupBy("part").applyInPandas(mean, f"part {kind}, mean_eigenvalue double")

    def correlation(self) -> DataFrame:
        """(part, other, corr): Pearson correlation of every two matrices of one shape over all cells, zeros
        included."""
        n = (F.col("rows") * F.col("cols")).cast("double")
        sums = self.cells.groupBy("part").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
        one = self.shapes.join(sums, "part", "left").na.fill(0.0, ["s", "q"])
        names = ["part", "s", "q"]
        pairs = one.join(one.select("rows", "cols", *[F.col(c).alias(f"o_{c}") for c in names]), ["rows", "cols"]).where(F.col("part") < F.col("o_part"))
        cross = self.cells.join(self.cells.select(F.col("part").alias("o_part"), "i", "j", F.col("v").alias("w")), ["i", "j"]).where(F.col("part") < F.col("o_part"))
        cross = cross.groupBy("part", "o_part").agg(F.sum(F.col("v") * F.col("w")).alias("x"))
        both = pairs.join(cross, ["part", "o_part"], "left").na.fill(0.0, ["x"])
        spread = lambda s, q: n * F.col(q) - F.col(s) * F.col(s)
        return both.select("part", F.col("o_part").alias("other"), F.try_divide(n * F.col("x") - F.col("s") * F.col("o_s"), F.sqrt(spread("s", "q") * spread("o_s", "o_q"))).alias("corr"))
