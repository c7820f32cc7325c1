"""Generated graphs, as distributed projections of ranges wherever the model allows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.algorithms import KERNEL_EDGES, barabasi_albert_edges
from quillgraph.operators.graph import Graph


def _graph(spark: SparkSession, n: int, edges: DataFrame, directed: bool = False) -> Graph:
    e = edges.select(F.monotonically_increasing_id().alias("edge_id"), F.col("source").cast("long"), F.col("target").cast("long"))
    return Graph(spark.range(n).toDF("node_id"), e, directed)


def _pairs(spark: SparkSession, n: int) -> DataFrame:
    """All (source < target); the result has that many rows by definition."""
    return spark.range(n).select(F.col("id").alias("source"), F.explode(F.sequence(F.col("id") + 1, F.lit(n))).alias("target")).where(F.col("target") < n)


def complete(spark: SparkSession, n: int) -> Graph:
    return _graph(spark, n, _pairs(spark, n))


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 0) -> Graph:
    """Each pair with probability p; a pair's draw is a hash of it, the same however tasks are cut."""
    draw = F.pmod(F.xxhash64("source", "target", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return _graph(spark, n, _pairs(spark, n).where(draw < p))


def random_edges(spark: SparkSession, n: int, m: int, seed: int = 0) -> Graph:
    """m directed draws of distinct ends among n nodes, for graphs too large to try all pairs."""
    a = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n))
    b = F.pmod(a + 1 + F.pmod(F.xxhash64("id", F.lit(seed), F.lit("to")), F.lit(n - 1)), F.lit(n))
    return Graph(spark.range(n).toDF("node_id"), spark.range(m).select(F.col("id").alias("edge_id"), a.alias("source"), b.alias("target")), True)


def cycle(spark: SparkSession, n: int) -> Graph:
    return _graph(spark, n, spark.range(n).select(F.col("id").alias("source"), ((F.col("id") + 1) % n).alias("target")))


def path(spark: SparkSession, n: int) -> Graph:
    return _graph(spark, n, spark.range(max(n - 1, 0)).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target")))


def star(spark: SparkSession, n: int) -> Graph:
    return _graph(spark, n, spark.range(1, n).select(F.lit(0).alias("source"), F.col("id").alias("target")))


def tree(spark: SparkSession, n: int, arity: int = 2) -> Graph:
    return _graph(spark, n, spark.range(1, n).select(F.floor((F.col("id") - 1) / arity).alias("source"), F.col("id").alias("target")))


def grid(spark: SparkSession, shape: list[int]) -> Graph:
    """A lattice of any number of dimensions."""
    n = 1
    for s in shape:
        n *= s
    out, stride = None, 1
    for s in reversed(shape):
        at = F.floor(F.col("id") / stride) % s
        e = spark.range(n).where(at < s - 1).select(F.col("id").alias("source"), (F.col("id") + stride).alias("target"))
        out = e if out is None else out.unionByName(e)
        stride *= s
    return _graph(spark, n, out)


def watts_strogatz(spark: SparkSession, n: int, k: int, p: float, seed: int = 0) -> Graph:
    """A ring of k neighbours, each link rewired with probability p to a node drawn by a hash."""
    e = spark.range(n).select(F.col("id").alias("source"), F.explode(F.sequence(F.lit(1), F.lit(k // 2))).alias("d"))
    dice = F.pmod(F.xxhash64("source", "d", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    far = (F.col("source") + 1 + F.pmod(F.xxhash64("source", "d", F.lit(seed), F.lit("to")), F.lit(n - 1))) % n
    return _graph(spark, n, e.select("source", F.when(dice < p, far).otherwise((F.col("source") + F.col("d")) % n).alias("target")))


def barabasi_albert(spark: SparkSession, n: int, m: int, seed: int = 0) -> Graph:
    """Preferential attachment, which is sequential: drawn on the driver, up to ``KERNEL_EDGES`` edges."""
    if n * m > KERNEL_EDGES:
        raise ValueError(f"preferential attachment is drawn up to {KERNEL_EDGES} edges")
    return _graph(spark, n, spark.createDataFrame(barabasi_albert_edges(n, m, seed), "source long, target long"))


def communities(spark: SparkSession, sizes: list[int], inside: float, between: float, seed: int = 0) -> Graph:
    """Groups of nodes, dense inside and sparse between, with a ``community`` attribute."""
    n = sum(sizes)
    ends, total = [], 0
    for s in sizes:
        total += s
        ends.append(total)
    group = lambda c: sum((c >= e).cast("int") for e in map(F.lit, ends))
    draw = F.pmod(F.xxhash64("source", "target", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    e = _pairs(spark, n).where(draw < F.when(group(F.col("source")) == group(F.col("target")), inside).otherwise(between))
    g = _graph(spark, n, e)
    return Graph(g.nodes.withColumn("community", group(F.col("node_id"))), g.edges)


def social_network(spark: SparkSession, n: int, groups: int = 3, inside: float = 0.3, between: float = 0.02, node_attrs: tuple[str, ...] = ("activity",), edge_attrs: tuple[str, ...] = ("strength",), seed: int = 0) -> Graph:
    """Communities of nearly equal size; attributes of nodes and edges are shares in [0, 1) by a seeded hash."""
    sizes = [n // groups + (k < n % groups) for k in range(groups)]
    g = communities(spark, sizes, inside, between, seed)
    share = lambda name, *ids: F.pmod(F.xxhash64(*ids, F.lit(name), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return Graph(g.nodes.withColumns({a: share(a, "node_id") for a in node_attrs}), g.edges.withColumns({a: share(a, "source", "target") for a in edge_attrs}))


# The 78 friendships of the karate club in W. W. Zachary, An Information Flow Model for Conflict and
# Fission in Small Groups, Journal of Anthropological Research 33 (1977); members are counted from 0.
KARATE = [
    (0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (0, 6), (0, 7), (0, 8), (0, 10), (0, 11), (0, 12), (0, 13), (0, 17),
    (0, 19), (0, 21), (0, 31), (1, 2), (1, 3), (1, 7), (1, 13), (1, 17), (1, 19), (1, 21), (1, 30), (2, 3), (2, 7),
    (2, 8), (2, 9), (2, 13), (2, 27), (2, 28), (2, 32), (3, 7), (3, 12), (3, 13), (4, 6), (4, 10), (5, 6), (5, 10),
    (5, 16), (6, 16), (8, 30), (8, 32), (8, 33), (9, 33), (13, 33), (14, 32), (14, 33), (15, 32), (15, 33), (18, 32), (18, 33),
    (19, 33), (20, 32), (20, 33), (22, 32), (22, 33), (23, 25), (23, 27), (23, 29), (23, 32), (23, 33), (24, 25), (24, 27), (24, 31),
    (25, 31), (26, 29), (26, 33), (27, 33), (28, 31), (28, 33), (29, 32), (29, 33), (30, 32), (30, 33), (31, 32), (31, 33), (32, 33),
]


def karate_club(spark: SparkSession) -> Graph:
    """34 members and 78 friendships; the instructor and the president are members 0 and 33."""
    g = _graph(spark, 34, spark.createDataFrame(KARATE, "source long, target long"))
    leads = F.col("node_id").isin(0, 33)
    return Graph(g.nodes.withColumns({"label": F.concat(F.lit("Member"), F.col("node_id")), "instructor": leads}), g.edges)
