"""Node embeddings, projections to the plane, and layouts.

Random, circular, grid and honeycomb positions are expressions.  PCA needs one aggregate of products and a
small eigenproblem.  Spectral, force-directed and neighbour-preserving positions (t-SNE, UMAP) compare all
nodes: driver kernels behind a check of the size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.graph import Graph
from quillgraph.plans.ordering import with_position

#: Nodes that the driver's kernels take.
KERNEL_NODES = 3_000


def random_embedding(nodes: DataFrame, dims: int = 2, kind: str = "gaussian", seed: int = 0) -> DataFrame:
    """(node_id, vector): gaussian, uniform or spherical; a node's draw is a hash of its id."""
    unit = lambda k: (F.pmod(F.xxhash64("node_id", F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    if kind == "uniform":
        return nodes.select("node_id", F.array(*[unit(k) for k in range(dims)]).alias("vector"))
    normal = [F.sqrt(-2 * F.log(unit(2 * k))) * F.cos(2 * math.pi * unit(2 * k + 1)) for k in range(dims)]
    out = nodes.select("node_id", F.array(*normal).alias("vector"))
    if kind == "spherical":
        size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
        out = out.withColumn("vector", F.transform("vector", lambda x: x / size))
    return out


def pca(rows: DataFrame, vector: str, dims: int = 2, key: str = "node_id") -> DataFrame:
    """(key, vector): principal components, from one aggregate of means and products.

    The sign of a component is that of its largest entry.
    """
    x = rows.select(key, F.col(vector).cast("array<double>").alias("x")).where("x IS NOT NULL")
    first = x.first()
    if first is None:
        return x.select(key, F.col("x").alias("vector"))
    d = len(first["x"])
    cells = x.select(F.posexplode("x").alias("i", "v"), "x")
    sums = cells.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    prods = cells.select("i", "v", F.posexplode("x").alias("j", "w")).groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("p"))
    mean, cov = np.zeros(d), np.zeros((d, d))
    for r in sums.collect():  # d rows
        n, mean[r["i"]] = r["n"], r["s"] / r["n"]
    for r in prods.collect():  # d * d rows
        cov[r["i"], r["j"]] = r["p"] / n
    _, vec = np.linalg.eigh(cov - np.outer(mean, mean))
    top = vec[:, ::-1][:, :dims]
    top = top * np.sign(top[np.abs(top).argmax(0), range(top.shape[1])])
    return project(x.select(key, "x"), "x", top, mean, key)


def project(rows: DataFrame, vector: str, matrix: np.ndarray, mean: np.ndarray | None = None, key: str = "node_id") -> DataFrame:
    """(key, vector): vectors, less the mean, times a given matrix."""
    mean = np.zeros(len(matrix)) if mean is None else mean
    columns = [F.array(*[F.lit(float(x)) for x in matrix[:, k]]) for k in range(matrix.shape[1])]
    centred = F.zip_with(F.col(vector), F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b)
    made = [F.aggregate(F.zip_with(centred, c, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for c in columns]
    return rows.select(key, F.array(*made).alias("vector"))


def _small(g: Graph) -> tuple[list, np.ndarray]:
    if g.nodes.limit(KERNEL_NODES + 1).count() > KERNEL_NODES:
        raise ValueError(f"this layout takes graphs of up to {KERNEL_NODES} nodes")
    ids = [r[0] for r in g.nodes.select("node_id").orderBy("node_id").collect()]
    at = {x: i for i, x in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for r in g.edges.select("source", "target").where("source <> target").distinct().collect():
        a[at[r[0]], at[r[1]]] = a[at[r[1]], at[r[0]]] = 1
    return ids, a


def _placed(g: Graph, ids: list, pos: np.ndarray) -> DataFrame:
    return g.nodes.sparkSession.createDataFrame([(i, [float(x) for x in p]) for i, p in zip(ids, pos, strict=True)], "node_id long, vector array<double>")


def spectral(g: Graph, dims: int = 2) -> DataFrame:
    """(node_id, vector): eigenvectors of the Laplacian after the constant one."""
    ids, a = _small(g)
    _, vec = np.linalg.eigh(np.diag(a.sum(1)) - a)
    vec = vec[:, 1 : dims + 1]
    sign = np.sign(vec[np.abs(vec).argmax(0), range(vec.shape[1])])
    return _placed(g, ids, vec * sign)


def force_directed(g: Graph, dims: int = 2, rounds: int = 100, seed: int = 0) -> DataFrame:
    """(node_id, vector): springs along edges, repulsion between all nodes, cooling steps."""
    ids, a = _small(g)
    n = max(len(ids), 1)
    pos = np.random.default_rng(seed).normal(size=(len(ids), dims))
    ideal = n ** (-1 / dims)
    for t in range(rounds):
        gap = pos[:, None] - pos[None]
        far = np.maximum(np.sqrt((gap**2).sum(-1)), 1e-6)
        force = ((ideal**2 / far**2 - a * far / ideal)[..., None] * gap).sum(1)
        size = np.maximum(np.sqrt((force**2).sum(1, keepdims=True)), 1e-9)
        pos += force / size * np.minimum(size, 0.1 * (1 - t / rounds))
    return _placed(g, ids, pos)


def energy(g: Graph, dims: int = 2, rounds: int = 2000, start: float = 1.0, seed: int = 0) -> DataFrame:
    """(node_id, vector) by simulated annealing of the springs' energy: one node is moved at a time, and a move
    that raises the energy is taken with a chance that falls with the temperature."""
    ids, a = _small(g)
    n, rng = len(ids), np.random.default_rng(seed)
    pos = rng.normal(size=(n, dims))
    ideal = max(n, 1) ** (-1 / dims)

    def own(k: int, p: np.ndarray) -> float:
        far = np.maximum(np.sqrt(((pos - p) ** 2).sum(1)), 1e-6)
        far[k] = 1.0
        pull = a[k] * far**3 / (3 * ideal)
        push = -(ideal**2) * np.log(far)
        push[k] = 0
        return float((pull + push).sum())

    for t in range(rounds if n > 1 else 0):
        heat = start * (1 - t / rounds) ** 2 + 1e-9
        k = int(rng.integers(n))
        to = pos[k] + rng.normal(size=dims) * heat
        change = own(k, to) - own(k, pos[k])
        if change < 0 or rng.random() < math.exp(-min(change / (heat * ideal), 700.0)):
            pos[k] = to
    return _placed(g, ids, pos)


def _vectors(rows: DataFrame, vector: str, key: str) -> tuple[list, np.ndarray]:
    """Keys and vectors of a frame that is small enough to compare all of them."""
    x = rows.select(key, F.col(vector).cast("array<double>").alias("x")).where("x IS NOT NULL")
    if x.limit(KERNEL_NODES + 1).count() > KERNEL_NODES:
        raise ValueError(f"this projection takes up to {KERNEL_NODES} rows")
    got = sorted((tuple(r) for r in x.collect()), key=lambda r: r[0])
    return [r[0] for r in got], np.array([r[1] for r in got]).reshape(len(got), -1)


def _projected(rows: DataFrame, key: str, ids: list, pos: np.ndarray) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()
    return rows.sparkSession.createDataFrame([(i, [float(v) for v in p]) for i, p in zip(ids, pos, strict=True)], f"{key} {kind}, vector array<double>")


def _squares(x: np.ndarray) -> np.ndarray:
    size = (x * x).sum(1)
    out = np.maximum(size[:, None] + size[None] - 2 * x @ x.T, 0.0)
    np.fill_diagonal(out, 0.0)
    return out


def _principal(x: np.ndarray, dims: int) -> np.ndarray:
    u, sv, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    out = np.zeros((len(x), dims))
    k = min(dims, u.shape[1])
    out[:, :k] = (u * sv)[:, :k]
    return out


def _affinities(d2: np.ndarray, perplexity: float) -> np.ndarray:
    """P(j | i) of a Gaussian around each row whose entropy is the logarithm of the perplexity."""
    n = len(d2)
    low, high, beta = np.zeros(n), np.full(n, np.inf), np.ones(n)
    off = ~np.eye(n, dtype=bool)
    near = d2 - np.where(off, d2, np.inf).min(1)[:, None]  # the nearest at 0: nothing underflows
    for _ in range(60):
        p = np.where(off, np.exp(-near * beta[:, None]), 0.0)
        total = p.sum(1)
        entropy = np.log(total) + beta * (p * near).sum(1) / total
        flat = entropy > math.log(perplexity)
        low, high = np.where(flat, beta, low), np.where(flat, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + np.where(np.isinf(high), 0, high)) / 2)
    return p / total[:, None]


def _descend(p: np.ndarray, start: np.ndarray, rounds: int) -> np.ndarray:
    """Positions whose Student affinities are near ``p`` (gradient descent with momentum, early
    exaggeration for a quarter of the rounds)."""
    n = len(p)
    y = start / max(start[:, 0].std(), 1e-12) * 1e-4
    step, gain, rate = np.zeros_like(y), np.ones_like(y), max(n / 48, 10.0)
    for t in range(rounds):
        q = 1 / (1 + _squares(y))
        np.fill_diagonal(q, 0)
        w = ((12.0 if t < rounds // 4 else 1.0) * p - q / q.sum()) * q
        grad = 4 * (w.sum(1)[:, None] * y - w @ y)
        gain = np.maximum(np.where(np.sign(grad) != np.sign(step), gain + 0.2, gain * 0.8), 0.01)
        step = (0.5 if t < rounds // 4 else 0.8) * step - rate * gain * grad
        y = y + step
        y -= y.mean(0)
    return y


def tsne(rows: DataFrame, vector: str, dims: int = 2, perplexities: tuple[float, ...] = (30.0,), rounds: int = 400, seed: int = 0, key: str = "node_id") -> DataFrame:
    """(key, vector) by t-SNE from principal components; with several perplexities, their mean affinities
    (multi-scale).  A perplexity is at most a third of the rows."""
    ids, x = _vectors(rows, vector, key)
    n = len(ids)
    if n < 4:
        return _projected(rows, key, ids, np.zeros((n, dims)))
    d2 = _squares(x)
    p = sum(_affinities(d2, max(2.0, min(k, (n - 1) / 3))) for k in perplexities) / len(perplexities)
    start = _principal(x, dims) + np.random.default_rng(seed).normal(size=(n, dims)) * 1e-6
    return _projected(rows, key, ids, _descend(np.maximum((p + p.T) / (2 * n), 1e-12), start, rounds))


def umap(rows: DataFrame, vector: str, dims: int = 2, neighbours: int = 15, min_dist: float = 0.1, rounds: int = 300, seed: int = 0, key: str = "node_id") -> DataFrame:
    """(key, vector) by a fuzzy graph of nearest neighbours, laid out by attraction along its edges and
    repulsion from drawn rows."""
    ids, x = _vectors(rows, vector, key)
    n, rng = len(ids), np.random.default_rng(seed)
    if n < 4:
        return _projected(rows, key, ids, np.zeros((n, dims)))
    d, k = np.sqrt(_squares(x)), min(neighbours, n - 1)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :k]
    far = np.take_along_axis(d, near, 1) - np.take_along_axis(d, near, 1)[:, :1]
    low, high, sigma = np.zeros(n), np.full(n, np.inf), np.ones(n)
    for _ in range(60):  # so wide that each row has log2(k) neighbours in all
        much = np.exp(-far / np.maximum(sigma, 1e-12)[:, None]).sum(1) > math.log2(k + 1)
        low, high = np.where(much, low, sigma), np.where(much, sigma, high)
        sigma = np.where(np.isinf(high), sigma * 2, (low + np.where(np.isinf(high), 0, high)) / 2)
    w = np.zeros((n, n))
    np.put_along_axis(w, near, np.exp(-far / np.maximum(sigma, 1e-12)[:, None]), 1)
    w = w + w.T - w * w.T
    # a curve 1 / (1 + a d^2b) that is near 1 up to min_dist and falls like exp(min_dist - d) beyond
    grid = np.linspace(1e-3, 3, 300)
    want = np.where(grid <= min_dist, 1.0, np.exp(min_dist - grid))
    a, b = min(((a, b) for a in np.geomspace(0.3, 10, 40) for b in np.linspace(0.5, 1.5, 41)), key=lambda c: float(((1 / (1 + c[0] * grid ** (2 * c[1])) - want) ** 2).sum()))
    i, j = np.nonzero(w)
    y = _principal(x, dims)
    y = 10 * y / max(np.abs(y).max(), 1e-12) + rng.normal(size=y.shape) * 1e-3
    for t in range(rounds):
        rate = 1 - t / rounds
        on = rng.random(len(i)) < w[i, j]
        u, v = i[on], j[on]
        gap = y[u] - y[v]
        d2 = np.maximum((gap**2).sum(1), 1e-9)
        pull = np.clip((-2 * a * b * d2 ** (b - 1) / (1 + a * d2**b))[:, None] * gap, -4, 4)
        move = np.zeros_like(y)
        np.add.at(move, u, pull)
        np.add.at(move, v, -pull)
        for _ in range(5):
            o = rng.integers(n, size=len(u))
            gap = y[u] - y[o]
            d2 = (gap**2).sum(1)
            push = np.clip((2 * b / ((0.001 + d2) * (1 + a * np.maximum(d2, 1e-9) ** b)))[:, None] * gap, -4, 4)
            np.add.at(move, u, np.where((o != u)[:, None], push, 0))
        y = y + rate * 0.1 * np.clip(move, -40, 40)
    return _projected(rows, key, ids, y)


def quality(original: DataFrame, projected: DataFrame, vector: str = "vector", k: int = 10, key: str = "node_id") -> DataFrame:
    """One row: share of the k nearest neighbours that stay, stress (of the best scale), and correlation of
    distances, before and after a projection."""
    ids, x = _vectors(original, vector, key)
    other, y = _vectors(projected, "vector", key)
    if ids != other:
        raise ValueError("both sides need the same keys")
    n = len(ids)
    if n < 3:
        return original.sparkSession.createDataFrame([(1.0, 0.0, 1.0)], "neighbours double, stress double, correlation double")
    d, e, k = np.sqrt(_squares(x)), np.sqrt(_squares(y)), min(k, n - 1)
    nearest = lambda m: np.argsort(m + np.diag(np.full(n, np.inf)), axis=1, kind="stable")[:, :k]
    kept = float(np.mean([len(set(p) & set(q)) / k for p, q in zip(nearest(d).tolist(), nearest(e).tolist(), strict=True)]))
    u, v = d[np.triu_indices(n, 1)], e[np.triu_indices(n, 1)]
    scale = float(u @ v / max(v @ v, 1e-300))
    stress = float(np.sqrt(((u - scale * v) ** 2).sum() / max((u * u).sum(), 1e-300)))
    together = float(np.corrcoef(u, v)[0, 1]) if u.std() and v.std() else 0.0
    return original.sparkSession.createDataFrame([(kept, stress, together)], "neighbours double, stress double, correlation double")


def visible(points: DataFrame, left: float, bottom: float, right: float, top: float) -> DataFrame:
    """Points (x, y) inside a window, its edges included."""
    return points.where(F.col("x").between(left, right) & F.col("y").between(bottom, top))


def circular(nodes: DataFrame, radius: float = 1.0) -> DataFrame:
    """(node_id, x, y) on a circle in id order."""
    placed = with_position(nodes.select("node_id"), [F.asc("node_id")], "__k")
    n = nodes.agg(F.count(F.lit(1)).alias("__n"))
    angle = 2 * math.pi * F.col("__k") / F.col("__n")
    return placed.crossJoin(F.broadcast(n)).select("node_id", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))


def grid(nodes: DataFrame, columns: int, step: float = 1.0) -> DataFrame:
    """(node_id, x, y) row by row in id order."""
    placed = with_position(nodes.select("node_id"), [F.asc("node_id")], "__k")
    return placed.select("node_id", (F.col("__k") % columns * step).cast("double").alias("x"), (F.floor(F.col("__k") / columns) * step).cast("double").alias("y"))


def honeycomb(points: DataFrame, size: float = 1.0) -> DataFrame:
    """(node_id, q, r, x, y): points (x, y) moved to the centres of hexagonal cells, with cube rounding."""
    q, r = (math.sqrt(3) / 3 * F.col("x") - F.col("y") / 3) / size, (2 / 3 * F.col("y")) / size
    cube = points.select("node_id", q.alias("q"), r.alias("r"), (-q - r).alias("s"))
    near = {c: F.round(c) for c in ("q", "r", "s")}
    off = {c: F.abs(near[c] - F.col(c)) for c in near}
    fixed_q = F.when((off["q"] > off["r"]) & (off["q"] > off["s"]), -near["r"] - near["s"]).otherwise(near["q"])
    fixed_r = F.when(~((off["q"] > off["r"]) & (off["q"] > off["s"])) & (off["r"] > off["s"]), -near["q"] - near["s"]).otherwise(near["r"])
    cell = cube.select("node_id", fixed_q.cast("long").alias("q"), fixed_r.cast("long").alias("r"))
    return cell.select("node_id", "q", "r", (size * math.sqrt(3) * (F.col("q") + F.col("r") / 2)).alias("x"), (size * 1.5 * F.col("r")).alias("y"))


def interpolate(start: DataFrame, end: DataFrame, steps: int) -> DataFrame:
    """(node_id, step, vector): vectors that move evenly from start to end."""
    e = end.select("node_id", F.col("vector").alias("to"))
    t = F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step")
    both = start.join(e, "node_id").select("node_id", "vector", "to", t)
    moved = F.zip_with("vector", "to", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return both.select("node_id", "step", F.transform(moved, lambda p: p["a"] + (p["b"] - p["a"]) * F.col("step") / steps).alias("vector"))


def edge_stress(g: Graph, positions: DataFrame) -> DataFrame:
    """One row ``mean_length``, ``deviation``: how evenly long the edges are drawn."""
    p = positions.select("node_id", "vector")
    e = g.edges.join(p.toDF("source", "__a"), "source").join(p.toDF("target", "__b"), "target")
    gap = F.aggregate(F.zip_with("__a", "__b", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return e.agg(F.avg(F.sqrt(gap)).alias("mean_length"), F.stddev_pop(F.sqrt(gap)).alias("deviation"))


LAYOUTS: dict[str, Callable] = {"circular": circular, "grid": grid, "spectral": spectral, "force_directed": force_directed, "energy": energy, "random": random_embedding, "honeycomb": honeycomb}

#: Projections of vectors by name: each takes (rows, vector, dims, key=...).
PROJECTIONS: dict[str, Callable] = {"pca": pca, "tsne": tsne, "umap": umap}


def embed(method: str, *args, **options) -> DataFrame:
    """A layout of a graph's nodes, or a projection of vectors, by name."""
    known = LAYOUTS | PROJECTIONS
    if method not in known:
        raise ValueError(f"methods are {', '.join(sorted(known))}")
    return known[method](*args, **options)
