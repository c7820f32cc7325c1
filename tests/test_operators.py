"""Operators on small fixtures: edge cases, files, kernels, streams."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.functions.expr import compile_expression
from quillgraph.functions.predicate import PredicateError, parse
from quillgraph.operators import algorithms as A
from quillgraph.operators import builder as B
from quillgraph.operators.components import connected_components
from quillgraph.operators.graph import Graph, merge
from quillgraph.operators.matrix import Matrix
from quillgraph.operators.table import Table, rank_values
from quillgraph.operators.temporal import from_log
from quillgraph.plans import ordering
from quillgraph.sources import generators as G
from quillgraph.sources import io
from quillgraph.streaming import ingest


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture
def people(spark):
    data = [(1, "ann", 30, None), (2, "bob", None, 1.5), (3, None, 25, 2.5), (4, "ann", 30, 4.0)]
    return Table(spark.createDataFrame(data, "id long, name string, age int, score double")).ordered("id")


def test_predicate_grammar(people):
    ids = lambda t: [r[0] for r in rows(people.filter(t).df, "id")]
    assert ids("age >= 30 AND score OR name == 'bob'") == [2, 4]
    assert ids("NOT (age = 30)") == [3]
    assert ids("name IN ('ann', 'x') AND NOT score IS NULL") == [4]
    assert ids("age NOT BETWEEN 26 AND 40") == [3]
    assert ids("name LIKE 'a%'") == [1, 4]
    assert ids("name != 'ann'") == [2]
    for bad in ("age >", "nothing == 1", "age == 1 extra ,", "(age == 1", "== 3"):
        with pytest.raises(PredicateError):
            parse(bad, people.df.columns)


def test_nulls_join_nulls(spark):
    a = Table(spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string"))
    b = Table(spark.createDataFrame([(None, "z"), (2, "w")], "k int, v string"))
    assert rows(a.join(b, "k").df, "left_v", "right_v") == [("y", "z")]
    out = a.join(b, "k", "outer").df
    assert set(out.columns) == {"k", "v", "v_right"} and out.count() == 3
    right = a.join(b, "k", "right").df
    assert right.columns == ["k", "right_v", "left_v"]


def test_group_keys_keep_nulls(people):
    assert people.groupby("name").count().count() == 3
    assert rows(people.groupby("name").agg({"score": "count"}), "score") == [(1,), (1,), (1,)]


def test_running_blocks_match_windows(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK", 7)
    data = [(i, float((i * 37) % 11) if i % 5 else None) for i in range(100)]
    t = Table(spark.createDataFrame(data, "i long, x double")).ordered("i")
    out = t.cumsum("x", "s").cummax("x", "m").rolling("x", 9, "sum", "r").shift("x", 3, "b", fill=-1.0)
    got = {r["i"]: r for r in out.df.collect()}
    xs = [x for _, x in data]
    for i in range(100):
        part = [x for x in xs[: i + 1] if x is not None]
        assert got[i]["s"] == pytest.approx(sum(part))
        assert got[i]["m"] == (max(part) if part else None)
        assert got[i]["r"] == (None if i < 8 else pytest.approx(sum(x for x in xs[i - 8 : i + 1] if x is not None)))
        assert got[i]["b"] == (-1.0 if i < 3 else xs[i - 3])


def test_positions_are_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = rows(ordering.with_position(df, [F.asc("k")]), "k", "ord")
    assert got == [(i, i) for i in range(1000)]
    assert ordering.with_position(df.limit(0), [F.asc("k")]).count() == 0


def test_order_dependent_needs_order(people):
    with pytest.raises(ValueError):
        Table(people.df.drop("ord")).head()


def test_take_and_update(people, spark):
    assert rows(people.take_rows([2, 0, 2]).df, "ord", "id") == [(0, 3), (1, 1), (2, 3)]
    new = spark.createDataFrame([(1, 9.0), (2, None)], "id long, score double")
    assert rows(people.update_from("id", new, ["score"]).df, "id", "score")[:2] == [(1, 9.0), (2, 1.5)]


def test_quantiles_and_ranks(spark):
    t = Table(spark.createDataFrame([(float(x),) for x in (1, 2, 2, 4)], "x double"))
    assert [t.quantile("x", 0.5, h) for h in ("lower", "higher", "midpoint", "nearest", "linear")] == [2, 2, 2, 2, 2]
    assert t.quantile("x", 0.9, "lower") == 2 and t.quantile("x", 0.9, "higher") == 4
    assert sorted(r[0] for r in rank_values(t.df, "x", "r").select("r").collect()) == [1.0, 2.5, 2.5, 4.0]


def test_samples(spark):
    t = Table(spark.range(200).select("id", (F.col("id") % 10).cast("double").alias("w")))
    got = t.sample(n=30, weight="w", seed=1).df
    assert got.count() == 30 and got.where("w = 0").count() == 0
    again = t.sample(n=500, weight="w", replace=True, seed=1).df
    assert again.count() == 500 and again.where("w = 0").count() == 0


def test_expression_compiler():
    c = compile_expression("sum(x[neighbors(node)]) + (1 if x > 2 else min(x, 3)) ** 2")
    assert c.neighbor == [("x", "sum", "__nb_sum_x")]
    with pytest.raises(ValueError):
        compile_expression("open('f')")


# --- graphs ---


def test_graph_changes(spark):
    g = G.complete(spark, 5)
    assert g.remove_nodes(spark.createDataFrame([(0,)], "x long")).edges.count() == 6
    more = g.add_edges(spark.createDataFrame([(99, 0, 77), (98, 0, 1)], "edge_id long, source long, target long"))
    assert more.edges.count() == 11
    assert dict(rows(more.validate(), "problem", "n"))["parallel edge"] == 2
    with pytest.raises(ValueError):
        merge(g, g, "fail")
    assert merge(g, g).nodes.count() == 10


def test_self_loops_count_once(spark):
    g = Graph.from_edges(spark.createDataFrame([(1, 1), (1, 2)], "source long, target long"))
    assert rows(g.degree(), "node_id", "degree") == [(1, 2), (2, 1)]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components_match_union_find(spark, pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(pairs or [(None, None)], "source long, target long")
    assert dict(rows(connected_components(df), "node", "component")) == {x: root(x) for x in parent}


def test_long_chain_is_one_component(spark):
    assert G.path(spark, 300).components(0).select("component").distinct().count() == 1


def test_algorithms_on_known_graphs(spark):
    star = G.star(spark, 6)
    assert rows(A.betweenness(star), "node_id", "betweenness")[0] == (0, pytest.approx(1.0))
    assert rows(A.closeness(star), "node_id", "closeness")[0] == (0, pytest.approx(5.0))
    assert A.shortest_path(G.path(spark, 6), 1, 4) == [1, 2, 3, 4]
    assert A.shortest_path(G.communities(spark, [2, 2], 1.0, 0.0), 0, 3) == []
    ring = Graph(G.cycle(spark, 6).nodes, G.cycle(spark, 6).edges, True)
    assert A.strong_components(ring).select("component").distinct().count() == 1
    assert rows(A.k_core(G.complete(spark, 4), 3), "in_core") == [(1,)] * 4
    two = G.communities(spark, [6, 6], 1.0, 0.03, 5)
    found = A.louvain(two).withColumnRenamed("community", "found").join(two.nodes, "node_id")
    assert found.select("found", "community").distinct().count() == 2
    assert A.leiden(two).select("community").distinct().count() == 2
    assert A.girvan_newman(two).select("community").distinct().count() == 2
    assert [n for n, _ in A.k_shortest_paths(G.cycle(spark, 5), 0, 2, 2)] == [2.0, 3.0]
    assert abs(A.pagerank(ring).agg(F.sum("rank")).first()[0] - 1) < 1e-6


def test_one_task_and_supersteps_agree(spark):
    g = G.random_edges(spark, 60, 90, 4)
    g = Graph(g.nodes.union(spark.createDataFrame([(1000,)], "node_id long")), g.edges, True)
    for f, c in ((lambda n: g.components(n), "component"), (lambda n: A.pagerank(g, local_edges=n), "rank"), (lambda n: A.label_propagation(g, 5, -1.0, local_edges=n), "label"), (lambda n: A.infomap_majority(g, 3) if n is None else A.label_propagation(g, 3, 0.0, self_vote=False, local_edges=0), "label")):
        one, many = dict(rows(f(None), "node_id", c)), dict(rows(f(0), "node_id", c))
        assert one == pytest.approx(many, abs=1e-9)
    empty = Graph(g.nodes.limit(0), g.edges.limit(0))
    assert empty.components().count() == A.pagerank(empty).count() == A.label_propagation(empty).count() == 0


def test_one_task_and_supersteps_agree_on_improper_graphs(spark):
    """Edges to ids that are no nodes, null ends and null node ids count nowhere, whatever the size."""
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "node_id long")
    edges = spark.createDataFrame([(1, 9, 0), (2, 9, 1), (9, 3, 2), (3, 4, 3), (4, 3, 4), (None, 1, 5), (2, None, 6), (None, None, 7), (1, 2, 8), (3, 3, 9)], "source long, target long, edge_id long")
    g, proper = Graph(nodes, edges, True), Graph(nodes.where("node_id IS NOT NULL"), edges.where("edge_id IN (3, 4, 8, 9)"), True)
    for f, c in ((lambda g, n: g.components(n), "component"), (lambda g, n: A.pagerank(g, rounds=20, tol=None, local_edges=n), "rank"), (lambda g, n: A.pagerank(g, rounds=20, tol=None, personal="node_id", direction="both", local_edges=n), "rank"), (lambda g, n: A.label_propagation(g, 4, -1.0, local_edges=n), "label")):
        want = dict(rows(f(proper, None), "node_id", c))
        for n in (None, 0):
            got = rows(f(g, n), "node_id", c)
            assert len(got) == 4 and dict(got) == pytest.approx(want, abs=1e-9)
    ranks = dict(rows(A.pagerank(g, rounds=20, tol=None, local_edges=0), "node_id", "rank"))
    assert sum(ranks.values()) == pytest.approx(1.0)
    apart = Graph(nodes, edges.where("edge_id < 2"))
    assert rows(apart.components(0), "node_id", "component") == rows(apart.components(), "node_id", "component") == [(k, k) for k in (1, 2, 3, 4)]


def test_generators(spark):
    assert G.watts_strogatz(spark, 20, 4, 0.2, 1).edges.count() == 40
    assert G.barabasi_albert(spark, 30, 2, 1).edges.count() == 56
    assert G.erdos_renyi(spark, 40, 0.2, 3).edges.count() == G.erdos_renyi(spark, 40, 0.2, 3).edges.count()
    karate = G.karate_club(spark)
    assert karate.edges.count() == 78 and dict(rows(karate.degree(), "node_id", "degree"))[33] == 17
    assert karate.transitivity().first()[0] == pytest.approx(0.2556818, abs=1e-6)
    assert G.random_edges(spark, 50, 200, 2).edges.where("source = target").count() == 0


def test_collapse_keeps_outside_nodes(spark):
    g = G.path(spark, 5)
    meta, members = g.collapse(spark.createDataFrame([(0, 100), (1, 100)], "node_id long, part long"))
    assert rows(meta.nodes, "node_id") == [(2,), (3,), (4,), (100,)]
    assert rows(meta.edges, "source", "target") == [(2, 3), (2, 100), (3, 4)]
    assert members.count() == 2


def test_builder_loop_until(spark):
    g = G.complete(spark, 4)
    b = B.AlgorithmBuilder()
    b.var("x", b.constant(16.0))
    b.iterate(50, lambda: b.var("x", B.Var(b, "x") * 0.5), until=("x", 0.6))
    b.attach_as("x", B.Var(b, "x"))
    assert {r["x"] for r in b.build()(g).collect()} == {0.5}
    attached = B.pipeline(B.degree_centrality(), B.dsl_label_propagation(2))(g)
    assert {"centrality", "label"} <= set(attached.nodes.columns)
    assert set(B.REGISTRY) >= {"dsl_pagerank", "degree_centrality"}


def test_graph_queries(spark):
    g = Graph(G.path(spark, 6).nodes.withColumn("half", F.col("node_id") < 3), G.path(spark, 6).edges.withColumn("odd", F.col("source") % 2))
    assert g.is_connected() and g.has_edge(2, 1) and not g.has_edge(0, 5)
    one = spark.createDataFrame([(2,), (77,)], "x long")
    assert rows(g.contains(one), "node_id", "found") == [(2, True), (77, False)]
    assert g.incident_edges(one).count() == 2 and g.incident_edges(one, "out").count() == 1
    assert rows(g.adjacency_list(), "node_id", "neighbors")[1] == (1, [0, 2])
    assert g.sample(3, 1).nodes.count() == 3
    _, inside = g.group_by_node_attr("half")
    assert inside.count() == 4
    ends, _ = g.group_by_edge_attr("odd")
    assert ends.where("part = 1").count() == 4
    _, members = g.collapse(g.nodes.select("node_id", F.col("half").cast("long")))
    assert g.expand(members, 1).edges.count() == 2
    assert dict(rows(g.transition().groupBy("source").agg(F.sum("p").alias("p")), "source", "p"))[2] == 1.0
    assert rows(g.overlaps({"a": g.sample(2), "b": g.induced(one.where("x > 50"))}), "name", "nodes") == [("a", 2)]


def test_step_pipelines(spark):
    from quillgraph.operators import steps as S

    g = Graph(G.complete(spark, 4).nodes, G.complete(spark, 4).edges.withColumn("w", F.lit(2.0)))
    p = [
        {"id": "core.node_degree", "params": {"target": "d"}},
        {"id": "core.graph_node_count", "params": {"target": "n"}},
        {"id": "core.div", "params": {"left": "d", "right": "n", "target": "share"}},
        {"id": "core.neighbor_agg", "params": {"source": "d", "how": "sum", "target": "s"}},
        {"id": "core.compare", "params": {"left": "s", "op": "gt", "right": 8, "target": "many"}},
        {"id": "core.where", "params": {"mask": "many", "then": "s", "otherwise": 0, "target": "s2"}},
        {"id": "core.init_nodes", "params": {"target": "x", "value": 1.0}},
        {"id": "iter.loop", "params": {"rounds": 4, "body": [{"id": "core.mul", "params": {"left": "x", "right": 2, "target": "x"}}]}},
        {"id": "core.normalize_values", "params": {"source": "x", "target": "even"}},
        {"id": "core.triangle_count", "params": {"target": "t"}},
        {"id": "core.collect_neighbor_values", "params": {"source": "d", "target": "list"}},
        {"id": "core.mode_list", "params": {"source": "list", "target": "mode"}},
        {"id": "core.random_walk", "params": {"length": 3, "target": "walk"}},
        {"id": "core.top_k", "params": {"source": "x", "k": 2, "target": "top"}},
        {"id": "core.sample_nodes", "params": {"k": 2, "target": "drawn"}},
        {"id": "core.shortest_path_map", "params": {"source": "drawn", "target": "dist"}},
        {"id": "core.modularity_gain", "params": {"source": "drawn", "target": "gain"}},
        {"id": "core.weighted_degree", "params": {"weight": "w", "target": "wd"}},
        {"id": "core.load_edge_attr", "params": {"attr": "w", "target": "cap"}},
        {"id": "core.init_edges", "params": {"target": "flow", "value": 0.5}},
        {"id": "core.residual_capacity", "params": {"capacity": "cap", "flow": "flow", "target": "rest"}},
        {"id": "core.reduce_scalar", "params": {"source": "x", "how": "sum", "target": "total"}},
        {"id": "core.attach_node_attr", "params": {"source": "t", "attr": "triangles"}},
    ]
    assert S.validate(p) == []
    s = S.run(g, p)
    for r in s.nodes.collect():
        assert (r["share"], r["s"], r["s2"], r["x"], r["even"], r["t"], r["mode"], r["wd"]) == (0.75, 9, 9, 16.0, 0.25, 3, 3, 6.0)
        assert len(r["walk"]) == 4 and r["dist"] == (0.0 if r["drawn"] else 1.0)
    assert s.scalars["total"] == 64.0 and {r["rest"] for r in s.edges.collect()} == {1.5}
    assert s.graph.nodes.where("triangles = 3").count() == 4
    assert len(S.validate([{"id": "no.such"}, {"id": "core.abs", "params": {"source": "zz"}}])) == 3
    assert len(S.STEPS) >= 55


# --- matrices ---


def test_matrix_against_numpy(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(-3, 4, (4, 3)).astype(float), rng.integers(-3, 4, (3, 5)).astype(float)
    m, n = Matrix.of(spark, a), Matrix.of(spark, b)
    assert np.allclose(m.matmul(n).to_numpy(), a @ b)
    assert np.allclose(m.transpose().to_numpy(), a.T)
    assert np.allclose(m.add(m).subtract(m).to_numpy(), a)
    assert np.allclose(m.reshape(2, 6).to_numpy(), a.reshape(2, 6))
    assert np.allclose(m.tile(2, 2).to_numpy(), np.tile(a, (2, 2)))
    assert np.allclose(m.concatenate(m, 1).to_numpy(), np.hstack([a, a]))
    assert np.allclose(m.map(F.exp, keeps_zero=False).to_numpy(), np.exp(a))
    stats = m.stats().first()
    assert stats["min"] == a.min() and stats["max"] == a.max() and stats["zeros"] == (a == 0).sum()
    assert [r["std"] for r in m.axis(0).orderBy("j").collect()] == pytest.approx(a.std(0, ddof=1))
    sq = Matrix.of(spark, a.T @ a + np.eye(3))
    assert sq.is_symmetric() and sq.determinant() == pytest.approx(np.linalg.det(a.T @ a + np.eye(3)))
    p, low, up = sq.lu()
    assert np.allclose(p @ sq.to_numpy(), low @ up)
    value, _ = sq.dominant()
    assert value == pytest.approx(np.linalg.eigvalsh(a.T @ a + np.eye(3)).max(), rel=1e-6)
    assert np.allclose(sq.power(3).to_numpy(), np.linalg.matrix_power(sq.to_numpy(), 3))


def test_embeddings(spark):
    from quillgraph.operators import embedding as E

    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3)) * [5, 1, 0.1]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "node_id long, vector array<double>")
    got = np.array([r["vector"] for r in E.pca(df, "vector", 2).orderBy("node_id").collect()])
    _, vec = np.linalg.eigh(np.cov(x.T, bias=True))
    want = (x - x.mean(0)) @ vec[:, ::-1][:, :2]
    assert np.allclose(np.abs(got), np.abs(want))
    g = G.path(spark, 10)
    line = [r["vector"][0] for r in E.spectral(g, 1).orderBy("node_id").collect()]
    assert line == sorted(line) or line == sorted(line, reverse=True)
    sizes = [sum(v * v for v in r["vector"]) for r in E.random_embedding(g.nodes, 4, "spherical").collect()]
    assert sizes == pytest.approx([1.0] * 10)
    assert E.circular(g.nodes).agg(F.sum("x")).first()[0] == pytest.approx(0)
    hexes = E.honeycomb(E.grid(g.nodes, 3))
    assert hexes.count() == 10 and hexes.join(E.grid(g.nodes, 3).toDF("node_id", "a", "b"), "node_id").where("abs(x - a) > 1 OR abs(y - b) > 1").isEmpty()
    a, b = E.random_embedding(g.nodes), E.random_embedding(g.nodes, seed=2)
    assert E.interpolate(a, b, 4).count() == 50
    assert E.edge_stress(g, E.force_directed(g)).first()["mean_length"] > 0


def test_gradients_match_differences():
    from quillgraph.operators.autodiff import Tensor

    rng = np.random.default_rng(3)
    x, w, b, k = (rng.normal(size=s) for s in ((4, 3), (3, 5), (1, 5), (2, 2)))

    def loss(x, w, b, k):
        h = (Tensor.of(x) @ w + b).tanh()
        return (h.conv2d(Tensor.of(k)).sigmoid() * 2.0 - 0.3).relu().mean() + (h * h + 1.0).log().sum() - h.exp().mean()

    args = [Tensor(v) for v in (x, w, b, k)]
    loss(*args).backward()
    for i, a in enumerate(args):
        for at in [(0, 0), tuple(n - 1 for n in a.value.shape)]:
            moved = [v.copy() for v in (x, w, b, k)]
            moved[i][at] += 1e-6
            up = float(loss(*moved).value)
            moved[i][at] -= 2e-6
            assert a.grad[at] == pytest.approx((up - float(loss(*moved).value)) / 2e-6, abs=1e-5)


# --- history ---


def test_history(spark):
    commits = [(0, [], 10, "a", "m", "main"), (1, [0], 20, "a", "m", "main"), (2, [1], 30, "a", "m", "main"), (3, [1], 35, "b", "m", "side")]
    none = (None, None)
    changes = [(0, "node", "add", 1, *none, None, None), (0, "node", "add", 2, *none, None, None), (0, "edge", "add", 7, 1, 2, None, None), (1, "node", "set", 1, *none, "c", "5"), (2, "node", "remove", 2, *none, None, None), (2, "edge", "remove", 7, 1, 2, None, None), (2, "node", "set", 1, *none, "c", "6")]
    h = from_log(spark, commits, changes)
    assert rows(h.alive_at(1), "id") == [(1,), (2,)] and rows(h.alive_at(2), "id") == [(1,)]
    assert rows(h.alive_in(2, 3), "id") == [(1,), (2,)]
    assert rows(h.diff(1, 2), "id", "change") == [(1, "changed"), (2, "removed")]
    assert h.snapshot(1).nodes.where("node_id = 1").first()["c"] == "5"
    assert rows(h.neighbors_at(1), "node_id", "neighbor_id") == [(1, 2), (2, 1)] and h.neighbors_at(2).count() == 0
    assert h.neighbors_in(2, 3).count() == 2
    asked = spark.createDataFrame([(1, "c", 0), (1, "c", 1), (1, "c", 9)], "id long, attr string, commit_id long")
    assert rows(h.as_of(asked), "commit_id", "value") == [(0, None), (1, "5"), (9, "6")]
    assert h.commit_at(25) == 1 and h.is_ancestor(0, 3) and not h.is_ancestor(2, 3) and h.common_ancestor(2, 3) == 1
    assert h.collect_garbage([3]).commits.count() == 3
    more = h.commit(spark.createDataFrame([("node", "add", 5)], "entity string, op string, id long"), ts=40)
    assert more.head() == 4 and rows(more.alive_at(4), "id") == [(1,), (5,)]


# --- files and streams ---


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, None, None)], "id long, s string, v array<double>")
    io.write_csv(df, str(tmp_path / "c"))
    assert rows(io.read_csv(spark, str(tmp_path / "c")), "id") == [(1,), (2,)]
    (tmp_path / "d.json").write_text(io.json_document(df.drop("v")))
    assert io.read_json_table(spark, str(tmp_path / "d.json")).count() == 2
    g = G.complete(spark, 4)
    io.save_bundle(g, str(tmp_path / "g"))
    assert io.load_bundle(spark, str(tmp_path / "g")).edges.count() == 6
    both = io.load_federated(spark, {"x": str(tmp_path / "g"), "y": str(tmp_path / "g")})
    assert rows(both.nodes.groupBy("_domain").count(), "_domain", "count") == [("x", 4), ("y", 4)]
    g.edges.limit(3).write.mode("overwrite").parquet(str(tmp_path / "g/edges"))
    assert io.validate_bundle(spark, str(tmp_path / "g"))


def test_ids_of_any_type(spark):
    nodes = spark.createDataFrame([("p", 1), ("q", 2)], "id string, age int")
    edges = spark.createDataFrame([("p", "q"), ("p", "zz")], "source string, target string")
    g = io.graph_from_tables(nodes, edges)
    assert g.edges.count() == 1 and set(g.nodes.columns) == {"id", "node_id", "age"}


def test_streaming_upsert_and_windows(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "state")
    a = spark.createDataFrame([(1, 1, "x"), (2, 2, "y")], "id long, n long, v string")
    a.write.parquet(src)
    spark.createDataFrame([(1, 5, "z")], a.schema).write.mode("append").parquet(src)
    q = ingest.read_events(spark, src, a.schema, 1).writeStream.foreachBatch(ingest.upsert_to(out, ["id"], "n")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(ingest.current(spark, out), "id", "v") == [(1, "z"), (2, "y")]
    spark.sql("SELECT timestamp'2024-01-01 00:00:30' AS ts, 'a' AS k UNION ALL SELECT timestamp'2024-01-01 00:05:30', 'a'").write.parquet(str(tmp_path / "ev"))
    ev = ingest.read_events(spark, str(tmp_path / "ev"), "ts timestamp, k string")
    w = ingest.windowed(ev, "ts", ["k"], "1 minute").writeStream.outputMode("complete").format("memory").queryName("w").start()
    w.processAllAvailable()
    w.stop()
    assert spark.table("w").count() == 2


def _two_groups(spark):
    """Two cliques of four, joined by one edge; weights 1 inside, 5 between."""
    e = [(a, b, 1.0) for s in (0, 4) for a in range(s, s + 4) for b in range(a + 1, s + 4)] + [(3, 4, 5.0)]
    return Graph.from_edges(spark.createDataFrame([(i, *x) for i, x in enumerate(e)], "edge_id long, source long, target long, w double"))


def test_parallel_louvain_finds_planted_groups(spark):
    g = _two_groups(spark)
    found = {r["node_id"]: r["community"] for r in A.louvain_distributed(g).collect()}
    assert len(set(found.values())) == 2 and len({found[x] for x in range(4)}) == 1 and len({found[x] for x in range(4, 8)}) == 1


def test_modularity_gains_are_differences(spark):
    """Every gain against modularity before and after the move."""
    g = _two_groups(spark)
    part = {x: (0 if x < 3 else 1 if x < 6 else 2) for x in range(8)}
    q = lambda p: A.modularity(g, spark.createDataFrame(list(p.items()), "node_id long, part long"), "w").first()[0]
    before = q(part)
    rows = A.modularity_gains(g, spark.createDataFrame(list(part.items()), "node_id long, part long"), "w").collect()
    assert rows
    for r in rows[:6]:
        assert r["gain"] == pytest.approx(q(part | {r["node_id"]: r["part"]}) - before)


def test_weights_are_checked_and_used(spark):
    g = _two_groups(spark)
    bad = Graph(g.nodes, g.edges.withColumn("w", -F.col("w")), False)
    for f in (lambda: A.sssp(bad, spark.createDataFrame([(0,)], "node_id long"), "w"), lambda: A.closeness(bad, weight="w"), lambda: A.girvan_newman(bad, weight="w")):
        with pytest.raises(ValueError):
            f()
    assert A.girvan_newman(g, weight="w").select("community").distinct().count() == 2
    # a detour through many cheap edges beats a dear one; a bound that is true changes nothing
    e = spark.createDataFrame([(0, 0, 9, 10.0), (1, 0, 1, 1.0), (2, 1, 2, 1.0), (3, 2, 9, 1.0), (4, 0, 3, 1.0), (5, 3, 4, 1.0)], "edge_id long, source long, target long, w double")
    g = Graph.from_edges(e, True)
    h = Graph(g.nodes.withColumn("h", F.when(F.col("node_id").isin(3, 4), 99.0).otherwise(0.0)), e, True)
    assert A.astar(g, 0, 9, "w") == A.astar(h, 0, 9, "w", "h") == (3.0, [0, 1, 2, 9])
    assert A.astar(g, 4, 9, "w") == (None, [])


def test_asof_join_with_nulls(spark):
    left = spark.createDataFrame([(1, 10, "a"), (2, 5, "a"), (3, 7, None), (4, None, "a")], "id int, t int, k string")
    right = spark.createDataFrame([(5, "a", 50), (9, "a", 90), (9, "a", 91), (6, None, 60), (None, "a", 1)], "t int, k string, v int")
    ask = lambda **o: {r["id"]: r["v"] for r in Table(left).asof_join(Table(right), "t", ["k"], **o).df.collect()}
    assert ask() == {1: 91, 2: 50, 3: 60, 4: None}
    assert ask(strict=True) == {1: 91, 2: None, 3: 60, 4: None}
    assert ask(direction="forward") == {1: None, 2: 50, 3: None, 4: None}


def test_tables_go_with_what_they_were_for(spark):
    """A loop leaves its last state alone in storage, and drop takes only what cut wrote."""
    from quillgraph.plans import staging
    from quillgraph.plans.loop import iterate

    kept = staging.cut(spark.range(3), "kept")
    path = kept._quillgraph_path
    out = iterate(kept, lambda df, k: df.select((F.col("id") + 1).alias("id")), 7, lambda a, b: False, label="loop-test")
    assert sorted(r[0] for r in out.collect()) == [7, 8, 9] and sorted(r[0] for r in kept.collect()) == [0, 1, 2]
    import os

    folder = staging.run_dir(spark)
    assert sum(x.startswith("loop-test") for x in os.listdir(folder)) == 1
    staging.drop(kept, spark.range(1))
    assert not os.path.exists(path)


def _blobs(spark):
    """Three far groups of 20 points in five dimensions; key // 20 is the group."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(3, 5)) * 30
    return spark.createDataFrame([(i, [float(x) for x in centres[i // 20] + rng.normal(size=5)]) for i in range(60)], "node_id long, vector array<double>")


@pytest.mark.parametrize("method, options", [("tsne", {"perplexities": (10.0,)}), ("tsne", {"perplexities": (5.0, 15.0)}), ("umap", {"neighbours": 10}), ("pca", {})])
def test_projections_keep_groups_together(spark, method, options):
    """The nearest points after the projection are of the same group."""
    from quillgraph.operators import embedding

    points = _blobs(spark)
    made = embedding.embed(method, points, "vector", 2, **options)
    pos = {r["node_id"]: np.array(r["vector"]) for r in made.collect()}
    for i in pos:
        near = sorted((k for k in pos if k != i), key=lambda k: float(((pos[k] - pos[i]) ** 2).sum()))[:5]
        assert all(k // 20 == i // 20 for k in near)
    found = embedding.quality(points, made).first()
    assert found["neighbours"] > 0.3 and 0 <= found["stress"] < 1


def test_quality_of_the_same_points(spark):
    from quillgraph.operators import embedding

    points = _blobs(spark)
    found = embedding.quality(points, points).first()
    assert found["neighbours"] == 1 and found["stress"] == pytest.approx(0, abs=1e-6) and found["correlation"] == pytest.approx(1)
    with pytest.raises(ValueError):
        embedding.embed("none", points)


def test_annealing_draws_edges_shorter(spark):
    from quillgraph.operators import embedding

    g = _two_groups(spark)
    pos = {r["node_id"]: np.array(r["vector"]) for r in embedding.energy(g, rounds=3000).collect()}
    joined = {tuple(sorted((r["source"], r["target"]))) for r in g.edges.collect()}
    length = lambda p: float(np.linalg.norm(pos[p[0]] - pos[p[1]]))
    every = [(a, b) for a in pos for b in pos if a < b]
    assert np.mean([length(p) for p in joined]) < np.mean([length(p) for p in every if p not in joined])


def test_tables_become_nodes_and_edges(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "id long, x string")
    with pytest.raises(ValueError):
        io.to_nodes(t, "id")
    with pytest.raises(ValueError):
        io.to_edges(t.withColumn("y", F.lit(1)), "id", "y")
    assert io.to_nodes(t.limit(1), "id").columns == ["node_id", "x"]
    import pandas as pd

    assert io.from_pandas(spark, pd.DataFrame({"a": [1, 2]}, index=pd.Index([5, 6], name="k"))).columns == ["k", "a"]


def test_social_network_and_limits(spark):
    g = G.social_network(spark, 31, 3, 0.5, 0.05)
    assert sorted(r["n"] for r in g.nodes.groupBy("community").agg(F.count("*").alias("n")).collect()) == [10, 10, 11]
    assert g.nodes.where("activity >= 0 AND activity < 1").count() == 31 and "strength" in g.edges.columns
    assert G.karate_club(spark).edges.count() == 78
    with pytest.raises(ValueError):
        G.barabasi_albert(spark, 10**6, 5)


def test_kendall_over_many_pairs(spark, monkeypatch):
    """More distinct pairs than were taken before; then blocks of a few values, with frequent values on both sides."""
    import pandas as pd

    from quillgraph.operators import table

    rng = np.random.default_rng(3)
    a = rng.integers(0, 50, 25_000)
    b = rng.permutation(25_000) + 300 * a
    want = sum(np.sign(b[a > x][:, None] - b[a == x][None, :]).sum() for x in range(50)) / (25_000 * 24_999 / 2)
    df = spark.createDataFrame(pd.DataFrame({"a": a.astype(float), "b": b.astype(float)}))
    assert Table(df).corr("a", "b", "kendall").first()[0] == pytest.approx(want)
    monkeypatch.setattr(table, "KENDALL_BLOCK", 8)
    for high in (7, 1000):
        x, y = rng.integers(0, high, 900), rng.integers(0, 300, 900)
        x[:200], y[150:400] = 3, 5
        want = (np.sign(x[None, :] - x[:, None]) * np.sign(y[None, :] - y[:, None])).sum() / 2
        df = spark.createDataFrame(pd.DataFrame({"a": x.astype(float), "b": y.astype(float)}))
        assert Table(df).corr("a", "b", "kendall").first()[0] == pytest.approx(want / (900 * 899 / 2), abs=1e-12)
    one = spark.sql("SELECT 1.0D AS a, double(id) AS b FROM range(1)")
    assert Table(one).corr("a", "b", "kendall").first()[0] is None


def test_concordance_beyond_64_bits():
    import pyarrow as pa

    from quillgraph.operators.local import concordance

    big = 1 << 40
    cells = pa.table({"a": [0.0, 1.0, 1.0, 2.0], "b": [1.0, 0.0, 2.0, 2.0], "n": [big, big, 1, big]})
    assert int(concordance(cells)["s"][0].as_py()) == -big * big + big + big * big + big * big


@pytest.mark.parametrize("form", ["driver", "blocks", "joins"])
def test_parallel_louvain_ends_where_no_move_gains(spark, monkeypatch, form):
    """The query's levels, too, run until no node gains by a move, in each form; moves found beside changed parts are all there are."""
    from quillgraph.operators import louvain as L
    from quillgraph.queries import more

    rng = np.random.default_rng(5)
    e = [(i, int(a), int(b), float(w)) for i, (a, b, w) in enumerate(zip(rng.integers(0, 60, 400), rng.integers(0, 60, 400), rng.integers(1, 9, 400), strict=True))]
    g = Graph.from_edges(spark.createDataFrame(e, "edge_id long, source long, target long, w double"))
    ends, climb = [], L.climb

    def watched(scan, move, draw, rounds):
        state = climb(scan, move, draw, rounds)
        if form == "joins":
            left = scan(state)[2]
        elif state is None:
            left = scan(None)[2]
        else:  # with every part marked as changed, all best moves are found anew
            every = np.arange(len(state[0]), dtype=np.int32)
            left = scan((state[0], every, (every, every)))[2]
        ends.append((rounds, left))
        return state

    monkeypatch.setattr(L, "climb", watched)
    if form != "driver":
        monkeypatch.setattr(L, "DRIVER_ENDS", 0)
    if form == "joins":
        monkeypatch.setattr(L, "ARRAY_NODES", 0)
    monkeypatch.setattr(more, "trade", lambda s, d: g)
    found = more.QUERIES["louvain_distributed"](spark, "")
    found = {r["node_id"]: r["community"] for r in found.collect()}
    assert len(ends) > 1 and set(ends) == {(None, 0)}
    assert sorted(found) == sorted(r[0] for r in g.nodes.collect()) and all(found[c] == c for c in found.values())
    q = A.modularity(g, spark.createDataFrame(list(found.items()), "node_id long, part long"), "w").first()[0]
    sequential = A.modularity(g, A.louvain(g, weight="w"), "w").first()[0]
    assert q > 0.8 * sequential


def test_parallel_louvain_without_edges_and_with_improper_ones(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "node_id long")
    edges = spark.createDataFrame([(0, 1, 9), (1, None, 2)], "edge_id long, source long, target long")
    assert rows(A.louvain_distributed(Graph(nodes, edges)), "node_id", "community") == [(1, 1), (2, 2), (3, 3)]
    edges = edges.union(spark.createDataFrame([(2, 1, 3), (3, 2, 2)], edges.schema))
    assert rows(A.louvain_distributed(Graph(nodes, edges)), "node_id", "community") == [(1, 1), (2, 2), (3, 1)]
