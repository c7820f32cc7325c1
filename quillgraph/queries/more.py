"""Further queries: steps, arrays, collections, criteria, hierarchies, branches, matrices, layouts, files.

Steps and matrices run on small graphs or fixed matrices where SQL must say the same; the graphs are those
of ``graphs``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import criteria as C
from quillgraph.functions import scalar
from quillgraph.operators import algorithms as A
from quillgraph.operators import embedding, steps
from quillgraph.operators.array import Array, aggregate_each, interleave
from quillgraph.operators.graph import Graph, merge
from quillgraph.operators.hierarchy import Hierarchy, Plan, add_subgraphs, collapse, preset
from quillgraph.operators.matrix import Matrix
from quillgraph.operators.parts import Matrices, Subgraphs, Tables
from quillgraph.operators.table import Table
from quillgraph.operators.temporal import CHANGES, COMMITS, History, Repository, Scope, values
from quillgraph.plans.staging import run_dir
from quillgraph.queries.graphs import _FLOW, _TRADE, SUPPLIERS, flow, flows, history, read, trade
from quillgraph.sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r6(c) -> F.Column:
    return F.round(c, 6)


# --- weighted paths ---

_BOTH = "bw AS (SELECT a, b, min(w) AS w FROM (SELECT source AS a, target AS b, CAST(w AS DOUBLE) AS w FROM fe UNION ALL SELECT target, source, w FROM fe) GROUP BY 1, 2)"


def _min_plus(edges: str, nodes: str = "fn") -> str:
    """CTEs whose last, m5, has the cheapest way from a to b (up to 32 steps)."""
    out = [f"m0 AS (SELECT a, b, min(d) AS d FROM (SELECT a, b, CAST(w AS DOUBLE) AS d FROM {edges} UNION ALL SELECT node_id, node_id, 0 FROM {nodes}) GROUP BY 1, 2)"]
    out += [f"m{k + 1} AS (SELECT x.a, y.b, min(x.d + y.d) AS d FROM m{k} x JOIN m{k} y ON x.b = y.a GROUP BY 1, 2)" for k in range(5)]
    return ", ".join(out)


@query("closeness_weighted", f"WITH {_FLOW}, {_min_plus('(SELECT source AS a, target AS b, w FROM fe)')} SELECT node_id, round(coalesce(sum(1 / d), 0), 8) AS closeness FROM fn LEFT JOIN m5 ON a = node_id AND a <> b GROUP BY 1")
def _(s, d):
    return A.closeness(flow(s, d), weight="w").withColumn("closeness", F.round("closeness", 8))


@query("closeness_reach", f"WITH {_FLOW}, {_min_plus('(SELECT source AS a, target AS b, w FROM fe)')} SELECT node_id, round(coalesce(count(d) / sum(d), 0), 8) AS closeness FROM fn LEFT JOIN m5 ON a = node_id AND a <> b GROUP BY 1")
def _(s, d):
    return A.closeness(flow(s, d), harmonic=False, weight="w").withColumn("closeness", F.round("closeness", 8))


@query("betweenness_weighted", f"""WITH RECURSIVE {_FLOW}, {_BOTH}, {_min_plus('bw')}, tight AS (SELECT m.a AS seed, bw.a AS u, bw.b AS v FROM m5 m JOIN bw ON bw.a = m.b JOIN m5 n ON n.a = m.a AND n.b = bw.b WHERE abs(m.d + bw.w - n.d) < 1e-9),
w AS (SELECT node_id AS x, [node_id] AS p FROM fn UNION ALL SELECT x, list_append(p, v) FROM w JOIN tight ON seed = x AND u = p[-1]), c AS (SELECT x, p[-1] AS y, count(*) AS c FROM w GROUP BY 1, 2),
v AS (SELECT unnest(p[2:-2]) AS node_id, 1.0 / c AS q FROM w JOIN c ON w.x = c.x AND p[-1] = y WHERE len(p) > 2)
SELECT fn.node_id, round(coalesce(sum(q), 0) / 2, 6) AS betweenness FROM fn LEFT JOIN v USING (node_id) GROUP BY 1""")
def _(s, d):
    return A.betweenness(flow(s, d, False), normalized=False, weight="w").withColumn("betweenness", r6("betweenness"))


@query("astar", f"WITH {_FLOW}, {_min_plus('(SELECT source AS a, target AS b, w FROM fe)')} SELECT b AS node_id, d AS cost FROM m5 WHERE a = 3 AND b IN (0, 7, 24)")
def _(s, d):
    """The bound: no way out of a node is cheaper than its cheapest edge."""
    g = flow(s, d)
    least = g.edges.groupBy(F.col("source").alias("node_id")).agg(F.min("w").alias("bound"))
    rows = []
    for target in (0, 7, 24):
        cheap = least.withColumn("bound", F.when(F.col("node_id") == target, 0).otherwise(F.col("bound")))
        cost, path = A.astar(Graph(g.nodes.join(cheap, "node_id", "left"), g.edges, True), 3, target, "w", "bound")
        rows += [(target, cost)] if path else []
    return s.createDataFrame(rows, "node_id long, cost double")


@query("modularity_gains", f"""WITH {_FLOW}, e AS (SELECT source AS a, target AS b, CAST(w AS DOUBLE) AS w FROM fe UNION ALL SELECT target, source, w FROM fe), m AS (SELECT CAST(sum(w) AS DOUBLE) AS m FROM fe), k AS (SELECT a AS n, sum(w) AS k FROM e GROUP BY 1),
z AS (SELECT region AS c, sum(k) AS z FROM k JOIN fn ON n = node_id GROUP BY 1), l AS (SELECT a AS n, region AS c, sum(w) AS l FROM e JOIN fn ON b = node_id GROUP BY 1, 2)
SELECT l.n AS node_id, l.c AS part, round((l.l - coalesce(o.l, 0)) / m - k.k * (z.z - zo.z + k.k) / (2 * m * m), 8) AS gain FROM l JOIN fn ON l.n = fn.node_id JOIN k ON k.n = l.n JOIN z ON z.c = l.c JOIN z zo ON zo.c = fn.region LEFT JOIN l o ON o.n = l.n AND o.c = fn.region, m WHERE l.c <> fn.region""")
def _(s, d):
    g = flow(s, d)
    return A.modularity_gains(g, g.nodes.select("node_id", "region"), "w").select("node_id", "part", F.round("gain", 8).alias("gain"))


@query("louvain_distributed")
def _(s, d):
    return A.louvain_distributed(trade(s, d), weight="w")


def _label_sql(rounds: int, own: bool) -> str:
    steps_ = ["l0 AS (SELECT node_id, node_id AS label FROM tn)"]
    for k in range(rounds):
        votes = f"SELECT a AS node_id, label FROM tadj JOIN l{k} ON b = l{k}.node_id" + (f" UNION ALL FROM l{k}" if own else "")
        steps_.append(f"l{k + 1} AS MATERIALIZED (SELECT node_id, coalesce(x.label, l{k}.label) AS label FROM l{k} LEFT JOIN (SELECT node_id, label FROM (SELECT node_id, label, row_number() OVER (PARTITION BY node_id ORDER BY count(*) DESC, label) AS k FROM ({votes}) GROUP BY 1, 2) WHERE k = 1) x USING (node_id))")
    return f"WITH {_TRADE}, {', '.join(steps_)} SELECT node_id, label FROM l{rounds}"


def _trade_rank_sql(rounds: int, damping: float = 0.85) -> str:
    out = ["n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM tn)", "o AS (SELECT a AS x, count(*) AS o FROM tadj GROUP BY 1)", "r0 AS (SELECT node_id, 1.0 / n AS rank FROM tn, n)"]
    for k in range(rounds):
        out.append(f"r{k + 1} AS MATERIALIZED (SELECT node_id, {1 - damping} / n + {damping} * (coalesce(got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{k} ANTI JOIN o ON node_id = x) / n) AS rank FROM tn LEFT JOIN (SELECT b AS node_id, sum(rank / o) AS got FROM tadj JOIN o ON a = x JOIN r{k} ON r{k}.node_id = a GROUP BY 1) USING (node_id), n)")
    return f"WITH {_TRADE}, {', '.join(out)} SELECT node_id, round(rank, 8) AS rank FROM r{rounds}"


#: SQL for queries of ``graphs`` that are registered there without.
ORACLE_SQL["infomap_majority"] = _label_sql(10, False)
ORACLE_SQL["dsl_label_propagation"] = _label_sql(5, False)
ORACLE_SQL["label_propagation_trade"] = _label_sql(4, True)
ORACLE_SQL["dfs"] = f"""WITH RECURSIVE {_TRADE}, f AS (SELECT DISTINCT CAST(y.nation AS BIGINT) AS a, CAST(x.nation AS BIGINT) AS b FROM te JOIN tn x ON source = x.node_id JOIN tn y ON target = y.node_id WHERE x.nation <> y.nation), l AS (SELECT a, list(b ORDER BY b DESC) AS l FROM f GROUP BY 1),
w AS (SELECT [3::BIGINT] AS st, []::BIGINT[] AS seen UNION ALL SELECT CASE WHEN list_contains(seen, st[-1]) THEN st[:-2] ELSE list_concat(st[:-2], list_filter(coalesce(l, []), lambda y: NOT list_contains(seen, y) AND y <> st[-1])) END, CASE WHEN list_contains(seen, st[-1]) THEN seen ELSE list_append(seen, st[-1]) END FROM w LEFT JOIN l ON a = st[-1] WHERE len(st) > 0)
SELECT unnest(seen) AS node_id, CAST(unnest(range(len(seen))) AS INT) AS "order" FROM w WHERE len(st) = 0"""


@query("pagerank_both_trade", _trade_rank_sql(10))
def _(s, d):
    return A.pagerank(trade(s, d), rounds=10, tol=None, direction="both", local_edges=0).withColumn("rank", F.round("rank", 8))


@query("pagerank_both_trade_one_task", _trade_rank_sql(10))
def _(s, d):
    return A.pagerank(trade(s, d), rounds=10, tol=None, direction="both").withColumn("rank", F.round("rank", 8))


# --- steps ---


def _run(g: Graph, *blocks: tuple) -> steps.State:
    return steps.run(g, [{"id": i, "params": p} for i, p in blocks])


def _put(name: str, target: str, **params) -> tuple:
    return name, {"target": target, **params}


@query("steps_variables", f"WITH {_FLOW} SELECT node_id, 7 AS seven, row_number() OVER (ORDER BY node_id) - 1 AS idx, (SELECT count(*) FROM fn) AS nodes, (SELECT count(*) FROM fe) AS edges, region AS r, region AS again, 2.5::DOUBLE AS half, region AS kept FROM fn")
def _(s, d):
    done = _run(flow(s, d), _put("core.init_nodes", "seven", value=7), _put("core.init_nodes_with_index", "idx"), _put("core.graph_node_count", "n"), _put("core.broadcast_scalar", "nodes", source="n"), _put("core.graph_edge_count", "e"), _put("core.broadcast_scalar", "edges", source="e"), _put("core.load_node_attr", "r", attr="region"), _put("alias", "again", source="r"), _put("core.init_scalar", "h", value=2.5), _put("core.broadcast_scalar", "half", source="h"), _put("core.update_in_place", "x", source="again"), ("core.attach_node_attr", {"source": "x", "attr": "kept"}))
    return done.nodes.drop("x").join(done.graph.nodes.select("node_id", "kept"), "node_id")


@query("steps_arithmetic", f"""WITH {_FLOW}, x AS (SELECT node_id, CAST(region AS DOUBLE) AS r, CAST(node_id AS DOUBLE) AS i FROM fn)
SELECT node_id, r + i AS a, r - i AS b, r * i AS c, CASE WHEN i = 0 THEN 0 ELSE r / i END AS d, pow(r, 2) AS e, abs(r - i) AS f, round(sqrt(i), 6) AS g, round(exp(r), 6) AS h, CASE WHEN i > 12 THEN 1 ELSE 0 END AS j, CASE WHEN i > 12 THEN r ELSE i END AS k, least(greatest(i, 3), 9) AS l, least(r, i) AS m, greatest(r, i) AS n, 2 * r + i AS o, r * i + r AS p, round(ln(i + 1), 6) AS q FROM x""")
def _(s, d):
    b = lambda name, target, left, right: _put(f"core.{name}", target, left=left, right=right)
    u = lambda name, target, source: _put(f"core.{name}", target, source=source)
    g = flow(s, d)
    g = Graph(g.nodes.select("node_id", F.col("region").cast("double").alias("region"), F.col("node_id").cast("double").alias("id")), g.edges, True)
    done = _run(
        g, _put("core.load_node_attr", "r", attr="region"), _put("core.load_node_attr", "i", attr="id"),
        b("add", "a", "r", "i"), b("sub", "b", "r", "i"), b("mul", "c", "r", "i"), b("div", "d", "r", "i"), b("pow", "e", "r", 2), u("abs", "f", "b"), u("sqrt", "g", "i"), u("exp", "h", "r"),
        _put("core.compare", "j", left="i", op="gt", right=12), _put("core.where", "k", mask="j", then="r", otherwise="i"), _put("core.clip", "l", source="i", low=3.0, high=9.0),
        b("min", "m", "r", "i"), b("max", "n", "r", "i"), _put("core.fused_axpy", "o", a=2.0, x="r", y="i"), _put("core.fused_madd", "p", a="r", b="i", c="r"), b("add", "i1", "i", 1.0), u("log", "q", "i1"),
    )
    t = done.nodes
    return t.select("node_id", "a", "b", "c", F.col("d").cast("double").alias("d"), "e", "f", r6("g").alias("g"), r6("h").alias("h"), F.col("j").cast("int").alias("j"), "k", "l", "m", "n", "o", "p", r6("q").alias("q"))


@query("steps_reduce", f"WITH {_FLOW}, k AS (SELECT node_id, CAST((SELECT count(*) FROM fe WHERE target = node_id) AS DOUBLE) AS k FROM fn) SELECT sum(k) AS total, avg(k) AS mean, min(k) AS least, max(k) AS most, round(stddev_samp(k), 6) AS sd, median(k) AS med, (SELECT k FROM k GROUP BY 1 ORDER BY count(*) DESC, k LIMIT 1) AS often, quantile_cont(k, 0.9) AS high FROM k")
def _(s, d):
    g = flow(s, d)
    g = Graph(g.nodes.join(g.degree("in").select("node_id", F.col("degree").cast("double").alias("k")), "node_id"), g.edges, True)
    done = _run(g, _put("core.load_node_attr", "k", attr="k"), *[_put("core.reduce_scalar", n, source="k", how=h) for n, h in (("total", "sum"), ("least", "min"), ("most", "max"))], _put("core.reduce_nodes", "mean", source="k", how="mean"), *[_put(f"core.{h}", n, source="k") for n, h in (("sd", "std"), ("med", "median"), ("often", "mode"))], _put("core.quantile", "high", source="k", q=0.9))
    names = ("total", "mean", "least", "most", "sd", "med", "often", "high")
    return s.createDataFrame([tuple(round(float(done.scalars[n]), 6) for n in names)], ", ".join(f"{n} double" for n in names))


@query("steps_edges", f"WITH {_FLOW} SELECT source, target, 1 AS one, w AS load, w * 0.5::DOUBLE AS half, w - w * 0.75::DOUBLE AS room, w * 0.75::DOUBLE AS used, (SELECT CAST(sum(w) AS DOUBLE) FROM fe) AS total FROM fe")
def _(s, d):
    done = _run(flow(s, d), _put("core.init_edges", "one", value=1), _put("core.load_edge_attr", "load", attr="w"), _put("core.edge_weight_scale", "half", source="load", factor=0.5), _put("core.edge_weight_scale", "quarter", source="load", factor=0.25), _put("core.flow_update", "used", flow="half", delta="quarter"), _put("core.residual_capacity", "room", capacity="load", flow="used"), _put("core.edge_weight_sum", "sum", weight="w"), ("core.attach_edge_attr", {"source": "half", "attr": "h"}))
    return done.edges.join(done.graph.edges.select("edge_id", "h"), "edge_id").select("source", "target", "one", "load", F.col("h").alias("half"), "room", "used", F.lit(float(done.scalars["sum"])).alias("total"))


@query("steps_neighbors", f"""WITH {_FLOW}, i AS (SELECT target AS n, region AS r FROM fe JOIN fn ON source = node_id), md AS (SELECT n, r AS m FROM (SELECT n, r, row_number() OVER (PARTITION BY n ORDER BY count(*) DESC, r) AS k FROM i GROUP BY 1, 2) WHERE k = 1)
SELECT node_id, coalesce((SELECT string_agg(CAST(r AS VARCHAR), ',' ORDER BY r) FROM i WHERE n = node_id), '') AS near, m AS often, coalesce(m, region) AS next, CAST((SELECT coalesce(sum(f.region * 2), 0) FROM fe JOIN fn f ON source = f.node_id WHERE target = fn.node_id) AS BIGINT) AS twice, round(region / (SELECT sum(region) FROM fn), 8) AS share, round((region - (SELECT avg(region) FROM fn)) / (SELECT stddev_pop(region) FROM fn), 6) AS z FROM fn LEFT JOIN md ON n = node_id""")
def _(s, d):
    done = _run(flow(s, d), _put("core.load_node_attr", "r", attr="region"), _put("core.collect_neighbor_values", "near", source="r"), _put("core.mode_list", "often", source="near"), _put("core.neighbor_mode_update", "next", source="r"), _put("core.init_nodes", "two", value=2), _put("graph.fused_neighbor_mul_agg", "twice", values="r", multipliers="two"), _put("core.normalize_node_values", "share", source="r"), _put("core.standardize", "z", source="r"))
    return done.nodes.select("node_id", F.array_join(F.array_sort("near").cast("array<string>"), ",").alias("near"), "often", "next", F.col("twice").cast("long").alias("twice"), F.round("share", 8).alias("share"), r6("z").alias("z"))


@query("steps_select", f"""WITH {_FLOW}, a AS (SELECT node_id, region FROM fn WHERE region >= 1), e AS (SELECT * FROM fe WHERE source IN (SELECT node_id FROM a) AND target IN (SELECT node_id FROM a)), f AS (SELECT * FROM e WHERE w >= 2)
SELECT node_id, row_number() OVER (ORDER BY region DESC, node_id) - 1 AS place, CASE WHEN row_number() OVER (ORDER BY region DESC, node_id) <= 3 THEN row_number() OVER (ORDER BY region DESC, node_id) - 1 END AS top, node_id AS seed, (SELECT count(*) FROM f) AS edges FROM a""")
def _(s, d):
    done = _run(flow(s, d), ("core.filter_nodes_by_attr", {"predicate": "region >= 1"}), ("core.filter_edges_by_attr", {"predicate": "w >= 2"}), _put("core.load_node_attr", "r", attr="region"), _put("core.sort_nodes_by_attr", "place", source="r", ascending=False), _put("core.top_k", "top", source="r", k=3), _put("core.community_seed", "seed"), _put("core.graph_edge_count", "edges"), _put("core.broadcast_scalar", "edges", source="edges"))
    return done.nodes.drop("r")


@query("steps_paths", f"WITH RECURSIVE {_FLOW}, w AS (SELECT 3::BIGINT AS node_id, 0 AS k UNION SELECT target, k + 1 FROM w JOIN fe ON source = node_id WHERE k < 25), m AS (SELECT node_id, CAST(min(k) AS DOUBLE) AS d FROM w GROUP BY 1), c AS (SELECT a AS n, y.region AS q, count(*) AS k FROM (SELECT source AS a, target AS b FROM fe UNION ALL SELECT target, source FROM fe) JOIN fn x ON a = x.node_id JOIN fn y ON b = y.node_id WHERE x.region <> y.region GROUP BY 1, 2) SELECT fn.node_id, d AS far, round(coalesce((SELECT max(k) FROM c WHERE n = fn.node_id), 0) / (2.0 * (SELECT count(*) FROM fe)), 8) AS gain, 5 AS drawn, 7 AS edges FROM fn LEFT JOIN m USING (node_id)")
def _(s, d):
    done = _run(flow(s, d), _put("core.init_nodes_with_index", "i"), _put("core.compare", "start", left="i", op="eq", right=3), _put("core.shortest_path_map", "far", source="start"), _put("core.load_node_attr", "r", attr="region"), _put("core.modularity_gain", "gain", source="r"), _put("core.sample_nodes", "s", k=5), _put("core.reduce_scalar", "drawn", source="s", how="sum"), _put("core.broadcast_scalar", "drawn", source="drawn"), _put("core.sample_edges", "t", k=7))
    return done.nodes.select("node_id", "far", F.round("gain", 8).alias("gain"), F.col("drawn").cast("int").alias("drawn")).crossJoin(F.broadcast(done.edges.agg(F.sum("t").cast("int").alias("edges"))))


@query("steps_loop", f"WITH {_FLOW}, x AS (SELECT node_id, 1.0::DOUBLE AS x0 FROM fn) SELECT node_id, 1 + 0.5::DOUBLE * 1 + 0.25::DOUBLE + 0.125::DOUBLE AS x FROM x")
def _(s, d):
    done = _run(flow(s, d), _put("core.init_nodes", "x", value=1.0), _put("core.init_nodes", "p", value=1.0), ("iter.loop", {"rounds": 3, "body": [{"id": "core.mul", "params": {"left": "p", "right": 0.5, "target": "p"}}, {"id": "core.add", "params": {"left": "x", "right": "p", "target": "x"}}]}))
    return done.nodes.select("node_id", "x")


@query("steps_groups", f"WITH RECURSIVE {_FLOW}, a AS (SELECT node_id, region FROM fn WHERE region <> 2), e AS (SELECT source, target FROM fe WHERE source IN (SELECT node_id FROM a) AND target IN (SELECT node_id FROM a)), b AS (SELECT DISTINCT x, y FROM (SELECT source AS x, target AS y FROM e UNION ALL SELECT target, source FROM e)), w AS (SELECT node_id, node_id AS c FROM a UNION SELECT y, c FROM w JOIN b ON x = node_id) SELECT node_id, coalesce((SELECT string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) FROM b WHERE x = a.node_id), '') AS near, (SELECT min(c) FROM w WHERE w.node_id = a.node_id) AS component, (SELECT CAST(sum(z.node_id) AS BIGINT) FROM a z WHERE z.region = a.region) AS total FROM a")
def _(s, d):
    done = _run(flow(s, d, False), _put("core.load_node_attr", "r", attr="region"), _put("core.compare", "keep", left="r", op="ne", right=2), ("graph.subgraph", {"mask": "keep"}), _put("graph.neighbors", "near"), _put("graph.connected_components", "component"), _put("core.map_nodes", "id", expr="r * 0"), _put("core.init_nodes_with_index", "place"), _put("attr.groupby", "total", source="node_id", labels="r", how="sum"))
    return done.nodes.select("node_id", F.array_join(F.col("near").cast("array<string>"), ",").alias("near"), "component", "total")


@query("steps_until_converged", "SELECT CAST(n_nationkey AS BIGINT) AS node_id, 2.0::DOUBLE AS x FROM nation")
def _(s, d):
    """x goes to 1 + x / 2 until it stands still."""
    done = _run(flow(s, d), _put("core.init_nodes", "x", value=0.0), ("iter.until_converged", {"watched": "x", "tol": 0.01, "body": [{"id": "core.mul", "params": {"left": "x", "right": 0.5, "target": "x"}}, {"id": "core.add", "params": {"left": "x", "right": 1.0, "target": "x"}}]}))
    return done.nodes.select("node_id", F.round("x", 1).alias("x"))


# --- arrays ---


def _prices(s, d) -> Array:
    return Array.from_column(read(s, d, "part"), "p_retailprice", "p_partkey")


@query("array_reduce", "SELECT round(sum(p_retailprice), 2) AS total, round(min(p_retailprice), 2) AS low, round(max(p_retailprice), 2) AS high, round(sum(2 * p_retailprice + 1), 2) AS moved FROM part")
def _(s, d):
    a = _prices(s, d)
    return s.createDataFrame([(round(float(a.reduce("sum")), 2), float(a.reduce("min")), float(a.reduce("max")), round(float(a.multiply(2).add(1).reduce("sum")), 2))], "total double, low double, high double, moved double")


@query("array_elementwise", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ord, round(p_retailprice + p_size, 2) AS a, round(p_retailprice - p_size, 2) AS b, round(p_retailprice * p_size, 2) AS c, round(p_retailprice / p_size, 6) AS d FROM part")
def _(s, d):
    p, q = _prices(s, d), Array.from_column(read(s, d, "part"), "p_size", "p_partkey")
    out = p.df.select("ord")
    for n, a, k in (("a", p.add(q), 2), ("b", p.subtract(q), 2), ("c", p.multiply(q), 2), ("d", p.divide(q), 6)):
        out = out.join(a.df.select("ord", F.round(F.col("value").cast("double"), k).alias(n)), "ord")
    return out


@query("array_shape", "WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS o, p_retailprice AS v, (SELECT count(*) FROM part) AS n FROM part) SELECT 'tail' AS name, o - n + 4 AS ord, v AS value FROM p WHERE o >= n - 4 UNION ALL SELECT 'head', o, v FROM p WHERE o < 3 UNION ALL SELECT 'reverse', n - 1 - o, v FROM p UNION ALL SELECT 'twice', o, v FROM p UNION ALL SELECT 'twice', n + o, v FROM p UNION ALL SELECT 'set', o, CASE WHEN o = 2 THEN 1.5 ELSE v END FROM p WHERE o < 4")
def _(s, d):
    a = _prices(s, d)
    return interleave({"tail": a.tail(4), "head": a.head(3), "reverse": a.reverse(), "twice": a.concat(a), "set": a.set(2, 1.5).slice(0, 4)})


@query("array_masks", "WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS o, p_size > 25 AS b, p_retailprice AS v FROM part) SELECT 'nonzero' AS name, row_number() OVER (ORDER BY o) - 1 AS ord, CAST(o AS DOUBLE) AS value FROM p WHERE b UNION ALL SELECT 'false', row_number() OVER (ORDER BY o) - 1, o FROM p WHERE NOT b UNION ALL SELECT 'masked', row_number() OVER (ORDER BY o) - 1, v FROM p WHERE b UNION ALL SELECT 'isin', row_number() OVER (ORDER BY o) - 1, CAST(p_size IN (1, 2, 3) AS INT) FROM (SELECT p_partkey AS o, p_size FROM part)")
def _(s, d):
    size = Array.from_column(read(s, d, "part"), "p_size", "p_partkey")
    b = size.map(lambda c: c > 25)
    number = lambda a: Array(a.df.withColumn("value", F.col("value").cast("double")))
    return interleave({"nonzero": number(b.nonzero()), "false": number(b.false_indices()), "masked": number(_prices(s, d).apply_mask(b)), "isin": number(size.isin([1, 2, 3]).map(lambda c: c.cast("int")))})


@query("array_truth", "SELECT 'sizes' AS name, count(*) FILTER (b) AS count_true, count(*) FILTER (NOT b) AS count_false, bool_or(b) AS any, bool_and(b) AS all, round(100.0 * count(*) FILTER (b) / count(*), 6) AS percentage FROM (SELECT p_size > 25 AS b FROM part) UNION ALL SELECT 'ones', 12, 0, true, true, 100 UNION ALL SELECT 'zeros', 0, 9, false, false, 0 UNION ALL SELECT 'both', 3, 1, true, false, 75")
def _(s, d):
    sizes = Array.from_column(read(s, d, "part"), "p_size", "p_partkey").map(lambda c: c > 25)
    both = Array.bools(s, [True, False, True, False]).logical_or(Array.bools(s, [True, True, False, False])).logical_and(Array.ones_bool(s, 4))
    named = {"sizes": sizes, "ones": Array.ones_bool(s, 12), "zeros": Array.zeros_bool(s, 9), "both": both}
    out = None
    for n, a in named.items():
        part = a.truth().select(F.lit(n).alias("name"), "count_true", "count_false", "any", "all", r6("percentage").alias("percentage"))
        out = part if out is None else out.unionByName(part)
    return out


@query("array_nulls", "WITH e AS (SELECT event_id AS o, CASE WHEN event_type = 'click' THEN NULL ELSE value END AS v FROM events) SELECT count(*) AS elements, count(*) FILTER (v IS NULL) AS nulls, count(v) * 8 AS bytes, (SELECT count(*) FROM e WHERE v IS NOT NULL) AS kept, (SELECT round(sum(coalesce(v, 1)), 4) FROM e) AS filled, (SELECT count(DISTINCT user_id) FROM events) AS ids FROM e")
def _(s, d):
    e = read(s, d, "events")
    a = Array.from_column(e, F.when(F.col("event_type") != "click", F.col("value").cast("double")), "event_id")
    users = Array.from_column(e, "user_id", "event_id")
    row = a.memory()
    return row.select("elements", "nulls", "bytes", F.lit(len(a.dropna())).cast("long").alias("kept"), F.lit(round(a.fillna(1.0).reduce("sum"), 4)).alias("filled"), F.lit(users.as_node_ids().count()).cast("long").alias("ids"))


@query("array_unique", "SELECT row_number() OVER (ORDER BY o) - 1 AS ord, event_type AS value FROM (SELECT event_type, min(event_id) AS o FROM events GROUP BY 1)")
def _(s, d):
    return Array.from_column(read(s, d, "events"), "event_type", "event_id").unique().df


@query("array_each", "SELECT 'price' AS name, round(sum(p_retailprice), 2) AS sum, min(p_retailprice) AS min, round(avg(p_retailprice), 6) AS mean FROM part UNION ALL SELECT 'size', sum(p_size), min(p_size), round(avg(p_size), 6) FROM part")
def _(s, d):
    rows = interleave({"price": _prices(s, d), "size": Array.from_column(read(s, d, "part"), F.col("p_size").cast("double"), "p_partkey")})
    return aggregate_each(rows, "sum", "min", "mean").select("name", F.round(F.col("sum").cast("double"), 2).alias("sum"), F.col("min").cast("double").alias("min"), r6(F.col("mean").cast("double")).alias("mean"))


# --- tables ---


@query("asof_join_forward", "SELECT a.event_id, b.event_id AS event_id_right FROM events a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts <= b.ts WHERE a.event_type = 'purchase'")
def _(s, d):
    e = read(s, d, "events").select("event_id", "user_id", "ts", "event_type")
    return Table(e.where("event_type = 'purchase'")).asof_join(Table(e.where("event_type = 'click'").select("user_id", "ts", "event_id")), "ts", ["user_id"], "forward").df.select("event_id", "event_id_right")


@query("asof_join_strict", "SELECT a.event_id, b.event_id AS event_id_right FROM events a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts > b.ts WHERE a.event_type = 'view'")
def _(s, d):
    e = read(s, d, "events").select("event_id", "user_id", "ts", "event_type")
    return Table(e.where("event_type = 'view'")).asof_join(Table(e.select("user_id", "ts", "event_id")), "ts", ["user_id"], strict=True).df.select("event_id", "event_id_right")


@query("table_reverse", "SELECT n_nationkey, (SELECT count(*) FROM nation) - 1 - n_nationkey AS ord FROM nation")
def _(s, d):
    return Table(read(s, d, "nation")).ordered("n_nationkey").reverse().df.select("n_nationkey", "ord")


@query("table_arrays_join", "SELECT x.p_size AS part, x.p_partkey, round(x.p_retailprice - y.m, 4) AS over FROM part x JOIN (SELECT p_size, p_partkey, p_retailprice / 2 AS m FROM part WHERE p_partkey % 2 = 0) y USING (p_size, p_partkey)")
def _(s, d):
    p = read(s, d, "part").select(F.col("p_size").alias("part"), "p_partkey", F.col("p_retailprice").cast("double").alias("price"))
    half = Tables(p.where("p_partkey % 2 = 0").select("part", "p_partkey", (F.col("price") / 2).alias("m")))
    return Tables(p).join(half, "p_partkey").map(over=F.round(F.col("price") - F.col("m"), 4)).df.select("part", "p_partkey", "over")


@query("table_arrays_agg", "SELECT p_size AS part, round(sum(p_retailprice), 2) AS price_sum, count(*) AS key_count FROM part GROUP BY 1")
def _(s, d):
    p = Tables(read(s, d, "part").select(F.col("p_size").alias("part"), F.col("p_partkey").alias("key"), F.col("p_retailprice").cast("double").alias("price")))
    return p.agg({"price": "sum", "key": "count"}).select("part", F.round("price_sum", 2).alias("price_sum"), "key_count")


@query("spearman_weighted", "WITH c AS (SELECT CAST(p_size AS DOUBLE) AS a, p_retailprice AS b FROM part), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS y FROM c) SELECT round(corr(x, y), 8) AS corr FROM r")
def _(s, d):
    return Table(read(s, d, "part")).corr("p_size", "p_retailprice", "spearman").select(F.round("corr", 8).alias("corr"))


# --- collections of subgraphs ---


@query("parts_sizes", f"WITH {_TRADE} SELECT CAST(nation AS BIGINT) AS part, count(*) AS nodes, (SELECT count(*) FROM te JOIN tn x ON source = x.node_id JOIN tn y ON target = y.node_id WHERE x.nation = y.nation AND x.nation = tn.nation) AS edges FROM tn GROUP BY tn.nation")
def _(s, d):
    return Subgraphs.by_attribute(trade(s, d), "nation").sizes().withColumn("part", F.col("part").cast("long"))


@query("parts_stats", f"WITH {_TRADE}, z AS (SELECT nation, count(*) AS n FROM tn GROUP BY 1) SELECT count(*) AS parts, sum(n) AS total_nodes, (SELECT count(*) FROM te JOIN tn x ON source = x.node_id JOIN tn y ON target = y.node_id WHERE x.nation = y.nation) AS total_edges, min(n) AS least, round(avg(n), 6) AS mean, max(n) AS most FROM z")
def _(s, d):
    return Subgraphs.by_attribute(trade(s, d), "nation").stats().withColumn("mean", r6("mean"))


@query("parts_filter", f"WITH {_TRADE}, z AS (SELECT nation FROM tn GROUP BY 1 HAVING count(*) >= (SELECT count(*) / 25 FROM tn)) SELECT node_id, CAST(nation AS BIGINT) AS part FROM tn WHERE nation IN (FROM z) AND balance > 0")
def _(s, d):
    g = trade(s, d)
    p = Subgraphs.by_attribute(g, "nation").filter(F.col("nodes") >= g.nodes.count() / 25).filter_nodes("balance > 0")
    return p.members.select("node_id", F.col("part").cast("long").alias("part"))


@query("parts_tables", f"WITH {_TRADE} SELECT CAST(x.nation AS BIGINT) AS part, source, target, round(w, 2) AS w FROM te JOIN tn x ON source = x.node_id JOIN tn y ON target = y.node_id WHERE x.nation = y.nation")
def _(s, d):
    return Subgraphs.by_attribute(trade(s, d), "nation").edges_table().select(F.col("part").cast("long").alias("part"), "source", "target", F.round("w", 2).alias("w"))


@query("parts_attribute", f"WITH {_TRADE} SELECT CAST(nation AS BIGINT) AS part, round(avg(balance), 4) AS value FROM tn GROUP BY 1")
def _(s, d):
    return Subgraphs.by_attribute(trade(s, d), "nation").attribute("balance", "mean").select(F.col("part").cast("long").alias("part"), F.round("value", 4).alias("value"))


@query("parts_neighborhood", f"WITH {_FLOW}, z AS (SELECT region AS part, node_id FROM fn WHERE region < 2) SELECT part, node_id FROM z UNION SELECT part, b FROM z JOIN fadj ON a = node_id")
def _(s, d):
    g = flow(s, d)
    return Subgraphs(g, g.nodes.where("region < 2").select(F.col("region").alias("part"), "node_id")).neighborhood().members


@query("parts_neighborhoods_of", f"WITH {_FLOW}, z AS (SELECT node_id FROM fn WHERE node_id < 4) SELECT node_id AS part, node_id FROM z UNION SELECT a, b FROM z JOIN fadj ON a = node_id")
def _(s, d):
    g = flow(s, d, False)
    return Subgraphs.neighborhoods(g, g.nodes.where("node_id < 4").select("node_id")).members


@query("parts_endpoints", f"WITH {_TRADE} SELECT DISTINCT CAST(x.nation AS BIGINT) AS part, unnest([source, target]) AS node_id FROM te JOIN tn x ON source = x.node_id JOIN tn y ON target = y.node_id WHERE x.nation = y.nation")
def _(s, d):
    return Subgraphs.by_attribute(trade(s, d), "nation").endpoints().withColumn("part", F.col("part").cast("long"))


@query("matrix_arrays", "SELECT 3 AS matrices, 2 AS least_rows, round(7 / 3, 6) AS mean_rows, 3 AS most_rows, 2 AS least_cols, round(7 / 3, 6) AS mean_cols, 3 AS most_cols")
def _(s, d):
    return _three(s).dimension_stats().select("matrices", "least_rows", r6("mean_rows").alias("mean_rows"), "most_rows", "least_cols", r6("mean_cols").alias("mean_cols"), "most_cols")


@query("matrix_arrays_eigen", "SELECT * FROM (VALUES (1, 3.0), (2, 2.0), (3, 2.5)) v(part, mean_eigenvalue)")
def _(s, d):
    return _three(s).eigenvalues().select("part", r6("mean_eigenvalue").alias("mean_eigenvalue"))


@query("matrix_arrays_corr", "WITH c AS (SELECT unnest([4.0, 1, 1, 2]) AS x, unnest([3.0, 0, 1, 2]) AS y) SELECT 1 AS part, 3 AS other, round(corr(x, y), 6) AS corr FROM c")
def _(s, d):
    return _three(s).correlation().select("part", "other", r6("corr").alias("corr"))


def _three(s) -> Matrices:
    given = {1: [[4, 1], [1, 2]], 2: [[1, 0, 0], [0, 2, 0], [0, 0, 3]], 3: [[3, 0], [1, 2]]}
    cells = [(k, i, j, float(v)) for k, m in given.items() for i, r in enumerate(m) for j, v in enumerate(r) if v]
    return Matrices(s.createDataFrame(cells, "part int, i long, j long, v double"), s.createDataFrame([(k, len(m), len(m[0])) for k, m in given.items()], "part int, rows int, cols int"))


# --- criteria ---


@query("criteria_nested", f"WITH {_TRADE}, k AS (SELECT node_id, count(a) AS k FROM tn LEFT JOIN tadj ON a = node_id GROUP BY 1), rich AS (SELECT node_id FROM tn WHERE balance > 9000) SELECT node_id FROM tn JOIN k USING (node_id) WHERE (nation = 3 OR k BETWEEN 1 AND 30) AND NOT kind = 'supplier' AND node_id IN (SELECT a FROM tadj WHERE b IN (SELECT node_id FROM tn WHERE nation < 20))")
def _(s, d):
    return C.matching(trade(s, d), (C.Attribute("nation", "=", 3) | C.Degree(1, 30)) & ~C.Where("kind = 'supplier'") & C.Adjacent(C.Attribute("nation", "<", 20))).nodes.select("node_id")


@query("criteria_batch", f"WITH {_TRADE} SELECT 'rich' AS name, node_id FROM tn WHERE balance > 9000 UNION ALL SELECT 'poor', node_id FROM tn WHERE balance <= 0 UNION ALL SELECT 'known', node_id FROM tn WHERE balance IS NOT NULL")
def _(s, d):
    return C.batch(trade(s, d), {"rich": C.Attribute("balance", ">", 9000), "poor": C.Attribute("balance", "<=", 0), "known": C.Has("balance")})


@query("criteria_edges", f"WITH {_TRADE} SELECT source, target FROM te WHERE n >= 2 AND source IN (SELECT node_id FROM tn WHERE nation <> 4) AND target IN (SELECT node_id FROM tn WHERE balance >= 0)")
def _(s, d):
    return C.edges_matching(trade(s, d), "n >= 2", C.Attribute("nation", "!=", 4), C.Attribute("balance", ">=", 0)).select("source", "target")


# --- hierarchies ---


def _tower(s, d) -> Hierarchy:
    """Nations, regions and one node over both."""
    g = flow(s, d)
    h = Hierarchy((g,)).collapse(g.nodes.select("node_id", (F.col("region") + 100).alias("part")), Plan({"first": ("min", "node_id")}, {"w": ("sum", "w")}))
    return h.collapse(h.top.nodes.select("node_id", (F.floor((F.col("node_id") - 100) / 3) + 1000).cast("long").alias("part")), Plan({"first": ("min", "first")}, {"w": ("sum", "w")}))


@query("hierarchy_root", f"WITH {_FLOW} SELECT node_id, CAST(region // 3 + 1000 AS BIGINT) AS root FROM fn")
def _(s, d):
    return _tower(s, d).root()


@query("hierarchy_parents", f"WITH {_FLOW} SELECT node_id, region + 100 AS parent FROM fn UNION ALL SELECT DISTINCT region + 100, CAST(region // 3 + 1000 AS BIGINT) FROM fn")
def _(s, d):
    h = _tower(s, d)
    return h.parent(0).unionByName(h.parent(1))


@query("hierarchy_children", f"WITH {_FLOW} SELECT DISTINCT CAST(region // 3 + 1000 AS BIGINT) AS meta_id, region + 100 AS node_id FROM fn")
def _(s, d):
    return _tower(s, d).children(2)


@query("hierarchy_is_meta", f"WITH {_FLOW} SELECT node_id, false AS is_meta FROM fn UNION ALL SELECT DISTINCT region + 100, true FROM fn")
def _(s, d):
    h = _tower(s, d)
    return h.is_meta(0).unionByName(h.is_meta(1))


@query("hierarchy_re_aggregate", f"WITH {_FLOW} SELECT CAST(region // 3 + 1000 AS BIGINT) AS node_id, count(*) AS size, CAST(sum(region) AS BIGINT) AS total, string_agg(DISTINCT CAST(region AS VARCHAR), '-' ORDER BY CAST(region AS VARCHAR)) AS regions FROM fn GROUP BY 1")
def _(s, d):
    return _tower(s, d).re_aggregate({"size": ("count", "region"), "total": ("sum", "region"), "regions": ("concat_unique:-", "region")})


@query("hierarchy_meta_edges", f"WITH {_FLOW} SELECT x.region // 3 + 1000 AS source, y.region // 3 + 1000 AS target, count(*) AS n FROM fe JOIN fn x ON source = x.node_id JOIN fn y ON target = y.node_id WHERE x.region // 3 <> y.region // 3 GROUP BY 1, 2")
def _(s, d):
    return _tower(s, d).meta_edges().groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


@query("hierarchy_expand", f"WITH {_FLOW} SELECT source, target FROM fe JOIN fn x ON source = x.node_id JOIN fn y ON target = y.node_id WHERE x.region >= 3 AND y.region >= 3")
def _(s, d):
    return _tower(s, d).expand(1001).edges.select("source", "target")


@query("plan_preview", f"WITH {_FLOW}, p AS (SELECT node_id, region FROM fn WHERE region < 3) SELECT (SELECT count(DISTINCT region) FROM p) AS meta_nodes, (SELECT count(*) FROM p) AS nodes, count(*) FILTER (x.region = y.region) AS inside, count(*) FILTER (x.region IS DISTINCT FROM y.region) AS leaving FROM fe LEFT JOIN p x ON source = x.node_id LEFT JOIN p y ON target = y.node_id WHERE x.region IS NOT NULL OR y.region IS NOT NULL")
def _(s, d):
    g = flow(s, d)
    return preset("social_network", "region", "w").preview(g, g.nodes.where("region < 3").select("node_id", "region"))


@query("collapse_strategies", f"WITH {_FLOW}, e AS (SELECT x.region AS a, y.region AS b, w FROM fe JOIN fn x ON source = x.node_id JOIN fn y ON target = y.node_id) SELECT 'aggregate' AS strategy, count(*) AS edges FROM (SELECT DISTINCT a, b FROM e WHERE a <> b) UNION ALL SELECT 'keep_external', count(*) FROM e WHERE a <> b UNION ALL SELECT 'drop_all', 0 UNION ALL SELECT 'contract_all', count(*) FROM (SELECT DISTINCT a, b FROM e)")
def _(s, d):
    g, out = flow(s, d), None
    for name in ("aggregate", "keep_external", "drop_all", "contract_all"):
        made = collapse(g, g.nodes.select("node_id", "region"), Plan({"size": ("count", "node_id")}, {"w": ("sum", "w")}, name))
        part = made.edges.agg(F.lit(name).alias("strategy"), F.count(F.lit(1)).alias("edges"))
        out = part if out is None else out.unionByName(part)
    return out


@query("org_preset", f"WITH {_FLOW} SELECT region AS node_id, count(*) AS size, CAST(sum(region) AS BIGINT) AS sum_region FROM fn GROUP BY 1")
def _(s, d):
    g = flow(s, d)
    return collapse(g, g.nodes.select("node_id", "region"), preset("org_hierarchy", "region", "w")).nodes.select("node_id", "size", "sum_region")


@query("add_subgraphs", f"WITH {_FLOW}, z AS (SELECT node_id, 1000 + region AS m FROM fn WHERE region < 2), b AS (SELECT source AS a, target AS b, w FROM fe UNION ALL SELECT target, source, w FROM fe) SELECT CAST(x.m AS BIGINT) AS source, b.b AS target, count(*) AS edge_count, CAST(sum(w) AS BIGINT) AS w FROM b JOIN z x ON a = x.node_id WHERE NOT EXISTS (SELECT 1 FROM z y WHERE y.node_id = b.b AND y.m = x.m) GROUP BY 1, 2")
def _(s, d):
    g = flow(s, d)
    made = add_subgraphs(g, {1000 + k: g.nodes.where(F.col("region") == k).select("node_id") for k in (0, 1)}, Plan({}, {"w": ("sum", "w")}))
    return made.edges.where("edge_count IS NOT NULL").select("source", "target", "edge_count", "w")


# --- history and branches ---


@query("lifetimes", "SELECT user_id AS id, min(event_id) AS created, NULL::BIGINT AS deleted FROM events GROUP BY 1")
def _(s, d):
    return history(s, d).lifetimes().select("id", "created", "deleted")


@query("alive_in_window", "SELECT user_id AS id FROM events GROUP BY 1 HAVING min(event_id) <= 90")
def _(s, d):
    return Scope(history(s, d), 50, 90).nodes().select("id")


@query("commit_at_time", "SELECT max(event_id) AS commit_id FROM events WHERE ts <= (SELECT ts FROM events WHERE event_id = 333)")
def _(s, d):
    at = read(s, d, "events").where("event_id = 333").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    return values(s, [(None if at is None else history(s, d).commit_at(at),)], "commit_id long")


@query("value_as_of", "SELECT a.user_id AS id, a.event_id AS commit_id, b.value FROM events a ASOF LEFT JOIN (SELECT user_id, event_id, value FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.event_id >= b.event_id WHERE a.event_type = 'click'")
def _(s, d):
    asks = read(s, d, "events").where("event_type = 'click'").select(F.col("user_id").alias("id"), F.lit("view").alias("attr"), F.col("event_id").alias("commit_id"))
    return history(s, d).as_of(asks).select("id", "commit_id", F.col("value").cast("double").alias("value"))


@query("window_statistics", "SELECT user_id AS id, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last FROM events WHERE event_type = 'view' AND event_id BETWEEN 10 AND 900 GROUP BY 1")
def _(s, d):
    scope, out = Scope(history(s, d), 10, 900), None
    for name, how in (("n", "count"), ("mean", "mean"), ("low", "min"), ("high", "max"), ("first", "first"), ("last", "last")):
        part = scope.aggregate("view", how).withColumnRenamed("value", name)
        out = part if out is None else out.join(part, "id")
    return out.select("id", F.col("n").cast("long").alias("n"), r6("mean").alias("mean"), "low", "high", "first", "last")


@query("history_statistics", "SELECT count(*) AS commits, count(*) + count(DISTINCT user_id) AS changes, count(DISTINCT user_id) AS entities FROM events")
def _(s, d):
    return history(s, d).statistics()


@query("commits_between", "SELECT event_id AS commit_id FROM events WHERE ts BETWEEN (SELECT min(ts) FROM events) AND (SELECT ts FROM events WHERE event_id = 60)")
def _(s, d):
    e = read(s, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    low, high = e.agg(F.min("t"), F.max(F.when(F.col("event_id") == 60, F.col("t")))).first()
    return history(s, d).commits_between(low, high).select("commit_id")


def _repo(s) -> Repository:
    """main: 0, 1, 4 (merge); side: 0, 2, 3."""
    add = lambda *ids: [("node", "add", i, None, None, None, None) for i in ids]
    link = lambda i, a, b: [("edge", "add", i, a, b, None, None)]
    put = lambda i, attr, v: [("node", "set", i, None, None, attr, v)]
    frame = lambda rows: values(s, rows, CHANGES.replace("commit_id long, ", ""))
    repo = Repository(History(values(s, [], COMMITS), values(s, [], CHANGES)), {"main": None})
    repo.stage(frame(add(1, 2, 3) + link(10, 1, 2) + put(1, "colour", "red")))
    repo.commit("a", "first", 100)
    repo.create_branch("side")
    repo.stage(frame(link(11, 2, 3) + put(2, "colour", "blue")))
    repo.commit("a", "second", 200)
    repo.checkout("side")
    repo.stage(frame(add(4) + put(1, "colour", "green")))
    repo.commit("b", "third", 300)
    repo.stage(frame(link(12, 1, 4)))
    repo.commit("b", "fourth", 400)
    repo.checkout("main")
    repo.merge("side", "a", "both", 500)
    return repo


@query("branches", "SELECT * FROM (VALUES ('main', 4, true), ('side', 3, false), ('tip', 1, false)) v(branch, head, current)")
def _(s, d):
    repo = _repo(s)
    repo.create_branch("tip", 1)
    repo.create_branch("gone", 2)
    repo.delete_branch("gone")
    repo.stage(values(s, [("node", "add", 9, None, None, None, None)], CHANGES.replace("commit_id long, ", "")))
    if not repo.has_uncommitted_changes():
        raise AssertionError("staged changes are lost")
    repo.reset_hard()
    if repo.has_uncommitted_changes():
        raise AssertionError("staged changes stay")
    return repo.branches()


@query("branch_log", "SELECT * FROM (VALUES ('main', 0), ('main', 1), ('main', 2), ('main', 3), ('main', 4), ('side', 0), ('side', 2), ('side', 3)) v(branch, commit_id)")
def _(s, d):
    repo = _repo(s)
    return repo.log("main").select(F.lit("main").alias("branch"), "commit_id").unionByName(repo.log("side").select(F.lit("side").alias("branch"), "commit_id"))


@query("branch_snapshots", "SELECT * FROM (VALUES ('second', 1, 'red'), ('second', 2, 'blue'), ('second', 3, NULL), ('fourth', 1, 'green'), ('fourth', 2, NULL), ('fourth', 3, NULL), ('fourth', 4, NULL), ('merged', 1, 'green'), ('merged', 2, 'blue'), ('merged', 3, NULL), ('merged', 4, NULL)) v(moment, node_id, colour)")
def _(s, d):
    repo, out = _repo(s), None
    for name, commit in (("second", 1), ("fourth", 3), ("merged", 4)):
        part = repo.snapshot(commit).nodes.select(F.lit(name).alias("moment"), "node_id", "colour")
        out = part if out is None else out.unionByName(part)
    return out


@query("branch_edges", "SELECT * FROM (VALUES ('second', 10), ('second', 11), ('fourth', 10), ('fourth', 12), ('merged', 10), ('merged', 11), ('merged', 12)) v(moment, edge_id)")
def _(s, d):
    repo, out = _repo(s), None
    for name, commit in (("second", 1), ("fourth", 3), ("merged", 4)):
        part = repo.snapshot(commit).edges.select(F.lit(name).alias("moment"), "edge_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("ancestry", "SELECT 0 AS common, true AS first_of_both, false AS second_of_side, 5 AS reach_main, 3 AS kept")
def _(s, d):
    repo = _repo(s)
    h = repo.history
    return s.createDataFrame([(h.common_ancestor(1, 3), h.is_ancestor(0, 3) and h.is_ancestor(0, 1), h.is_ancestor(1, 3), h.ancestors(4).count(), h.collect_garbage([3]).commits.count())], "common long, first_of_both boolean, second_of_side boolean, reach_main long, kept long")


@query("neighbors_then", "SELECT * FROM (VALUES ('first', 1, 2), ('first', 2, 1), ('window', 1, 2), ('window', 2, 1), ('window', 2, 3), ('window', 3, 2)) v(moment, node_id, neighbor_id)")
def _(s, d):
    h = _repo(s).line(1)
    return h.neighbors_at(0).select(F.lit("first").alias("moment"), "node_id", "neighbor_id").unionByName(h.neighbors_in(0, 1).select(F.lit("window").alias("moment"), "node_id", "neighbor_id"))


# --- matrices ---

_A = [[4.0, 1.0, 0.0], [1.0, 3.0, 1.0], [0.0, 1.0, 2.0]]
_B = [[1.0, 0.0, 2.0], [0.0, 1.0, 0.0], [3.0, 0.0, 1.0]]
_AB = "a AS (SELECT * FROM (VALUES (0, 0, 4.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 3.0), (1, 2, 1.0), (2, 1, 1.0), (2, 2, 2.0)) v(i, j, v)), b AS (SELECT * FROM (VALUES (0, 0, 1.0), (0, 2, 2.0), (1, 1, 1.0), (2, 0, 3.0), (2, 2, 1.0)) v(i, j, v)), g AS (SELECT x.range AS i, y.range AS j FROM range(3) x, range(3) y), f AS (SELECT i, j, coalesce(a.v, 0) AS a, coalesce(b.v, 0) AS b FROM g LEFT JOIN a USING (i, j) LEFT JOIN b USING (i, j))"


def _cells(**named: Matrix) -> DataFrame:
    out = None
    for n, m in named.items():
        part = m.cells.where("v <> 0").select(F.lit(n).alias("name"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r6("v").alias("v"))
        out = part if out is None else out.unionByName(part)
    return out


@query("matrix_arithmetic", f"WITH {_AB}, o AS (SELECT 'add' AS name, i, j, a + b AS v FROM f UNION ALL SELECT 'subtract', i, j, a - b FROM f UNION ALL SELECT 'times', i, j, a * b FROM f UNION ALL SELECT 'scaled', i, j, 2.5 * a FROM f UNION ALL SELECT 'zeros', i, j, 0 FROM f UNION ALL SELECT 'ones', i, j, 1 FROM g UNION ALL SELECT 'eye', i, i, 1 FROM g WHERE i = j) SELECT name, i, j, CAST(v AS DOUBLE) AS v FROM o WHERE v <> 0")
def _(s, d):
    a, b = Matrix.of(s, np.array(_A)), Matrix.of(s, np.array(_B))
    return _cells(add=a.add(b), subtract=a.subtract(b), times=a.hadamard(b), scaled=a.scale(2.5), zeros=Matrix.zeros(s, 3, 3), ones=Matrix.ones(s, 3, 3), eye=Matrix.identity(s, 3))


@query("matrix_functions", f"WITH {_AB}, o AS (SELECT 'abs' AS name, i, j, abs(a - b) AS v FROM f UNION ALL SELECT 'exp', i, j, exp(a) FROM f UNION ALL SELECT 'log', i, j, ln(a + 1) FROM f UNION ALL SELECT 'sqrt', i, j, sqrt(a) FROM f UNION ALL SELECT 'degree', i, i, sum(a) FROM f GROUP BY 2) SELECT name, i, j, round(CAST(v AS DOUBLE), 6) AS v FROM o WHERE v <> 0")
def _(s, d):
    a, b = Matrix.of(s, np.array(_A)), Matrix.of(s, np.array(_B))
    return _cells(abs=a.subtract(b).map(F.abs), exp=a.map(F.exp, False), log=a.map(lambda c: F.ln(c + 1)), sqrt=a.map(F.sqrt), degree=a.degrees())


@query("matrix_shapes", f"WITH {_AB}, o AS (SELECT 'flat' AS name, 0 AS i, i * 3 + j AS j, a AS v FROM f UNION ALL SELECT 'down', i, j, a FROM f UNION ALL SELECT 'down', i + 3, j, b FROM f UNION ALL SELECT 'across', i, j, a FROM f UNION ALL SELECT 'across', i, j + 3, b FROM f UNION ALL SELECT 'bottom', i - 1, j, a FROM f WHERE i >= 1 UNION ALL SELECT 'turned', j, i, b FROM f UNION ALL SELECT 'corner', i, j, a FROM f WHERE i < 2 AND j < 2 UNION ALL SELECT 'tiled', i + 3 * y.range, j, a FROM f, range(2) y UNION ALL SELECT 'put', i, j, CASE WHEN i = 0 AND j = 2 THEN 9 ELSE a END FROM f) SELECT name, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(v AS DOUBLE) AS v FROM o WHERE v <> 0")
def _(s, d):
    a, b = Matrix.of(s, np.array(_A)), Matrix.of(s, np.array(_B))
    return _cells(flat=a.reshape(1, 9), down=a.concatenate(b), across=a.concatenate(b, 1), bottom=a.split([1])[1], turned=b.transpose(), corner=a.block(2, 2), tiled=a.tile(2, 1), put=a.set(0, 2, 9.0))


@query("matrix_tests", "SELECT true AS square, true AS symmetric, false AS other, false AS sparse, true AS thin, 3.0 AS cell, 0.0 AS none, true AS adjacency, false AS not_adjacency")
def _(s, d):
    a, b = Matrix.of(s, np.array(_A)), Matrix.of(s, np.array(_B))
    return s.createDataFrame([(a.is_square(), a.is_symmetric(), b.is_symmetric(), a.is_sparse(), Matrix.identity(s, 4).is_sparse(), a.get(1, 1), a.get(0, 2), Matrix.identity(s, 3).is_adjacency(), a.is_adjacency())], "square boolean, symmetric boolean, other boolean, sparse boolean, thin boolean, cell double, none double, adjacency boolean, not_adjacency boolean")


@query("matrix_decompositions", "SELECT 18.0 AS det, 3 AS rank, round(5 / 18, 6) AS inv00, round(-2 / 18, 6) AS inv01, 18.0 AS values_product, 9.0 AS values_sum, 18.0 AS singular_product, 0.0 AS qr, 0.0 AS lu, 0.0 AS cholesky, 1.0 AS x, 2.0 AS y, 3.0 AS z")
def _(s, d):
    m, a = Matrix.of(s, np.array(_A)), np.array(_A)
    inv, (q, r), (p, low, up), half, (u, sv, vt) = m.inverse(), m.qr(), m.lu(), m.cholesky(), m.svd()
    x = m.solve(a @ np.array([1.0, 2.0, 3.0]))
    off = lambda made, want: float(round(np.abs(made - want).max(), 6))
    values = m.eigen()[0]
    row = (m.determinant(), m.rank(), inv.get(0, 0), inv.get(0, 1), float(np.prod(values)), float(np.sum(values)), float(np.prod(sv)) + off(u @ np.diag(sv) @ vt, a), off(q @ r, a), off(low @ up, p @ a), off(half @ half.T, a), *x.tolist())
    names = ["det", "rank", "inv00", "inv01", "values_product", "values_sum", "singular_product", "qr", "lu", "cholesky", "x", "y", "z"]
    return s.createDataFrame([tuple(int(v) if n == "rank" else round(float(v), 6) + 0.0 for n, v in zip(names, row, strict=True))], ", ".join(f"{n} {'int' if n == 'rank' else 'double'}" for n in names))


@query("matrix_rows_columns", f"WITH {_AB} SELECT 'row' AS name, j AS at, CAST(v AS DOUBLE) AS v FROM a WHERE i = 1 UNION ALL SELECT 'column', i, v FROM b WHERE j = 0")
def _(s, d):
    a, b = Matrix.of(s, np.array(_A)), Matrix.of(s, np.array(_B))
    return a.row(1).select(F.lit("row").alias("name"), F.col("j").alias("at"), "v").unionByName(b.column(0).select(F.lit("column").alias("name"), F.col("i").alias("at"), "v"))


@query("weighted_adjacency", f"WITH {_FLOW} SELECT source AS i, target AS j, CAST(w AS DOUBLE) AS v FROM fe")
def _(s, d):
    return Matrix.adjacency(flow(s, d).edges, 25, "w", True).cells


@query("activations", "SELECT event_id, round(CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END, 6) AS elu, round(0.5 * x * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715 * x * x * x))), 6) AS gelu, CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END AS drelu, round(1 / (1 + exp(-x)) * (1 - 1 / (1 + exp(-x))), 6) AS dsigmoid, round(1 - tanh(x) * tanh(x), 6) AS dtanh, round(x / (1 + exp(-x)) + 1 / (1 + exp(-x)) * (1 - x / (1 + exp(-x))), 6) AS dswish FROM (SELECT event_id, event_id % 13 / 3.0::DOUBLE - 2 AS x FROM events)")
def _(s, d):
    x = read(s, d, "events").select("event_id", (F.col("event_id") % 13 / F.lit(3.0) - 2).alias("x"))
    return x.select("event_id", *[r6(f("x")).alias(n) for n, f in (("elu", scalar.elu), ("gelu", scalar.gelu), ("drelu", scalar.relu_derivative), ("dsigmoid", scalar.sigmoid_derivative), ("dtanh", scalar.tanh_derivative), ("dswish", scalar.swish_derivative))])


# --- layouts ---


@query("circular_layout", "SELECT CAST(n_nationkey AS BIGINT) AS node_id, round(2 * cos(2 * pi() * n_nationkey / 25), 6) AS x, round(2 * sin(2 * pi() * n_nationkey / 25), 6) AS y FROM nation")
def _(s, d):
    return embedding.circular(flow(s, d).nodes, 2.0).select("node_id", r6("x").alias("x"), r6("y").alias("y"))


@query("honeycomb_layout", "WITH p AS (SELECT CAST(n_nationkey AS BIGINT) AS node_id, sqrt(3::DOUBLE) * (n_nationkey % 5 + (n_nationkey // 5) / 2.0) AS x, 1.5::DOUBLE * (n_nationkey // 5) AS y FROM nation) SELECT node_id, CAST(node_id % 5 AS BIGINT) AS q, CAST(node_id // 5 AS BIGINT) AS r, round(x, 6) AS x, round(y, 6) AS y FROM p")
def _(s, d):
    """Points a little off the centres of a rhombus of cells move to the centres."""
    q, r = F.col("node_id") % 5, F.floor(F.col("node_id") / 5)
    near = flow(s, d).nodes.select("node_id", (F.sqrt(F.lit(3.0)) * (q + r / 2) + 0.1).alias("x"), (1.5 * r - 0.1).alias("y"))
    return embedding.honeycomb(near).select("node_id", "q", "r", r6("x").alias("x"), r6("y").alias("y"))


@query("interpolated_positions", "SELECT CAST(n_nationkey AS BIGINT) AS node_id, CAST(step.range AS INT) AS step, round(n_nationkey * (1 + step.range / 4.0), 6) AS x FROM nation, range(5) step")
def _(s, d):
    nodes = flow(s, d).nodes
    at = lambda k: nodes.select("node_id", F.array(F.col("node_id") * float(k)).alias("vector"))
    return embedding.interpolate(at(1), at(2), 4).select("node_id", "step", r6(F.col("vector")[0]).alias("x"))


@query("layout_stress", f"WITH {_FLOW}, p AS (SELECT node_id, node_id % 5 AS x, node_id // 5 AS y FROM fn), l AS (SELECT sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS l FROM fe JOIN p a ON source = a.node_id JOIN p b ON target = b.node_id) SELECT round(avg(l), 6) AS mean_length, round(stddev_pop(l), 6) AS deviation FROM l")
def _(s, d):
    g = flow(s, d)
    placed = embedding.LAYOUTS["grid"](g.nodes, 5).select("node_id", F.array("x", "y").alias("vector"))
    return embedding.edge_stress(g, placed).select(r6("mean_length").alias("mean_length"), r6("deviation").alias("deviation"))


@query("visible_window", "SELECT CAST(n_nationkey AS BIGINT) AS node_id FROM nation WHERE n_nationkey % 5 BETWEEN 1 AND 3 AND n_nationkey // 5 BETWEEN 0 AND 2")
def _(s, d):
    return embedding.visible(embedding.embed("grid", flow(s, d).nodes, 5), 1, 0, 3, 2).select("node_id")


@query("nodes_and_edges_of_tables", f"WITH {_FLOW} SELECT source AS node_id, count(*) AS n FROM fe GROUP BY 1")
def _(s, d):
    g = flow(s, d)
    e = io.to_edges(g.edges.select(F.col("source").alias("a"), F.col("target").alias("b")), "a", "b")
    n = io.to_nodes(g.nodes.withColumnRenamed("node_id", "uid"), "uid")
    return Graph(n, e, True).degree("out").where("degree > 0").select("node_id", F.col("degree").alias("n"))


# --- files ---


def _at(s, name: str) -> str:
    import uuid

    return f"{run_dir(s)}/{name}-{uuid.uuid4().hex}"


@query("csv_round_trip", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def _(s, d):
    path = _at(s, "csv")
    io.write_csv(read(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return io.read_csv(s, path, "n_nationkey long, n_name string, n_regionkey long")


@query("json_round_trip", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def _(s, d):
    path = _at(s, "json")
    s.createDataFrame([(io.json_document(read(s, d, "nation").select("n_nationkey", "n_name")),)], "value string").coalesce(1).write.text(path)
    return io.read_json_table(s, path).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


@query("parquet_round_trip", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(s, d):
    path = _at(s, "parquet")
    Table(read(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")).to_parquet(path)
    return Table.from_parquet(s, path).df


@query("bundle_round_trip", f"WITH {_TRADE} SELECT source, target, round(w, 2) AS w FROM te")
def _(s, d):
    path = _at(s, "bundle")
    io.save_bundle(trade(s, d), path)
    return io.load_bundle(s, path).edges.select("source", "target", F.round("w", 2).alias("w"))


@query("bundle_info", f"WITH {_TRADE} SELECT 'nodes' AS name, (SELECT count(*) FROM tn) AS rows, 0 AS problems UNION ALL SELECT 'edges', (SELECT count(*) FROM te), 0")
def _(s, d):
    path = _at(s, "bundle")
    io.save_bundle(trade(s, d), path)
    info = io.bundle_info(s, path)
    return s.createDataFrame([(n, info[n]["rows"], len(io.validate_bundle(s, path))) for n in ("nodes", "edges")], "name string, rows long, problems int")


@query("federated_bundles", "SELECT 'north' AS _domain, CAST(n_nationkey AS BIGINT) AS _original_id FROM nation UNION ALL SELECT 'south', CAST(n_nationkey AS BIGINT) FROM nation")
def _(s, d):
    paths = {n: _at(s, "bundle") for n in ("north", "south")}
    for p in paths.values():
        io.save_bundle(flow(s, d), p)
    return io.load_federated(s, paths).nodes.select("_domain", "_original_id")


@query("graph_from_tables", f"WITH {_FLOW} SELECT x.n_name AS a, y.n_name AS b FROM fe JOIN nation x ON source = x.n_nationkey JOIN nation y ON target = y.n_nationkey")
def _(s, d):
    """Ids of text become numbers, and their names stay."""
    names = read(s, d, "nation").select("n_nationkey", "n_name")
    e = flow(s, d).edges.join(names.toDF("source", "a"), "source").join(names.toDF("target", "b"), "target").select("a", "b")
    g = io.graph_from_tables(names.select(F.col("n_name").alias("id")), e, "id", "a", "b", True)
    ids = g.nodes.select("node_id", "id")
    return g.edges.join(ids.toDF("source", "a"), "source").join(ids.toDF("target", "b"), "target").select("a", "b")


@query("from_columns", "SELECT * FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) v(a, b)")
def _(s, d):
    return io.from_columns(s, {"b": ["x", "y", None], "a": [1, 2, 3]}, ["a", "b"])


@query("graph_changes", f"WITH {_FLOW} SELECT source, target FROM fe WHERE source <> 2 AND target <> 2 AND NOT (source = 0) UNION ALL SELECT 99, 1")
def _(s, d):
    g = flow(s, d)
    g = g.add_nodes(s.createDataFrame([(99, "new"), (3, "taken")], "node_id long, name string")).add_edges(s.createDataFrame([(99, 1, 9901), (98, 1, 9801)], "source long, target long, edge_id long"))
    g = g.remove_nodes(s.createDataFrame([(2,)], "node_id long"))
    return g.remove_edges(g.edges.where("source = 0").select("edge_id")).edges.select("source", "target")


@query("edge_attributes", f"WITH {_FLOW} SELECT source, target, CASE WHEN source = 1 THEN 0 ELSE w END AS w FROM fe")
def _(s, d):
    g = flow(s, d)
    return g.set_edge_attrs(g.edges.where("source = 1").select("edge_id", F.lit(0).cast("long").alias("w"))).edges.select("source", "target", "w")


@query("parallel_edges", "SELECT * FROM (VALUES (1), (2), (4)) v(edge_id)")
def _(s, d):
    e = s.createDataFrame([(1, 0, 5), (2, 5, 0), (3, 0, 6), (4, 0, 5)], "edge_id long, source long, target long")
    return Graph.from_edges(e).parallel_edges().select("edge_id")


@query("graph_membership", f"WITH {_FLOW} SELECT * FROM (VALUES (0, true), (24, true), (25, false)) v(node_id, found)")
def _(s, d):
    return flow(s, d).contains(s.createDataFrame([(0,), (24,), (25,)], "node_id long"))


@query("largest_component", f"WITH RECURSIVE {_FLOW}, w AS (SELECT node_id, node_id AS c FROM fn UNION SELECT b, c FROM w JOIN fadj ON a = node_id), z AS (SELECT node_id, min(c) AS c FROM w GROUP BY 1) SELECT node_id FROM z WHERE c = (SELECT c FROM z GROUP BY 1 ORDER BY count(*) DESC, c LIMIT 1)")
def _(s, d):
    return flow(s, d).largest_component().nodes.select("node_id")


@query("merge_strategies", f"WITH {_FLOW} SELECT 'first' AS strategy, node_id, CAST(region AS BIGINT) AS region FROM fn UNION ALL SELECT 'second', node_id, region * 10 FROM fn UNION ALL SELECT 'attributes', node_id, region FROM fn UNION ALL SELECT 'remap', node_id, region FROM fn UNION ALL SELECT 'remap', node_id + 25, region * 10 FROM fn")
def _(s, d):
    g, out = flow(s, d), None
    other = Graph(g.nodes.withColumn("region", F.col("region") * 10), g.edges, True)
    for how in ("first", "second", "attributes", "remap"):
        part = merge(g, other, how).nodes.select(F.lit(how).alias("strategy"), "node_id", "region")
        out = part if out is None else out.unionByName(part)
    return out


@query("all_flows_density", f"WITH {_TRADE}, f AS (SELECT DISTINCT y.nation AS a, x.nation AS b FROM te JOIN tn x ON source = x.node_id JOIN tn y ON target = y.node_id WHERE x.nation <> y.nation) SELECT round(count(*) / (25.0 * 24), 8) AS density FROM f")
def _(s, d):
    return flows(s, d).density().select(F.round("density", 8).alias("density"))


@query("supplier_edges_in", f"WITH {_TRADE} SELECT target AS node_id, count(*) AS n FROM te WHERE target >= {SUPPLIERS} GROUP BY 1")
def _(s, d):
    g = trade(s, d)
    found = g.incident_edges(g.nodes.where("kind = 'supplier'").select("node_id"), "in")
    return found.groupBy(F.col("target").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
