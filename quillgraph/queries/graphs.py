"""Graph, matrix, history and builder operators over graphs that stand in the driver's tables.

trade: customers and suppliers, an edge where a supplier's parts went into a customer's orders.
flow: nations, the three strongest flows of lines from each supplier nation to customer nations.
flows: nations and all flows between them.
returns: trade, directed, with edges back from suppliers to the customers who returned goods.
places: trade, and edges from customers and suppliers to their nations.
log: the events as a log of changes, an event being a commit and its user an entity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import scalar
from quillgraph.operators import algorithms as A
from quillgraph.operators import builder as B
from quillgraph.operators.graph import Graph, merge
from quillgraph.operators.matrix import Matrix
from quillgraph.operators.temporal import History
from quillgraph.sources import generators
from quillgraph.streaming.ingest import latest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Suppliers' node ids start here.
SUPPLIERS = 1_000_000_000
#: Nations' node ids start here, where they stand beside suppliers.
NATIONS = 2_000_000_000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def read(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def trade(s: SparkSession, d: str) -> Graph:
    lines = read(s, d, "lineitem").join(read(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    e = lines.groupBy(F.col("o_custkey").alias("source"), (F.col("l_suppkey") + SUPPLIERS).alias("target")).agg(F.sum("l_extendedprice").alias("w"), F.count(F.lit(1)).alias("n"))
    e = e.withColumn("edge_id", F.col("source") * 1_000_000 + (F.col("target") - SUPPLIERS))
    nodes = read(s, d, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"))
    nodes = nodes.unionByName(read(s, d, "supplier").select((F.col("s_suppkey") + SUPPLIERS).alias("node_id"), F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance")))
    return Graph(nodes, e)


def flow(s: SparkSession, d: str, directed: bool = True) -> Graph:
    lines = read(s, d, "lineitem").join(read(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    e = lines.groupBy(F.col("s_nationkey").cast("long").alias("source"), F.col("c_nationkey").cast("long").alias("target")).agg(F.count(F.lit(1)).alias("w")).where("source <> target")
    n = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("w"), "target"))
    e = e.withColumn("__n", n).where("__n <= 3").drop("__n").withColumn("edge_id", F.col("source") * 100 + F.col("target"))
    nodes = read(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("node_id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))
    return Graph(nodes, e, directed)


def flows(s: SparkSession, d: str, directed: bool = True) -> Graph:
    """Every flow between two nations, the lighter ones too."""
    g = trade(s, d)
    of = g.nodes.select("node_id", F.col("nation").cast("long").alias("nation"))
    e = g.edges.join(of.toDF("source", "to"), "source").join(of.toDF("target", "from"), "target")
    e = e.groupBy(F.col("from").alias("source"), F.col("to").alias("target")).agg(F.sum("n").alias("w")).where("source <> target").withColumn("edge_id", F.col("source") * 100 + F.col("target"))
    nodes = read(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("node_id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))
    return Graph(nodes, e, directed)


def returns(s: SparkSession, d: str) -> Graph:
    g = trade(s, d)
    back = read(s, d, "lineitem").where("l_returnflag = 'R'").join(read(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    back = back.groupBy((F.col("l_suppkey") + SUPPLIERS).alias("source"), F.col("o_custkey").alias("target")).agg(F.sum("l_extendedprice").alias("w"), F.count(F.lit(1)).alias("n"))
    return Graph(g.nodes, g.edges.unionByName(back.withColumn("edge_id", -F.col("target") * 1_000_000 - (F.col("source") - SUPPLIERS))), True)


def places(s: SparkSession, d: str) -> Graph:
    g = trade(s, d)
    at = g.nodes.select(F.col("node_id").alias("source"), (F.col("nation") + NATIONS).cast("long").alias("target"), (-1 - F.col("node_id")).alias("edge_id"))
    nodes = g.nodes.select("node_id").unionByName(read(s, d, "nation").select((F.col("n_nationkey") + NATIONS).cast("long").alias("node_id")))
    return Graph(nodes, g.edges.select("source", "target", "edge_id").unionByName(at))


def history(s: SparkSession, d: str) -> History:
    """Times of commits are in microseconds, as the events have them."""
    e = read(s, d, "events")
    commits = e.select(F.col("event_id").alias("commit_id"), F.when(F.col("event_id") > 0, F.array(F.col("event_id") - 1)).otherwise(F.array().cast("array<bigint>")).alias("parents"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.lit("").alias("author"), F.col("event_type").alias("message"), F.lit("main").alias("branch"))
    none = F.lit(None)
    born = e.groupBy(F.col("user_id").alias("id")).agg(F.min("event_id").alias("commit_id")).select("commit_id", F.lit("node").alias("entity"), F.lit("add").alias("op"), "id", none.cast("long").alias("source"), none.cast("long").alias("target"), none.cast("string").alias("attr"), none.cast("string").alias("value"))
    sets = e.select(F.col("event_id").alias("commit_id"), F.lit("node").alias("entity"), F.lit("set").alias("op"), F.col("user_id").alias("id"), none.cast("long").alias("source"), none.cast("long").alias("target"), F.col("event_type").alias("attr"), F.col("value").cast("string").alias("value"))
    return History(commits, born.unionByName(sets))


_TRADE = f"te AS (SELECT o_custkey AS source, l_suppkey + {SUPPLIERS} AS target, sum(l_extendedprice) AS w, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), tn AS (SELECT c_custkey AS node_id, c_nationkey AS nation, 'customer' AS kind, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey + {SUPPLIERS}, s_nationkey, 'supplier', s_acctbal FROM supplier), tadj AS (SELECT source AS a, target AS b FROM te UNION ALL SELECT target, source FROM te)"
_FLOW = "fe AS (SELECT source, target, w FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY w DESC, target) AS k FROM (SELECT CAST(s_nationkey AS BIGINT) AS source, CAST(c_nationkey AS BIGINT) AS target, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2)) WHERE k <= 3), fn AS (SELECT CAST(n_nationkey AS BIGINT) AS node_id, CAST(n_regionkey AS BIGINT) AS region FROM nation), fadj AS (SELECT DISTINCT a, b FROM (SELECT source AS a, target AS b FROM fe UNION ALL SELECT target, source FROM fe))"
_CANON = "ce AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM fe)"


def _pagerank_sql(rounds: int, damping: float = 0.85) -> str:
    steps = ["r0 AS (SELECT node_id, 1.0 / (SELECT count(*) FROM fn) AS rank FROM fn)"]
    for k in range(rounds):
        steps.append(f"r{k + 1} AS (SELECT node_id, {1 - damping} / (SELECT count(*) FROM fn) + {damping} * (coalesce(got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{k} WHERE node_id NOT IN (SELECT source FROM fe)) / (SELECT count(*) FROM fn)) AS rank FROM fn LEFT JOIN (SELECT target AS node_id, sum(rank / o) AS got FROM fe JOIN r{k} ON source = r{k}.node_id JOIN (SELECT source AS x, count(*) AS o FROM fe GROUP BY 1) ON x = source GROUP BY 1) USING (node_id))")
    return f"WITH {_FLOW}, {', '.join(steps)} SELECT node_id, round(rank, 8) AS rank FROM r{rounds}"


# --- topology ---


@query("degree", f"WITH {_TRADE} SELECT node_id, count(b) AS degree FROM tn LEFT JOIN tadj ON a = node_id GROUP BY 1")
def _(s, d):
    return trade(s, d).degree()


@query("in_out_degree", f"WITH {_TRADE} SELECT node_id, (SELECT count(*) FROM te WHERE target = node_id) AS ins, (SELECT count(*) FROM te WHERE source = node_id) AS outs FROM tn")
def _(s, d):
    g = trade(s, d)
    return g.degree("in").withColumnRenamed("degree", "ins").join(g.degree("out").withColumnRenamed("degree", "outs"), "node_id")


@query("weighted_degree", f"WITH {_TRADE} SELECT node_id, round(coalesce(sum(w), 0), 2) AS weighted_degree FROM tn LEFT JOIN (SELECT source AS x, w FROM te UNION ALL SELECT target, w FROM te) ON x = node_id GROUP BY 1")
def _(s, d):
    return trade(s, d).weighted_degree("w").withColumn("weighted_degree", F.round("weighted_degree", 2))


@query("neighbors_of", f"WITH {_TRADE} SELECT DISTINCT a AS node_id, b AS neighbor_id FROM tadj JOIN tn ON a = tn.node_id WHERE nation = 3")
def _(s, d):
    g = trade(s, d)
    return g.neighbors(g.nodes.where("nation = 3").select("node_id"))


@query("density", f"WITH {_TRADE} SELECT round((SELECT count(*) FROM te) / (n * (n - 1) / 2), 8) AS density FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM tn)")
def _(s, d):
    return trade(s, d).density().select(F.round("density", 8).alias("density"))


@query("edge_stats", f"WITH {_TRADE} SELECT count(*) AS edges, count(*) FILTER (source = target) AS self_loops, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets, count(DISTINCT source) + count(DISTINCT target) AS endpoints FROM te")
def _(s, d):
    return trade(s, d).edge_stats()


@query("filter_nodes", f"WITH {_TRADE}, k AS (SELECT node_id FROM tn WHERE (kind = 'supplier' AND nation < 12) OR NOT (balance < 5000 OR kind = 'supplier')) SELECT source, target FROM te WHERE source IN (FROM k) AND target IN (FROM k)")
def _(s, d):
    return trade(s, d).filter_nodes("kind = 'supplier' AND nation < 12 OR NOT (balance < 5000 OR kind = 'supplier')").edges.select("source", "target")


@query("filter_edges", f"WITH {_TRADE} SELECT node_id, kind FROM tn WHERE node_id IN (SELECT unnest([source, target]) FROM te WHERE n >= 2 AND w > 30000)")
def _(s, d):
    return trade(s, d).filter_edges("n >= 2 AND w > 30000").nodes.select("node_id", "kind")


@query("filter_edges_by_endpoint", f"WITH {_TRADE} SELECT source, target FROM te WHERE source IN (SELECT node_id FROM tn WHERE nation = 7) AND target IN (SELECT node_id FROM tn WHERE nation > 4)")
def _(s, d):
    g = trade(s, d).filter_edges_by_endpoint("nation > 4", "target")
    return g.filter_edges_by_endpoint("nation = 7", "source").edges.select("source", "target")


@query("filter_by_degree", f"WITH {_TRADE}, k AS (SELECT a AS node_id FROM tadj GROUP BY 1 HAVING count(*) BETWEEN 20 AND 60) SELECT node_id FROM k")
def _(s, d):
    return trade(s, d).filter_degree(20, 60).nodes.select("node_id")


@query("remove_nodes", f"WITH {_TRADE}, gone AS (SELECT node_id FROM tn WHERE balance < 0) SELECT source, target FROM te WHERE source NOT IN (FROM gone) AND target NOT IN (FROM gone)")
def _(s, d):
    g = trade(s, d)
    return g.remove_nodes(g.nodes.where("balance < 0").select("node_id")).edges.select("source", "target")


@query("set_node_attrs", "SELECT CAST(n_nationkey AS BIGINT) AS node_id, CASE WHEN n_regionkey = 1 THEN 'x' ELSE n_name END AS name FROM nation")
def _(s, d):
    g = flow(s, d)
    return g.set_node_attrs(g.nodes.where("region = 1").select("node_id", F.lit("x").alias("name"))).nodes.select("node_id", "name")


@query("group_nodes_by_attribute", f"WITH {_TRADE} SELECT nation, count(*) AS n, round(avg(balance), 4) AS mean, round(stddev_pop(balance), 4) AS sd FROM tn GROUP BY 1")
def _(s, d):
    return trade(s, d).nodes.groupBy("nation").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("balance"), 4).alias("mean"), F.round(F.stddev_pop("balance"), 4).alias("sd"))


@query("k_hop", f"WITH RECURSIVE {_FLOW}, w AS (SELECT 0::BIGINT AS seed, 0::BIGINT AS node_id, 0 AS hop UNION SELECT seed, target, hop + 1 FROM w JOIN fe ON source = node_id WHERE hop < 3) SELECT seed, node_id, min(hop) AS hop FROM w GROUP BY 1, 2")
def _(s, d):
    return flow(s, d).k_hop(s.createDataFrame([(0,)], "seed long"), 3)


@query("boundary", f"WITH {_FLOW} SELECT DISTINCT a AS node_id FROM fadj JOIN fn x ON a = x.node_id JOIN fn y ON b = y.node_id WHERE x.region <= 1 AND y.region > 1")
def _(s, d):
    g = flow(s, d)
    return g.boundary(g.nodes.where("region <= 1").select("node_id"))


@query("similarity", f"WITH {_TRADE}, x AS (SELECT node_id FROM tn WHERE nation < 15), y AS (SELECT node_id FROM tn WHERE nation > 8), z AS (SELECT (SELECT count(*) FROM x) AS a, (SELECT count(*) FROM y) AS b, (SELECT count(*) FROM x JOIN y USING (node_id)) AS i) SELECT round(i / (a + b - i), 6) AS jaccard, round(2 * i / (a + b), 6) AS dice, round(i / least(a, b), 6) AS overlap, round(i / sqrt(a * b), 6) AS cosine FROM z")
def _(s, d):
    g = trade(s, d)
    one = g.filter_nodes("nation < 15").similarity(g.filter_nodes("nation > 8"))
    return one.select(*[F.round(c, 6).alias(c) for c in one.columns])


@query("subgraph_sets", f"WITH {_TRADE} SELECT node_id FROM tn WHERE nation < 15 AND nation > 8")
def _(s, d):
    g = trade(s, d)
    return g.filter_nodes("nation < 15").intersect(g.filter_nodes("nation > 8")).nodes.select("node_id")


@query("validate", "SELECT problem, CAST(n AS BIGINT) AS n FROM (VALUES ('null node id', 0), ('repeated node id', 0), ('null edge field', 0), ('repeated edge id', 0), ('dangling source', 0), ('dangling target', 0), ('self loop', 0), ('parallel edge', 0)) v(problem, n)")
def _(s, d):
    return trade(s, d).validate()


@query("merge_graphs", f"WITH {_FLOW}, m AS (SELECT max(node_id) + 1 AS o FROM fn) SELECT source, target FROM fe UNION ALL SELECT source + o, target + o FROM fe, m")
def _(s, d):
    return merge(flow(s, d), flow(s, d)).edges.select("source", "target")


@query("collapse", f"WITH {_TRADE}, p AS (SELECT node_id, nation FROM tn) SELECT CAST(least(x.nation, y.nation) AS BIGINT) AS source, CAST(greatest(x.nation, y.nation) AS BIGINT) AS target, count(*) AS edge_count, round(sum(w), 2) AS w FROM te JOIN p x ON source = x.node_id JOIN p y ON target = y.node_id WHERE x.nation <> y.nation GROUP BY 1, 2 HAVING count(*) >= 2")
def _(s, d):
    g = trade(s, d)
    meta, _members = g.collapse(g.nodes.select("node_id", "nation"), {"balance": F.avg("balance")}, {"w": F.sum("w")}, 2)
    return meta.edges.select("source", "target", "edge_count", F.round("w", 2).alias("w"))


@query("meta_nodes", f"WITH {_TRADE} SELECT CAST(nation AS BIGINT) AS node_id, count(*) AS members, round(avg(balance), 4) AS balance FROM tn GROUP BY 1")
def _(s, d):
    g = trade(s, d)
    meta, _members = g.collapse(g.nodes.select("node_id", "nation"), {"balance": F.avg("balance")})
    return meta.nodes.select("node_id", "members", F.round("balance", 4).alias("balance"))


@query("partition_sizes", f"WITH {_TRADE} SELECT nation AS part, count(*) AS nodes, (SELECT count(*) FROM te JOIN tn x ON source = x.node_id JOIN tn y ON target = y.node_id WHERE x.nation = y.nation AND x.nation = tn.nation) AS edges FROM tn GROUP BY 1")
def _(s, d):
    g = trade(s, d)
    return g.partition(g.nodes.select("node_id", "nation"))


# --- algorithms ---


@query("pagerank", _pagerank_sql(10))
def _(s, d):
    return A.pagerank(flow(s, d), rounds=10, tol=None).withColumn("rank", F.round("rank", 8))


@query("pagerank_trade_top")
def pagerank_trade_top(s, d):
    scored = A.pagerank(trade(s, d), rounds=10, tol=None, direction="both").withColumnRenamed("rank", "score")
    return A.top_k(scored, "score", 10)


@query("bfs", f"WITH RECURSIVE {_FLOW}, w AS (SELECT 3::BIGINT AS node_id, 0 AS depth UNION SELECT target, depth + 1 FROM w JOIN fe ON source = node_id WHERE depth < 25) SELECT node_id, min(depth) AS depth FROM w GROUP BY 1")
def _(s, d):
    return A.bfs(flow(s, d), s.createDataFrame([(3,)], "node_id long"))


@query("shortest_paths", f"WITH RECURSIVE {_FLOW}, w AS (SELECT 3::BIGINT AS node_id, 0.0::DOUBLE AS distance, 0 AS k UNION SELECT target, distance + w.w, k + 1 FROM (SELECT w.*, fe.target, CAST(fe.w AS DOUBLE) AS w FROM w JOIN fe ON fe.source = w.node_id WHERE k < 9) w) SELECT node_id, min(distance) AS distance FROM w GROUP BY 1")
def _(s, d):
    return A.sssp(flow(s, d), s.createDataFrame([(3,)], "node_id long"), "w").select("node_id", "distance")


@query("connected_components", f"WITH RECURSIVE {_FLOW}, w AS (SELECT node_id, node_id AS c FROM fn UNION SELECT b, c FROM w JOIN fadj ON a = node_id) SELECT node_id, min(c) AS component FROM w GROUP BY 1")
def _(s, d):
    return flow(s, d).components()


@query("strong_components", f"WITH RECURSIVE {_FLOW}, w AS (SELECT node_id AS x, node_id AS y FROM fn UNION SELECT x, target FROM w JOIN fe ON source = y) SELECT p.x AS node_id, min(p.y) AS component FROM w p JOIN w q ON p.x = q.y AND p.y = q.x GROUP BY 1")
def _(s, d):
    return A.strong_components(flow(s, d))


def _lpa_sql(rounds: int) -> str:
    steps = ["l0 AS (SELECT node_id, node_id AS label FROM fn)"]
    for k in range(rounds):
        steps.append(f"l{k + 1} AS (SELECT node_id, label FROM (SELECT node_id, label, row_number() OVER (PARTITION BY node_id ORDER BY count(*) DESC, label) AS k FROM (SELECT a AS node_id, label FROM (SELECT source AS a, target AS b FROM fe UNION ALL SELECT target, source FROM fe) JOIN l{k} ON b = l{k}.node_id UNION ALL SELECT node_id, label FROM l{k}) GROUP BY 1, 2) WHERE k = 1)")
    return f"WITH {_FLOW}, {', '.join(steps)} SELECT node_id, label FROM l{rounds}"


@query("label_propagation", _lpa_sql(4))
def _(s, d):
    return A.label_propagation(flow(s, d), rounds=4, tol=-1.0)


@query("triangles", f"WITH {_FLOW}, {_CANON}, t AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM ce x JOIN ce y ON x.b = y.a JOIN ce z ON z.a = x.a AND z.b = y.b) SELECT node_id, count(p) AS triangles FROM fn LEFT JOIN t ON node_id IN (p, q, r) GROUP BY 1")
def _(s, d):
    return flow(s, d).triangles()


@query("clustering", f"WITH {_FLOW}, {_CANON}, t AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM ce x JOIN ce y ON x.b = y.a JOIN ce z ON z.a = x.a AND z.b = y.b), k AS (SELECT node_id, count(*) AS k FROM fn JOIN ce ON node_id IN (a, b) GROUP BY 1), n AS (SELECT node_id, count(p) AS t FROM fn LEFT JOIN t ON node_id IN (p, q, r) GROUP BY 1) SELECT node_id, round(CASE WHEN k > 1 THEN 2.0 * t / (k * (k - 1)) ELSE 0 END, 8) AS clustering FROM n LEFT JOIN k USING (node_id)")
def _(s, d):
    return flow(s, d).clustering().withColumn("clustering", F.round("clustering", 8))


@query("transitivity", f"WITH {_FLOW}, {_CANON}, t AS (SELECT 3 * count(*) AS t FROM ce x JOIN ce y ON x.b = y.a JOIN ce z ON z.a = x.a AND z.b = y.b), k AS (SELECT node_id, count(*) AS k FROM fn JOIN ce ON node_id IN (a, b) GROUP BY 1) SELECT round(max(t) / sum(k * (k - 1) / 2), 8) AS transitivity FROM k, t")
def _(s, d):
    return flow(s, d).transitivity().select(F.round("transitivity", 8).alias("transitivity"))


@query("modularity", f"WITH {_FLOW}, e AS (SELECT x.region AS p, y.region AS q FROM fe JOIN fn x ON source = x.node_id JOIN fn y ON target = y.node_id), m AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM e), i AS (SELECT p AS c, count(*) AS i FROM e WHERE p = q GROUP BY 1), g AS (SELECT c, count(*) AS g FROM (SELECT p AS c FROM e UNION ALL SELECT q FROM e) GROUP BY 1) SELECT round(sum(coalesce(i, 0) / m - (g / (2 * m)) * (g / (2 * m))), 8) AS modularity FROM g LEFT JOIN i USING (c), m")
def _(s, d):
    g = flow(s, d)
    return A.modularity(g, g.nodes.select("node_id", "region")).select(F.round("modularity", 8).alias("modularity"))


@query("closeness", f"WITH RECURSIVE {_FLOW}, w AS (SELECT node_id AS x, node_id AS y, 0 AS h FROM fn UNION SELECT x, target, h + 1 FROM w JOIN fe ON source = y WHERE h < 24), m AS (SELECT x, y, min(h) AS h FROM w GROUP BY 1, 2) SELECT node_id, round(coalesce(sum(1.0 / h), 0), 6) AS closeness FROM fn LEFT JOIN (SELECT * FROM m WHERE h > 0) ON x = node_id GROUP BY 1")
def _(s, d):
    return A.closeness(flow(s, d)).withColumn("closeness", F.round("closeness", 6))


@query("betweenness", f"""WITH RECURSIVE {_FLOW}, w AS (SELECT node_id AS x, [node_id] AS p FROM fn UNION ALL SELECT x, list_append(p, b) FROM w JOIN fadj ON a = p[-1] WHERE NOT list_contains(p, b) AND len(p) < 6),
m AS (SELECT x, p[-1] AS y, min(len(p)) AS n FROM w GROUP BY 1, 2), s AS (SELECT w.x, y, p FROM w JOIN m ON w.x = m.x AND p[-1] = y AND len(p) = n WHERE n > 1), c AS (SELECT x, y, count(*) AS c FROM s GROUP BY 1, 2),
v AS (SELECT unnest(p[2:-2]) AS node_id, 1.0 / c AS q FROM s JOIN c USING (x, y) WHERE len(p) > 2)
SELECT fn.node_id, round(coalesce(sum(q), 0) / 2, 6) AS betweenness FROM fn LEFT JOIN v USING (node_id) GROUP BY 1""")
def _(s, d):
    return A.betweenness(flow(s, d, False), normalized=False).withColumn("betweenness", F.round("betweenness", 6))


def _core_sql(k: int, rounds: int) -> str:
    steps = ["k0 AS (SELECT a, b FROM fadj WHERE a <> b)"]
    for i in range(rounds):
        steps.append(f"d{i} AS (SELECT a AS n FROM k{i} GROUP BY 1 HAVING count(*) >= {k}), k{i + 1} AS (SELECT a, b FROM k{i} WHERE a IN (FROM d{i}) AND b IN (FROM d{i}))")
    return f"WITH {_FLOW}, {', '.join(steps)} SELECT node_id, CASE WHEN node_id IN (SELECT a FROM k{rounds}) THEN 1 ELSE 0 END AS in_core FROM fn"


@query("k_core", _core_sql(4, 12))
def _(s, d):
    return A.k_core(flow(s, d), 4)


@query("all_paths", f"WITH RECURSIVE {_FLOW}, w AS (SELECT [3::BIGINT] AS p UNION ALL SELECT list_append(p, target) FROM w JOIN fe ON source = p[-1] WHERE len(p) < 5 AND p[-1] <> 0 AND NOT list_contains(p, target)) SELECT array_to_string(p, '-') AS path FROM w WHERE p[-1] = 0")
def _(s, d):
    return A.all_paths(flow(s, d), 3, 0, 4).select(F.concat_ws("-", F.col("path").cast("array<string>")).alias("path"))


@query("louvain")
def _(s, d):
    return A.louvain(flows(s, d, False), weight="w")


@query("leiden")
def _(s, d):
    return A.leiden(flows(s, d, False), weight="w")


@query("girvan_newman")
def _(s, d):
    return A.girvan_newman(flows(s, d, False))


@query("infomap_majority")
def _(s, d):
    return A.infomap_majority(trade(s, d), 10)


@query("dfs")
def _(s, d):
    return A.dfs(flows(s, d), 3)


@query("random_walks")
def _(s, d):
    g = returns(s, d)
    return A.random_walks(g, g.nodes.select("node_id"), 5, 0.15, 7)


# --- generators ---


@query("generate_complete", "SELECT a.range AS source, b.range AS target FROM range(20) a, range(20) b WHERE a.range < b.range")
def _(s, d):
    return generators.complete(s, 20).edges.select("source", "target")


@query("generate_ring_star_tree", "SELECT 'cycle' AS kind, range AS source, (range + 1) % 12 AS target FROM range(12) UNION ALL SELECT 'star', 0, range FROM range(1, 12) UNION ALL SELECT 'tree', (range - 1) // 3, range FROM range(1, 12) UNION ALL SELECT 'path', range, range + 1 FROM range(11)")
def _(s, d):
    named = lambda k, g: g.edges.select(F.lit(k).alias("kind"), "source", "target")
    return named("cycle", generators.cycle(s, 12)).unionByName(named("star", generators.star(s, 12))).unionByName(named("tree", generators.tree(s, 12, 3))).unionByName(named("path", generators.path(s, 12)))


@query("generate_grid", "SELECT range AS source, range + 1 AS target FROM range(12) WHERE range % 4 < 3 UNION ALL SELECT range, range + 4 FROM range(12) WHERE range // 4 < 2")
def _(s, d):
    return generators.grid(s, [3, 4]).edges.select("source", "target")


# --- matrices ---


def _vectors(s, d) -> Matrix:
    e = read(s, d, "embeddings")
    return Matrix.from_arrays(e, "vec_id", "embedding", e.agg(F.max("vec_id")).first()[0] + 1, e.select(F.size("embedding")).first()[0])


_VEC = "v AS (SELECT vec_id AS i, unnest(range(len(embedding))) AS j, unnest(embedding::DOUBLE[]) AS v FROM embeddings)"


@query("matrix_gram", f"WITH {_VEC} SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 3) AS v FROM v a JOIN v b USING (i) GROUP BY 1, 2")
def _(s, d):
    m = _vectors(s, d)
    return m.transpose().matmul(m).cells.withColumn("v", F.round("v", 3))


@query("matrix_axis_stats", f"WITH {_VEC} SELECT j, round(sum(v), 3) AS sum, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, max(v) AS max FROM v GROUP BY 1")
def _(s, d):
    return _vectors(s, d).axis(0).select("j", F.round("sum", 3).alias("sum"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max")


@query("matrix_stats", f"WITH {_VEC} SELECT round(sum(v), 2) AS sum, min(v) AS min, max(v) AS max, round(sqrt(sum(v * v)), 4) AS frobenius, round(sum(abs(v)), 2) AS l1, count(*) FILTER (v = 0) AS zeros FROM v")
def _(s, d):
    return _vectors(s, d).stats().select(F.round("sum", 2).alias("sum"), "min", "max", F.round("frobenius", 4).alias("frobenius"), F.round("l1", 2).alias("l1"), "zeros")


@query("matrix_softmax", f"WITH {_VEC} SELECT i, j, round(exp(v - m) / sum(exp(v - m)) OVER (PARTITION BY i), 8) AS v FROM (SELECT *, max(v) OVER (PARTITION BY i) AS m FROM v)")
def _(s, d):
    return _vectors(s, d).softmax().cells.withColumn("v", F.round("v", 8))


@query("laplacian", f"WITH {_FLOW}, c AS (SELECT a AS i, b AS j, -1.0 AS v FROM fadj UNION ALL SELECT a, a, count(*) FROM fadj GROUP BY 1) SELECT i, j, CAST(v AS DOUBLE) AS v FROM c")
def _(s, d):
    return Matrix.adjacency(flow(s, d).edges, 25).laplacian().cells


@query("normalized_adjacency", f"WITH {_FLOW}, k AS (SELECT a, count(*) AS k FROM fadj GROUP BY 1) SELECT fadj.a AS i, b AS j, round(1 / sqrt(x.k * y.k), 8) AS v FROM fadj JOIN k x ON fadj.a = x.a JOIN k y ON b = y.a")
def _(s, d):
    return Matrix.adjacency(flow(s, d).edges, 25).normalized().cells.withColumn("v", F.round("v", 8))


@query("adjacency_power", f"WITH {_FLOW} SELECT x.a AS i, z.b AS j, CAST(count(*) AS DOUBLE) AS v FROM fadj x JOIN fadj y ON x.b = y.a JOIN fadj z ON y.b = z.a GROUP BY 1, 2")
def _(s, d):
    return Matrix.adjacency(flow(s, d).edges, 25).power(3).cells


@query("cosine_similarity", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS cosine FROM embeddings, q")
def _(s, d):
    e = read(s, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(scalar.cosine("embedding", "q"), 6).alias("cosine"))


# --- history ---


@query("values_as_of", "SELECT user_id AS id, event_type AS attr, arg_max(value, event_id) AS value FROM events WHERE event_id <= 400 AND value IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    return history(s, d).values_at(400).select("id", "attr", F.col("value").cast("double").alias("value"))


@query("nodes_alive_at", "SELECT user_id AS id, min(event_id) AS created FROM events GROUP BY 1 HAVING min(event_id) <= 150")
def _(s, d):
    return history(s, d).alive_at(150).select("id", "created")


@query("value_history", "SELECT event_id AS commit_id, value FROM events WHERE user_id = 5 AND event_type = 'view' AND event_id BETWEEN 0 AND 800")
def _(s, d):
    return history(s, d).value_history(5, "view", 0, 800).select("commit_id", F.col("value").cast("double").alias("value"))


@query("diff_commits", "SELECT user_id AS id, CASE WHEN min(event_id) > 200 THEN 'added' ELSE 'changed' END AS change FROM events WHERE event_id <= 400 GROUP BY 1 HAVING min(event_id) > 200 OR max(event_id) FILTER (event_id > 200) IS NOT NULL")
def _(s, d):
    return history(s, d).diff(200, 400)


@query("window_aggregate", "SELECT user_id AS id, round(sum(value), 4) AS value FROM events WHERE event_type = 'click' AND event_id BETWEEN 100 AND 700 GROUP BY 1")
def _(s, d):
    return history(s, d).window_aggregate("click", 100, 700, "sum").withColumn("value", F.round("value", 4))


@query("decayed_values", "SELECT user_id AS id, round(sum(value * pow(0.5, (900 - event_id) / 100.0)), 6) AS value FROM events WHERE event_type = 'click' AND event_id <= 900 GROUP BY 1")
def _(s, d):
    return history(s, d).decayed("click", 900, 100.0).withColumn("value", F.round("value", 6))


@query("changed_in_window", "SELECT user_id AS id, 'node' AS entity FROM events WHERE event_id BETWEEN 300 AND 320 GROUP BY 1")
def _(s, d):
    return history(s, d).changed(300, 320).select("id", "entity")


@query("latest_state", "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def _(s, d):
    return latest(read(s, d, "events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


# --- builder ---


@query("dsl_pagerank", _pagerank_sql(8))
def _(s, d):
    return B.dsl_pagerank(rounds=8)(flow(s, d)).withColumn("rank", F.round("rank", 8))


@query("dsl_expression", f"WITH {_FLOW} SELECT node_id, CAST((SELECT coalesce(sum(x.region), 0) FROM fe JOIN fn x ON source = x.node_id WHERE target = fn.node_id) + 10 * region AS DOUBLE) AS score FROM fn")
def _(s, d):
    b = B.AlgorithmBuilder()
    r = b.load_attr("region", 0)
    b.attach_as("score", b.map_nodes("sum(r[neighbors(node)]) + 10 * r", r=r))
    return b.build()(flow(s, d)).withColumn("score", F.col("score").cast("double"))


@query("dsl_degree_centrality", f"WITH {_FLOW} SELECT node_id, round((SELECT count(*) FROM fe WHERE fn.node_id IN (source, target)) / (SELECT count(*) - 1 FROM fn), 8) AS centrality FROM fn")
def _(s, d):
    return B.degree_centrality()(flow(s, d)).withColumn("centrality", F.round("centrality", 8))


@query("dsl_normalize_clip", f"WITH {_FLOW}, k AS (SELECT node_id, (SELECT count(*) FROM fe WHERE fn.node_id IN (source, target)) AS k FROM fn) SELECT node_id, round((k - avg(k) OVER ()) / stddev_pop(k) OVER (), 6) AS z, CAST(least(greatest(k, 2.0), 5.0) AS DOUBLE) AS c, CAST(CASE WHEN k > 4 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS high FROM k")
def _(s, d):
    b = B.AlgorithmBuilder()
    k = b.degrees()
    b.attach_as("z", k.normalize("standard"))
    b.attach_as("c", b.clip(k, 2.0, 5.0))
    b.attach_as("high", k > 4)
    return b.build()(flow(s, d)).withColumn("z", F.round("z", 6))


@query("dsl_label_propagation")
def _(s, d):
    return B.dsl_label_propagation(5)(trade(s, d))


# --- steps and further subgraph queries ---


@query("step_pipeline", f"WITH {_FLOW}, k AS (SELECT node_id, (SELECT count(*) FROM fe WHERE source = node_id) AS d FROM fn) SELECT node_id, CAST((SELECT coalesce(sum(d), 0) FROM fe JOIN k x ON x.node_id = fe.source WHERE fe.target = k.node_id) AS BIGINT) AS s, round(d / (SELECT sum(d) FROM k), 8) AS share FROM k")
def _(s, d):
    from quillgraph.operators import steps

    done = steps.run(flow(s, d), [{"id": "core.node_degree", "params": {"target": "d"}}, {"id": "core.neighbor_agg", "params": {"source": "d", "how": "sum", "target": "s"}}, {"id": "core.normalize_values", "params": {"source": "d", "target": "share"}}])
    return done.nodes.select("node_id", "s", F.round("share", 8).alias("share"))


@query("transition_matrix", f"WITH {_FLOW}, k AS (SELECT source AS x, count(*) AS k FROM fe GROUP BY 1) SELECT source, target, round(1.0::DOUBLE / k, 8) AS p FROM fe JOIN k ON x = source")
def _(s, d):
    return flow(s, d).transition().withColumn("p", F.round("p", 8))


@query("adjacency_list", f"WITH {_FLOW} SELECT node_id, coalesce((SELECT string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) FROM fadj WHERE a = node_id), '') AS neighbors FROM fn")
def _(s, d):
    return flow(s, d, False).adjacency_list().select("node_id", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))


@query("group_by_node_attr", f"WITH {_FLOW} SELECT x.region AS part, count(*) AS edges FROM fe JOIN fn x ON source = x.node_id JOIN fn y ON target = y.node_id WHERE x.region = y.region GROUP BY 1")
def _(s, d):
    _, e = flow(s, d).group_by_node_attr("region")
    return e.groupBy("part").agg(F.count(F.lit(1)).alias("edges"))


@query("incident_edges", f"WITH {_FLOW} SELECT source, target FROM fe WHERE source IN (SELECT node_id FROM fn WHERE region = 2) OR target IN (SELECT node_id FROM fn WHERE region = 2)")
def _(s, d):
    g = flow(s, d)
    return g.incident_edges(g.nodes.where("region = 2").select("node_id")).select("source", "target")


@query("overlaps", f"WITH {_TRADE} SELECT name, count(*) AS nodes FROM tn JOIN (VALUES ('low', 0, 9), ('high', 20, 24)) v(name, a, b) ON nation BETWEEN a AND b WHERE balance > 3000 GROUP BY 1")
def _(s, d):
    g = trade(s, d)
    return g.filter_nodes("balance > 3000").overlaps({"low": g.filter_nodes("nation BETWEEN 0 AND 9"), "high": g.filter_nodes("nation BETWEEN 20 AND 24")})


@query("grid_layout", "SELECT CAST(n_nationkey AS BIGINT) AS node_id, CAST(n_nationkey % 5 AS DOUBLE) AS x, CAST(n_nationkey // 5 AS DOUBLE) AS y FROM nation")
def _(s, d):
    from quillgraph.operators import embedding

    return embedding.grid(flow(s, d).nodes, 5)


@query("pca_embedding")
def _(s, d):
    from quillgraph.operators import embedding

    return embedding.pca(read(s, d, "embeddings"), "embedding", 2, "vec_id").select("vec_id", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"))


# --- whole graphs: supersteps over trade and what is built on it, no edge left out ---


@query("pagerank_trade")
def _(s, d):
    return A.pagerank(returns(s, d), rounds=10, tol=None, local_edges=0)


@query("bfs_trade")
def _(s, d):
    return A.bfs(returns(s, d), _one(s))


@query("shortest_paths_trade")
def _(s, d):
    return A.sssp(returns(s, d), _one(s), "w").select("node_id", "distance")


@query("connected_components_trade")
def _(s, d):
    return trade(s, d).components(0)


@query("strong_components_trade")
def _(s, d):
    return A.strong_components(returns(s, d))


@query("label_propagation_trade")
def _(s, d):
    return A.label_propagation(trade(s, d), rounds=4, tol=-1.0, local_edges=0)


@query("k_core_trade")
def _(s, d):
    return A.k_core(trade(s, d), 8)


@query("triangles_places")
def _(s, d):
    return places(s, d).triangles()


@query("clustering_places")
def _(s, d):
    return places(s, d).clustering()


@query("transitivity_places")
def _(s, d):
    return places(s, d).transitivity()


@query("modularity_trade")
def _(s, d):
    g = trade(s, d)
    return A.modularity(g, g.nodes.select("node_id", "nation"), "w")


@query("laplacian_trade")
def _(s, d):
    return Matrix.adjacency(trade(s, d).edges, NATIONS).laplacian().cells


@query("dsl_pagerank_trade")
def _(s, d):
    return B.dsl_pagerank(rounds=8)(returns(s, d))


@query("closeness_flows")
def _(s, d):
    return A.closeness(flows(s, d))


@query("betweenness_flows")
def _(s, d):
    return A.betweenness(flows(s, d, False), normalized=False)


def _one(s: SparkSession) -> DataFrame:
    """The customer that searches start from."""
    return s.createDataFrame([(1,)], "node_id long")
