"""Every registered query of the reference's operators against DuckDB on the smallest tables."""

import pytest
from conftest import DATA, same_rows

from quillgraph.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLE_SQL:
        same_rows(df, duck, ORACLE_SQL[name])
    else:
        assert df.count() > 0


def _tiny(spark, d):
    """Tables of 14 customers, 5 suppliers and 6 nations; the brute force works on these rows."""
    import random

    rng = random.Random(4)
    customer = [(k, rng.randrange(6), 1.0) for k in range(1, 15)]
    supplier = [(k, rng.randrange(6), 2.0) for k in range(1, 6)]
    orders = [(k, rng.randrange(1, 13)) for k in range(30)]
    lines = [(o, rng.randrange(1, 6), float(rng.randrange(10, 99)), rng.choice("RNA")) for o, c in orders for _ in range(2) if c < 11 or o % 2]
    for name, rows, schema in (("customer", customer, "c_custkey long, c_nationkey int, c_acctbal double"), ("supplier", supplier, "s_suppkey long, s_nationkey int, s_acctbal double"), ("orders", orders, "o_orderkey long, o_custkey long"), ("lineitem", lines, "l_orderkey long, l_suppkey long, l_extendedprice double, l_returnflag string"), ("nation", [(k, str(k), k % 2) for k in range(6)], "n_nationkey int, n_name string, n_regionkey int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    of = dict(orders)
    sold, back = {}, {}
    for o, p, w, flag in lines:
        k = (of[o], p + 10**9)
        sold[k] = sold.get(k, 0) + w
        if flag == "R":
            back[k[1], k[0]] = back.get((k[1], k[0]), 0) + w
    nation = {**{k: n for k, n, _ in customer}, **{k + 10**9: n for k, n, _ in supplier}}
    flows = {(nation[b], nation[a]) for a, b in sold if nation[a] != nation[b]}
    return nation, sold, {**sold, **back}, flows


def test_whole_graphs_against_brute_force(spark, tmp_path):
    """The algorithms over graphs with no edge left out, by plain loops over all nodes."""
    import itertools
    from math import inf

    nation, sold, returned, flow = _tiny(spark, str(tmp_path))
    run = lambda name: {r[0]: r[1] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    near = lambda want: pytest.approx(want, abs=1e-6)
    both = lambda edges: {(x, y) for a, b in edges for x, y in ((a, b), (b, a))}

    def distances(nodes, weight):  # Floyd and Warshall
        d = {(x, y): 0 if x == y else weight.get((x, y), inf) for x in nodes for y in nodes}
        for k, x, y in itertools.product(nodes, repeat=3):
            d[x, y] = min(d[x, y], d[x, k] + d[k, y])
        return d

    out = {x: [b for a, b in returned if a == x] for x in nation}
    hops, cost = distances(nation, dict.fromkeys(returned, 1)), distances(nation, returned)
    joined = distances(nation, dict.fromkeys(both(sold), 1))
    assert max(sum(a == x for a, _ in flow) for x in range(6)) > 3  # more flows than the three that flow() keeps
    rank = dict.fromkeys(nation, 1 / len(nation))
    for _ in range(10):
        sink = sum(rank[x] for x in nation if not out[x]) / len(nation)
        rank = {x: 0.15 / len(nation) + 0.85 * (sink + sum(rank[y] / len(out[y]) for y in nation if x in out[y])) for x in nation}
    assert run("pagerank_trade") == near(rank)
    assert run("bfs_trade") == {x: hops[1, x] for x in nation if hops[1, x] < inf}
    assert run("shortest_paths_trade") == near({x: cost[1, x] for x in nation if cost[1, x] < inf})
    assert run("connected_components_trade") == {x: min(y for y in nation if joined[x, y] < inf) for x in nation}
    strong = {x: min(y for y in nation if hops[x, y] < inf and hops[y, x] < inf) for x in nation}
    assert run("strong_components_trade") == strong and len(set(strong.values())) > 1
    label = {x: x for x in nation}
    for _ in range(4):
        votes = {x: [label[y] for z, y in both(sold) if z == x] + [label[x]] for x in nation}
        label = {x: min(v, key=lambda k: (-v.count(k), k)) for x, v in votes.items()}
    assert run("label_propagation_trade") == label
    core, size = set(nation), -1
    while len(core) != size:
        size = len(core)
        core = {x for x in core if sum(z == x and y in core for z, y in both(sold)) >= 8}
    assert run("k_core_trade") == {x: int(x in core) for x in nation}
    place = both([*sold, *((k, n + 2 * 10**9) for k, n in nation.items())])
    every = [*nation, *(k + 2 * 10**9 for k in range(6))]
    degree = {x: sum(a == x for a, _ in place) for x in every}
    found = {x: sum((x, y) in place and (x, z) in place and (y, z) in place for y, z in itertools.combinations(every, 2)) for x in every}
    assert run("triangles_places") == found and sum(found.values())
    assert run("clustering_places") == near({x: 2 * found[x] / (k * (k - 1)) if k > 1 else 0.0 for x, k in degree.items()})
    assert QUERIES["transitivity_places"](spark, str(tmp_path)).first()[0] == near(sum(found.values()) / sum(k * (k - 1) / 2 for k in degree.values()))
    total = sum(sold.values())
    share = lambda k: sum(w * ((nation[a] == k) + (nation[b] == k)) for (a, b), w in sold.items()) / (2 * total)
    want = sum(w for (a, b), w in sold.items() if nation[a] == nation[b]) / total - sum(share(k) ** 2 for k in range(6))
    assert QUERIES["modularity_trade"](spark, str(tmp_path)).first()[0] == near(want)
    cells = {(r["i"], r["j"]): r["v"] for r in QUERIES["laplacian_trade"](spark, str(tmp_path)).collect()}
    ends = [x for e in sold for x in e]
    assert cells == {**dict.fromkeys(both(sold), -1.0), **{(x, x): float(ends.count(x)) for x in ends}}
    steps = distances(range(6), dict.fromkeys(flow, 1))
    assert run("closeness_flows") == near({x: sum(1 / steps[x, y] for y in range(6) if 0 < steps[x, y] < inf) for x in range(6)})
    steps, between = distances(range(6), dict.fromkeys(both(flow), 1)), dict.fromkeys(range(6), 0.0)
    for s, t in itertools.combinations(range(6), 2):
        if steps[s, t] < inf:
            paths = [q for q in itertools.permutations([x for x in range(6) if x not in (s, t)], steps[s, t] - 1) if all(e in both(flow) for e in itertools.pairwise((s, *q, t)))]
            for q in paths:
                for x in q:
                    between[x] += 1 / len(paths)
    assert run("betweenness_flows") == near(between)
    walks = {(r["walk"], r["step"]): r["node_id"] for r in QUERIES["random_walks"](spark, str(tmp_path)).collect()}
    assert all(x == w if not k else x == w or x in out[walks[w, k - 1]] for (w, k), x in walks.items())


@pytest.mark.parametrize("name", ["commit_at_time", "commits_between"])
def test_commits_within_one_second(spark, tmp_path, name):
    """Five events a second: later ones of the same second don't count; without the event there is no commit."""
    import duckdb

    for ids, folder in ((range(400), "many"), (range(30), "few")):
        d = tmp_path / folder
        rows = spark.range(len(ids)).selectExpr("id AS event_id", "CAST(timestamp_micros(1704067200000000 + id * 200001) AS timestamp_ntz) AS ts", "id % 7 AS user_id", "'view' AS event_type", "CAST(id AS double) AS value")
        rows.coalesce(1).write.parquet(f"{d}/events.parquet")
        c = duckdb.connect()
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet/*.parquet'")
        same_rows(QUERIES[name](spark, str(d)), c, ORACLE_SQL[name])
