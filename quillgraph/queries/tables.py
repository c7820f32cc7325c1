"""Table operators: filters, joins, groups, windows, statistics, sets, text, arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import scalar
from quillgraph.operators.builder import entropy, histogram
from quillgraph.operators.table import Table, rank_values

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> Table:
    return Table(spark.read.parquet(f"{d}/{name}.parquet"))


def r4(c):
    return F.round(c, 4)


# --- projections and cells ---


@query("select_rename_assign", "SELECT c_custkey AS customer, c_name, round(c_acctbal * 2, 4) AS doubled FROM customer")
def _(s, d):
    t = read(s, d, "customer").assign(doubled=r4(F.col("c_acctbal") * 2)).select("c_custkey", "c_name", "doubled")
    return t.rename({"c_custkey": "customer"}).df


@query("drop_prefix_suffix", "SELECT s_suppkey AS x_s_suppkey_y, s_name AS x_s_name_y FROM supplier")
def _(s, d):
    return read(s, d, "supplier").drop_columns("s_nationkey", "s_acctbal").add_prefix("x_").add_suffix("_y").df


@query("set_values_by_mask", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def _(s, d):
    return read(s, d, "supplier").set_values("s_acctbal", F.lit(0.0), F.col("s_acctbal") < 0).select("s_suppkey", "s_acctbal").df


@query("set_values_by_range", "SELECT n_nationkey, CASE WHEN n_nationkey BETWEEN 5 AND 14 AND (n_nationkey - 5) % 3 = 0 THEN -1 ELSE n_regionkey END AS n_regionkey FROM nation")
def _(s, d):
    return read(s, d, "nation").ordered("n_nationkey").set_range("n_regionkey", -1, 5, 15, 3).df.select("n_nationkey", "n_regionkey")


@query("slice_rows", "SELECT n_nationkey, n_name FROM (SELECT *, row_number() OVER (ORDER BY n_name) - 1 AS o FROM nation) WHERE o >= 3 AND o < 9")
def _(s, d):
    return read(s, d, "nation").ordered("n_name").slice(3, 9).df.select("n_nationkey", "n_name")


@query("head_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20")
def _(s, d):
    return read(s, d, "orders").ordered("o_orderdate", "o_orderkey").head(20).df.select("o_orderkey", "o_totalprice")


@query("tail_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def _(s, d):
    return read(s, d, "orders").ordered("o_orderdate", "o_orderkey").tail(20).df.select("o_orderkey", "o_totalprice")


@query("take_rows", "SELECT CAST(ask.o AS BIGINT) AS ord, n.n_name FROM (VALUES (0, 4), (1, 2), (2, 4)) ask(o, p) JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS p FROM nation) n USING (p)")
def _(s, d):
    return read(s, d, "nation").ordered("n_nationkey").take_rows([4, 2, 4]).df.select("ord", "n_name")


@query("drop_rows", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (0, 3, 24)")
def _(s, d):
    return read(s, d, "nation").ordered("n_nationkey").drop_rows([0, 3, 24]).df.select("n_name")


# --- filters ---


@query("filter_predicate", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 40 AND l_discount BETWEEN 0.02 AND 0.05) OR NOT (l_returnflag IN ('A', 'N') OR l_tax > 0.01)")
def _(s, d):
    return read(s, d, "lineitem").filter("(l_quantity > 40 AND l_discount BETWEEN 0.02 AND 0.05) OR NOT (l_returnflag IN ['A', 'N'] OR l_tax > 0.01)").df.select("l_orderkey", "l_linenumber")


@query("filter_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%' AND p_name IS NOT NULL")
def _(s, d):
    return read(s, d, "part").query("p_type LIKE '%A%' AND p_name").select("p_partkey", "p_type").df


@query("isin_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def _(s, d):
    big = read(s, d, "orders").filter("o_totalprice > 200000").select("o_custkey").df
    return read(s, d, "customer").isin("c_custkey", big).select("c_custkey").df


@query("null_counts", "SELECT * FROM (VALUES ('event_id'), ('user_id'), ('value'), ('props')) c(\"column\") JOIN (SELECT unnest(['event_id', 'user_id', 'value', 'props']) AS \"column\", unnest([count(*) - count(event_id), count(*) - count(user_id), count(*) - count(value), count(*) - count(props)]) AS null_count FROM events) USING (\"column\")")
def _(s, d):
    return read(s, d, "events").select("event_id", "user_id", "value", "props").null_counts()


@query("fillna_dropna", "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END, -1.0) AS p FROM orders WHERE o_orderpriority IS NOT NULL")
def _(s, d):
    t = read(s, d, "orders").dropna(["o_orderpriority"])
    return t.with_column("p", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))).fillna({"p": -1.0}).select("o_orderkey", "p").df


# --- joins ---


@query("join_inner", "SELECT o.o_custkey AS key, o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def _(s, d):
    a = read(s, d, "orders").rename({"o_custkey": "key"}).select("key", "o_orderkey")
    return a.join(read(s, d, "customer").rename({"c_custkey": "key"}).select("key", "c_name"), "key").df


@query("join_left", "SELECT c.c_custkey AS key, c.c_name, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey")
def _(s, d):
    a = read(s, d, "customer").rename({"c_custkey": "key"}).select("key", "c_name")
    return a.join(read(s, d, "orders").rename({"o_custkey": "key"}).select("key", "o_orderkey"), "key", "left").df


@query("join_right", "SELECT c.c_custkey AS key, c.c_name, o.o_orderkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey")
def _(s, d):
    a = read(s, d, "orders").rename({"o_custkey": "key"}).select("key", "o_orderkey")
    return a.join(read(s, d, "customer").rename({"c_custkey": "key"}).select("key", "c_name"), "key", "right").df


@query("join_outer_collision", "SELECT coalesce(a.k, b.k) AS k, a.n AS n, b.n AS n_right FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) b ON a.k = b.k")
def _(s, d):
    a = Table(read(s, d, "supplier").df.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n")))
    b = Table(read(s, d, "customer").filter("c_acctbal > 5000").df.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n")))
    return a.join(b, "k", "outer").df


@query("join_cross", "SELECT a.r_regionkey, a.r_name, b.r_regionkey AS r_regionkey_right, b.r_name AS r_name_right FROM region a CROSS JOIN region b")
def _(s, d):
    return read(s, d, "region").cross_join(read(s, d, "region")).df


@query("join_semi", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def _(s, d):
    lines = read(s, d, "lineitem").filter("l_quantity >= 49").rename({"l_partkey": "p_partkey"})
    return read(s, d, "part").select("p_partkey").join(lines, "p_partkey", "semi").df


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(s, d):
    return read(s, d, "customer").select("c_custkey").join(read(s, d, "orders").rename({"o_custkey": "c_custkey"}), "c_custkey", "anti").df


@query("join_multi_column", "SELECT l_orderkey, l_linenumber, b.q FROM lineitem JOIN (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) b USING (l_partkey, l_suppkey)")
def _(s, d):
    lines = read(s, d, "lineitem")
    q = Table(lines.groupby("l_partkey", "l_suppkey").agg({"l_quantity": "sum"}).withColumnRenamed("l_quantity", "q"))
    return lines.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber").join(q, ["l_partkey", "l_suppkey"]).df.select("l_orderkey", "l_linenumber", "q")


@query("concat_columns", "SELECT a.o AS ord, n_name, r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS o FROM nation) a LEFT JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS o FROM region) b ON a.o = b.o")
def _(s, d):
    return read(s, d, "nation").ordered("n_nationkey").select("n_name").concat(read(s, d, "region").ordered("r_regionkey").select("r_name")).df


@query("asof_join", "SELECT a.event_id, b.event_id AS before_id FROM events a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts WHERE a.event_type = 'purchase'")
def _(s, d):
    """The last click of a user at or before each purchase, in one sorted pass over both."""
    e = read(s, d, "events").df.select("event_id", "user_id", "ts", "event_type")
    clicks = Table(e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("before_id")))
    return Table(e.where("event_type = 'purchase'")).asof_join(clicks, "ts", ["user_id"]).df.select("event_id", "before_id")


# --- groups ---


@query("group_agg", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS q, round(avg(l_extendedprice), 4) AS p, min(l_discount) AS lo, max(l_tax) AS hi, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1, 2")
def _(s, d):
    g = read(s, d, "lineitem").with_column("n", F.lit(1)).groupby("l_returnflag", "l_linestatus")
    out = g.agg({"n": "count", "l_quantity": "sum", "l_extendedprice": "mean", "l_discount": "min", "l_tax": "max", "l_suppkey": "nunique"})
    return out.select("l_returnflag", "l_linestatus", "n", r4("l_quantity").alias("q"), r4("l_extendedprice").alias("p"), F.col("l_discount").alias("lo"), F.col("l_tax").alias("hi"), F.col("l_suppkey").alias("s"))


@query("group_count_sizes", "SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY 1, 2")
def _(s, d):
    return read(s, d, "orders").groupby("o_orderstatus", "o_orderpriority").count()


@query("group_filter", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) >= 3)")
def _(s, d):
    return read(s, d, "supplier").select("s_suppkey", "s_nationkey").groupby("s_nationkey").filter("n >= 3", n=F.count(F.lit(1)))


@query("group_take", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT DISTINCT c_nationkey FROM customer ORDER BY 1 LIMIT 3 OFFSET 2)")
def _(s, d):
    return read(s, d, "customer").select("c_custkey", "c_nationkey").groupby("c_nationkey").take(3, 2)


@query("group_describe", "SELECT c_mktsegment, 'c_acctbal' AS \"column\", count(c_acctbal) AS count, round(avg(c_acctbal), 4) AS mean, round(stddev_pop(c_acctbal), 4) AS std, min(c_acctbal) AS min, max(c_acctbal) AS max FROM customer GROUP BY 1")
def _(s, d):
    return read(s, d, "customer").select("c_mktsegment", "c_acctbal").groupby("c_mktsegment").describe().withColumns({"mean": r4("mean"), "std": r4("std")})


@query("group_bool_all", "SELECT o_orderpriority, bool_and(o_totalprice > 2000) AS rich, bool_and(o_custkey > 0) AS known FROM orders GROUP BY 1")
def _(s, d):
    t = read(s, d, "orders").assign(rich=F.col("o_totalprice") > 2000, known=F.col("o_custkey") > 0)
    return t.groupby("o_orderpriority").all()


@query("group_map", "SELECT c_nationkey, max(c_acctbal) - min(c_acctbal) AS spread FROM customer GROUP BY 1")
def _(s, d):
    import pandas as pd

    def spread(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c_nationkey": p.c_nationkey[:1], "spread": [p.c_acctbal.max() - p.c_acctbal.min()]})

    return read(s, d, "customer").select("c_nationkey", "c_acctbal").groupby("c_nationkey").map(spread, "c_nationkey int, spread double")


@query("group_shape", "SELECT count(DISTINCT c_nationkey) AS groups, count(*) AS rows, 5 AS cols FROM customer")
def _(s, d):
    return read(s, d, "customer").groupby("c_nationkey").shape()


@query("aggregate_table", "SELECT round(sum(o_totalprice), 2) AS o_totalprice, count(o_orderkey) AS o_orderkey, max(o_custkey) AS o_custkey FROM orders")
def _(s, d):
    return read(s, d, "orders").aggregate({"o_totalprice": "sum", "o_orderkey": "count", "o_custkey": "max"}).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("pivot_table", "SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 4) AS \"l_linestatus_F\", round(sum(l_quantity) FILTER (l_linestatus = 'O'), 4) AS \"l_linestatus_O\" FROM lineitem GROUP BY 1")
def _(s, d):
    out = read(s, d, "lineitem").pivot_table(["l_returnflag"], "l_linestatus", "l_quantity", "sum", ["F", "O"]).df
    return out.withColumns({c: r4(c) for c in ("l_linestatus_F", "l_linestatus_O")})


@query("melt", "SELECT s_suppkey, 's_acctbal' AS variable, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 's_nationkey', s_nationkey FROM supplier")
def _(s, d):
    t = read(s, d, "supplier").with_column("s_nationkey", F.col("s_nationkey").cast("double"))
    return t.melt(["s_suppkey"], ["s_acctbal", "s_nationkey"]).df


@query("value_counts", "SELECT event_type AS value, count(*) AS count FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def _(s, d):
    return read(s, d, "events").value_counts("event_type")


@query("describe", "SELECT 'p_retailprice' AS \"column\", count(p_retailprice) AS count, round(avg(p_retailprice), 4) AS mean, round(stddev_pop(p_retailprice), 4) AS std, min(p_retailprice) AS min, round(quantile_cont(p_retailprice, 0.25), 4) AS p25, round(quantile_cont(p_retailprice, 0.5), 4) AS p50, round(quantile_cont(p_retailprice, 0.75), 4) AS p75, max(p_retailprice) AS max FROM part UNION ALL SELECT 'p_size', count(p_size), round(avg(p_size), 4), round(stddev_pop(p_size), 4), min(p_size), round(quantile_cont(p_size, 0.25), 4), round(quantile_cont(p_size, 0.5), 4), round(quantile_cont(p_size, 0.75), 4), max(p_size) FROM part")
def _(s, d):
    out = read(s, d, "part").select("p_size", "p_retailprice").describe()
    return out.withColumns({c: r4(c) for c in ("mean", "std", "p25", "p50", "p75")})


@query("profile", "SELECT * FROM (SELECT 'n_name' AS \"column\", 'string' AS dtype, count(*) AS rows, count(*) - count(n_name) AS nulls, count(DISTINCT n_name) AS \"unique\", count(DISTINCT n_name) / count(n_name) AS cardinality FROM nation UNION ALL SELECT 'n_regionkey', 'int', count(*), count(*) - count(n_regionkey), count(DISTINCT n_regionkey), count(DISTINCT n_regionkey) / count(n_regionkey) FROM nation)")
def _(s, d):
    return read(s, d, "nation").select("n_name", "n_regionkey").profile()


@query("outliers", "WITH q AS (SELECT list_sort(list(l_extendedprice)) AS a, count(*) AS n FROM lineitem), b AS (SELECT a[1 + CAST(floor(n * 0.25) AS BIGINT)] AS q1, a[1 + CAST(floor(n * 0.75) AS BIGINT)] AS q3 FROM q) SELECT l_orderkey, l_linenumber, l_extendedprice < q1 - 0.5 * (q3 - q1) OR l_extendedprice > q3 + 0.5 * (q3 - q1) AS is_outlier FROM lineitem, b")
def _(s, d):
    return read(s, d, "lineitem").outliers("l_extendedprice", 0.5).df.select("l_orderkey", "l_linenumber", "is_outlier")


@query("quantiles", "SELECT round(quantile_cont(l_extendedprice, 0.1), 4) AS linear, list_sort(list(l_extendedprice))[1 + CAST(floor(0.1 * (count(*) - 1)) AS BIGINT)] AS lower, list_sort(list(l_extendedprice))[1 + CAST(ceil(0.1 * (count(*) - 1)) AS BIGINT)] AS higher FROM lineitem")
def _(s, d):
    t = read(s, d, "lineitem")
    lower, higher = t.quantile("l_extendedprice", 0.1, "lower"), t.quantile("l_extendedprice", 0.1, "higher")
    return t.df.agg(r4(F.percentile("l_extendedprice", 0.1)).alias("linear")).withColumns({"lower": F.lit(lower), "higher": F.lit(higher)})


@query("corr_pearson", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem")
def _(s, d):
    return read(s, d, "lineitem").corr("l_quantity", "l_extendedprice").select(F.round("corr", 6).alias("corr"))


@query("corr_spearman", "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS b FROM lineitem) SELECT round(corr(a, b), 6) AS corr FROM r")
def _(s, d):
    return read(s, d, "lineitem").corr("l_quantity", "l_discount", "spearman").select(F.round("corr", 6).alias("corr"))


@query("corr_kendall", "SELECT round(sum(sign(b.p_retailprice - a.p_retailprice)) / max(n * (n - 1) / 2.0), 6) AS corr FROM part a JOIN part b ON a.p_size < b.p_size, (SELECT count(*) AS n FROM part)")
def _(s, d):
    return read(s, d, "part").corr("p_size", "p_retailprice", "kendall").select(F.round("corr", 6).alias("corr"))


@query("cov_matrix", "SELECT 'p_size' AS \"index\", round(var_samp(p_size), 4) AS p_size, round(covar_samp(p_size, p_retailprice), 4) AS p_retailprice FROM part UNION ALL SELECT 'p_retailprice', round(covar_samp(p_retailprice, p_size), 4), round(var_samp(p_retailprice), 4) FROM part")
def _(s, d):
    return read(s, d, "part").select("p_size", "p_retailprice").cov_matrix().withColumns({c: r4(c) for c in ("p_size", "p_retailprice")})


@query("std_var_median", "SELECT round(stddev_samp(o_totalprice), 4) AS sd, round(var_samp(o_totalprice), 1) AS va, round(median(o_totalprice), 4) AS med FROM orders")
def _(s, d):
    t = read(s, d, "orders").df
    return t.agg(r4(F.stddev_samp("o_totalprice")).alias("sd"), F.round(F.var_samp("o_totalprice"), 1).alias("va"), r4(F.median("o_totalprice")).alias("med"))


@query("bool_stats", "SELECT count(*) FILTER (b) AS trues, count(*) FILTER (NOT b) AS falses, bool_or(b) AS any_true, bool_and(b) AS all_true, round(avg(CAST(b AS INT)) * 100, 4) AS pct FROM (SELECT o_totalprice > 100000 AS b FROM orders)")
def _(s, d):
    b = F.col("o_totalprice") > 100000
    return read(s, d, "orders").df.agg(F.count_if(b).alias("trues"), F.count_if(~b).alias("falses"), F.bool_or(b).alias("any_true"), F.bool_and(b).alias("all_true"), r4(F.avg(b.cast("int")) * 100).alias("pct"))


@query("entropy", "SELECT round(-sum(n / t * log2(n / t)), 6) AS entropy FROM (SELECT count(*) AS n FROM events GROUP BY event_type), (SELECT count(*) AS t FROM events)")
def _(s, d):
    return entropy(read(s, d, "events").df, "event_type").select(F.round("entropy", 6).alias("entropy"))


@query("histogram", "SELECT CAST(least(floor((value - lo) / ((hi - lo) / 12)), 11) AS BIGINT) AS bin, count(*) AS count FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) WHERE value IS NOT NULL GROUP BY 1")
def _(s, d):
    return histogram(read(s, d, "events").df, "value", 12)


# --- windows ---

_USER = "OVER (PARTITION BY user_id ORDER BY ts, event_id"


def _events(s, d) -> Table:
    e = read(s, d, "events").select("event_id", "ts", "user_id", "value")
    return e.ordered("ts", "event_id")


@query("rolling_mean_by_user", f"SELECT event_id, CASE WHEN count(*) {_USER} ROWS 2 PRECEDING) >= 3 THEN round(avg(value) {_USER} ROWS 2 PRECEDING), 4) END AS m FROM events")
def _(s, d):
    return _events(s, d).rolling("value", 3, "mean", "m", ["user_id"]).df.select("event_id", r4("m").alias("m"))


@query("rolling_std_global", "SELECT event_id, CASE WHEN count(*) OVER w >= 5 THEN round(stddev_pop(value) OVER w, 4) END AS sd FROM events WINDOW w AS (ORDER BY ts, event_id ROWS 4 PRECEDING)")
def _(s, d):
    return _events(s, d).rolling("value", 5, "std", "sd").df.select("event_id", r4("sd").alias("sd"))


@query("expanding_mean", f"SELECT event_id, round(avg(value) {_USER}), 9) AS m, max(value) {_USER}) AS hi FROM events")
def _(s, d):
    t = _events(s, d).expanding("value", "mean", "m", ["user_id"]).cummax("value", "hi", ["user_id"])
    return t.df.select("event_id", F.round("m", 9).alias("m"), "hi")


@query("cumsum_global", "SELECT event_id, round(sum(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS total, min(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS lo FROM events")
def _(s, d):
    return _events(s, d).cumsum("value", "total").cummin("value", "lo").df.select("event_id", F.round("total", 2).alias("total"), "lo")


@query("shift_pct_change", f"SELECT event_id, lag(value, 1) {_USER}) AS before, lead(value, 1, -1.0) {_USER}) AS after, round(CASE WHEN lag(value) {_USER}) <> 0 THEN (value - lag(value) {_USER})) / lag(value) {_USER}) END, 4) AS pct FROM events")
def _(s, d):
    by = ["user_id"]
    t = _events(s, d).shift("value", 1, "before", by).shift("value", -1, "after", by, -1.0).pct_change("value", "pct", 1, by)
    return t.df.select("event_id", "before", "after", r4("pct").alias("pct"))


@query("shift_global", "SELECT event_id, lag(value, 2) OVER (ORDER BY ts, event_id) AS before FROM events")
def _(s, d):
    return _events(s, d).shift("value", 2, "before").df.select("event_id", "before")


@query("rank_average", "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS rank FROM part")
def _(s, d):
    return rank_values(read(s, d, "part").df.select("p_partkey", "p_size"), "p_size", "rank").select("p_partkey", F.col("rank").cast("double").alias("rank"))


# --- order, samples, sets ---


@query("sort_values", "SELECT n_nationkey, n_regionkey FROM nation")
def _(s, d):
    return read(s, d, "nation").sort_values("n_regionkey", "n_name", ascending=[False, True]).select("n_nationkey", "n_regionkey")


@query("nlargest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def _(s, d):
    return read(s, d, "orders").nlargest(15, "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("nsmallest", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 5")
def _(s, d):
    return read(s, d, "supplier").nsmallest(5, "s_acctbal", "s_suppkey").select("s_suppkey", "s_acctbal")


@query("sample_weighted")
def _(s, d):
    return read(s, d, "orders").sample(n=50, weight="o_totalprice", seed=3).select("o_orderkey").df


@query("sample_with_replacement")
def _(s, d):
    return read(s, d, "orders").select("o_orderkey", "o_totalprice").sample(n=50, weight="o_totalprice", replace=True, seed=3).df


@query("drop_duplicates", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def _(s, d):
    return read(s, d, "orders").ordered("o_orderdate", "o_orderkey").drop_duplicates(["o_custkey"]).df.select("o_custkey", "o_orderkey")


def _keys(s, d) -> tuple[Table, Table]:
    a = Table(read(s, d, "customer").df.select(F.col("c_nationkey").alias("k")))
    return a, Table(read(s, d, "supplier").filter("s_acctbal > 0").df.select(F.col("s_nationkey").alias("k")))


@query("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def _(s, d):
    a, b = _keys(s, d)
    return a.union(b).df


@query("set_stack", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def _(s, d):
    a, b = _keys(s, d)
    return a.stack(b).df


@query("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def _(s, d):
    a, b = _keys(s, d)
    return a.intersect(b).df


@query("set_subtract", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def _(s, d):
    a, b = _keys(s, d)
    return a.subtract(b).df


# --- text, arrays, functions of the caller ---


@query("string_functions", "SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, strlen(p_name) AS bytes, trim(p_name) AS stripped, contains(p_name, 'a') AS has, starts_with(p_type, 'S') AS st, ends_with(p_type, 'L') AS en, replace(p_brand, '#', '-') AS rep, split_part(p_name, ' ', 1) AS first, substring(p_name, 3, 4) AS cut, lpad(p_brand, 12, '*') AS padded FROM part")
def _(s, d):
    t = read(s, d, "part")
    return t.df.select("p_partkey", scalar.upper("p_name").alias("up"), scalar.lower("p_type").alias("low"), scalar.byte_length("p_name").cast("long").alias("bytes"), scalar.strip("p_name").alias("stripped"), scalar.contains("p_name", "a").alias("has"), scalar.startswith("p_type", "S").alias("st"), scalar.endswith("p_type", "L").alias("en"), scalar.replace("p_brand", "#", "-").alias("rep"), scalar.split_first("p_name", " ").alias("first"), scalar.slice_text("p_name", 2, 4).alias("cut"), scalar.pad("p_brand", 12, "left", "*").alias("padded"))


@query("pad_both", "SELECT r_regionkey, CASE WHEN length(r_name) >= 14 THEN r_name ELSE rpad(lpad(r_name, CAST(length(r_name) + floor((14 - length(r_name)) / 2) AS INT), '.'), 14, '.') END AS padded FROM region")
def _(s, d):
    return read(s, d, "region").df.select("r_regionkey", scalar.pad("r_name", 14, "both", ".").alias("padded"))


@query("array_stats", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS total, round(list_avg(embedding::DOUBLE[]), 4) AS mean, round(list_stddev_samp(embedding::DOUBLE[]), 4) AS sd, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi, len(embedding) AS n FROM embeddings")
def _(s, d):
    e = read(s, d, "embeddings").df.withColumn("x", F.col("embedding").cast("array<double>"))
    return e.select("vec_id", r4(scalar.array_sum("x")).alias("total"), r4(scalar.array_mean("x")).alias("mean"), r4(scalar.array_std("x")).alias("sd"), F.array_min("x").alias("lo"), F.array_max("x").alias("hi"), F.size("x").cast("long").alias("n"))


@query("array_slice_filter", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS positive, embedding[1]::DOUBLE AS first, embedding[-1]::DOUBLE AS last FROM embeddings")
def _(s, d):
    e = read(s, d, "embeddings").df
    return e.select("vec_id", F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("positive"), F.element_at("embedding", 1).cast("double").alias("first"), F.element_at("embedding", -1).cast("double").alias("last"))


@query("apply_to_columns", "SELECT s_suppkey, round(sqrt(abs(s_acctbal)), 4) AS s_acctbal FROM supplier")
def _(s, d):
    return read(s, d, "supplier").apply_to_columns(lambda c: r4(F.sqrt(F.abs(c))), ["s_acctbal"]).select("s_suppkey", "s_acctbal").df


@query("apply_to_rows", "SELECT p_partkey, p_retailprice / p_size AS unit FROM part")
def _(s, d):
    return read(s, d, "part").select("p_partkey", "p_size", "p_retailprice").apply_to_rows(lambda rows: rows["p_retailprice"] / rows["p_size"], "unit", "double").select("p_partkey", "unit").df


@query("activations", "SELECT s_suppkey, round(greatest(x, 0.0), 6) AS relu, round(CASE WHEN x > 0 THEN x ELSE x * 0.01 END, 6) AS leaky, round(1 / (1 + exp(-x)), 6) AS sig, round((exp(x) - exp(-x)) / (exp(x) + exp(-x)), 6) AS th, round(x / (1 + exp(-x)), 6) AS sw FROM (SELECT s_suppkey, s_acctbal / 5000 AS x FROM supplier)")
def _(s, d):
    t = read(s, d, "supplier").df.withColumn("x", F.col("s_acctbal") / 5000)
    return t.select("s_suppkey", *[F.round(f("x"), 6).alias(n) for n, f in (("relu", scalar.relu), ("leaky", scalar.leaky_relu), ("sig", scalar.sigmoid), ("th", scalar.tanh), ("sw", scalar.swish))])
