"""Tables and graphs from and to files, pandas and networkx."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.operators.graph import Graph, assign_edge_ids, merge
from quillgraph.operators.table import DRIVER_ROWS
from quillgraph.plans.ordering import with_position


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Header CSV; types are inferred where no schema is given."""
    r = spark.read.option("header", True)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header and rows; nulls are empty, arrays and structs become JSON text."""
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType) else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def read_json_table(spark: SparkSession, path: str) -> DataFrame:
    """One document ``{columns, nrows, data: [row objects]}``."""
    doc = spark.read.option("multiLine", True).json(path)
    rows = doc.select(F.explode("data").alias("r")).select("r.*")
    order = doc.select("columns").first()[0] if "columns" in doc.columns else rows.columns
    return rows.select(*[c for c in order if c in rows.columns])


def write_json_lines(df: DataFrame, path: str) -> None:
    """A row object a line, which any number of tasks can write."""
    df.write.mode("overwrite").json(path)


def _fits(df: DataFrame) -> None:
    if df.limit(DRIVER_ROWS + 1).count() > DRIVER_ROWS:
        raise ValueError(f"the driver takes tables of up to {DRIVER_ROWS} rows")


def json_document(df: DataFrame) -> str:
    """One document of a table of up to ``DRIVER_ROWS`` rows, as ``read_json_table`` takes it."""
    _fits(df)
    rows = [json.loads(r) for r in df.toJSON().collect()]
    return json.dumps({"columns": df.columns, "nrows": len(rows), "data": rows})


def from_columns(spark: SparkSession, columns: Mapping[str, Sequence], order: Sequence[str] | None = None) -> DataFrame:
    """A table of columns of equal length."""
    names = list(order or columns)
    if len({len(columns[n]) for n in names}) > 1:
        raise ValueError("columns differ in length")
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({n: columns[n] for n in names}))


def from_pandas(spark: SparkSession, frame) -> DataFrame:
    """A table of a pandas frame; an index with a name becomes a column."""
    return spark.createDataFrame(frame.reset_index() if any(frame.index.names) else frame)


def to_nodes(df: DataFrame, key: str) -> DataFrame:
    """Node rows of a table: its key becomes ``node_id`` and must be there and unique."""
    out = df.withColumnRenamed(key, "node_id")
    bad = out.agg(F.count_if(F.col("node_id").isNull()).alias("null"), (F.count("node_id") - F.count_distinct("node_id")).alias("again")).first()
    if bad["null"] or bad["again"]:
        raise ValueError(f"{bad['null']} rows have no {key} and {bad['again']} repeat one")
    return out


def to_edges(df: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Edge rows of a table: both ends must be there; ids are given where there are none."""
    out = df.withColumnsRenamed({source: "source", target: "target"})
    lost = out.where("source IS NULL OR target IS NULL").count()
    if lost:
        raise ValueError(f"{lost} rows lack an end")
    return out if "edge_id" in out.columns else assign_edge_ids(out)


def from_numpy(spark: SparkSession, a) -> DataFrame:
    """1-D: (ord, value); 2-D: cells (i, j, v)."""
    if a.ndim == 1:
        return spark.createDataFrame([(i, float(x)) for i, x in enumerate(a)], "ord long, value double")
    return spark.createDataFrame([(i, j, float(x)) for (i, j), x in __import__("numpy").ndenumerate(a)], "i long, j long, v double")


def graph_from_tables(nodes: DataFrame | None, edges: DataFrame, key: str = "id", source: str = "source", target: str = "target", directed: bool = False) -> Graph:
    """A graph from tables with ids of any type: they are mapped to dense numbers, kept in ``key``.

    Edges an end of which is no node are left out, if nodes are given.
    """
    e = edges.withColumnsRenamed({source: "__s", target: "__t"})
    ids = nodes.select(F.col(key)) if nodes is not None else e.select(F.explode(F.array("__s", "__t")).alias(key))
    numbered = with_position(ids.where(F.col(key).isNotNull()).distinct(), [F.asc(key)], "node_id")
    own = numbered.join(nodes, key) if nodes is not None else numbered
    e = e.join(numbered.select(F.col(key).alias("__s"), F.col("node_id").alias("source")), "__s")
    e = e.join(numbered.select(F.col(key).alias("__t"), F.col("node_id").alias("target")), "__t").drop("__s", "__t")
    return Graph(own, e if "edge_id" in e.columns else assign_edge_ids(e), directed)


def graph_from_csv(spark: SparkSession, nodes: str | None, edges: str, **names) -> Graph:
    return graph_from_tables(read_csv(spark, nodes) if nodes else None, read_csv(spark, edges), **names)


def save_bundle(g: Graph, path: str) -> dict:
    """Nodes and edges as Parquet with a manifest of schemas, counts and order-free checksums."""
    spark = g.nodes.sparkSession
    manifest = {"format": 1, "directed": g.directed}
    for name, df in (("nodes", g.nodes), ("edges", g.edges)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        manifest[name] = _digest(spark.read.parquet(f"{path}/{name}")) | {"schema": df.schema.simpleString()}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def _digest(df: DataFrame) -> dict:
    n, s = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).first()
    return {"rows": n, "checksum": str(s)}


def bundle_info(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def validate_bundle(spark: SparkSession, path: str) -> list[str]:
    """What differs between a bundle and its manifest."""
    manifest, bad = bundle_info(spark, path), []
    for name in ("nodes", "edges"):
        df = spark.read.parquet(f"{path}/{name}")
        found = _digest(df)
        bad += [f"{name}: {k} is {found[k]}, not {manifest[name][k]}" for k in ("rows", "checksum") if found[k] != manifest[name][k]]
    return bad


def load_bundle(spark: SparkSession, path: str) -> Graph:
    bad = validate_bundle(spark, path)
    if bad:
        raise ValueError("; ".join(bad))
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), bundle_info(spark, path)["directed"])


def load_federated(spark: SparkSession, paths: Mapping[str, str]) -> Graph:
    """Several bundles (domain -> path) merged with remapped ids."""
    out = None
    for domain, path in paths.items():
        g = load_bundle(spark, path)
        if out is None:
            named = g.nodes.withColumns({"_domain": F.lit(domain), "_original_id": F.col("node_id")})
            out = Graph(named, g.edges, g.directed)
        else:
            kept = out.nodes.select("_domain", "_original_id", "node_id")
            both = merge(Graph(out.nodes.drop("_domain", "_original_id"), out.edges, out.directed), g, "remap", ("", domain))
            nodes = both.nodes.join(kept.toDF("__d", "__o", "node_id"), "node_id", "left")
            nodes = nodes.withColumns({"_domain": F.coalesce("__d", "_domain"), "_original_id": F.coalesce("__o", "_original_id")}).drop("__d", "__o")
            out = Graph(nodes, both.edges, out.directed)
    return out


def to_networkx(g: Graph):
    """A networkx graph of a graph of up to ``DRIVER_ROWS`` nodes and as many edges."""
    import networkx

    _fits(g.nodes)
    _fits(g.edges)

    out = networkx.DiGraph() if g.directed else networkx.Graph()
    for r in g.nodes.collect():
        out.add_node(r["node_id"], **{k: v for k, v in r.asDict().items() if k != "node_id"})
    for r in g.edges.collect():
        out.add_edge(r["source"], r["target"], **{k: v for k, v in r.asDict().items() if k not in ("source", "target")})
    return out


def from_networkx(spark: SparkSession, graph) -> Graph:
    import pandas as pd

    nodes = spark.createDataFrame(pd.DataFrame([{"id": n, **d} for n, d in graph.nodes(data=True)]))
    edges = spark.createDataFrame(pd.DataFrame([{"source": a, "target": b, **d} for a, b, d in graph.edges(data=True)]))
    return graph_from_tables(nodes, edges, directed=graph.is_directed())
