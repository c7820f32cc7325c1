"""Changes that arrive as a stream: windowed counts, sessions, and a latest-state table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_events(spark: SparkSession, path: str, schema, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed(events: DataFrame, ts: str, keys: list[str], size: str, slide: str | None = None, late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """Counts (and sums) by event-time window and keys; rows later than ``late`` are left out."""
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    out = events.withWatermark(ts, late).groupBy(F.window(ts, size, slide) if slide else F.window(ts, size), *keys).agg(*aggs)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", *(["total"] if value else []))


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def latest(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last change of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return changes.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert_to(path: str, keys: list[str], order: str):
    """A ``foreachBatch`` sink: merges each batch into a table of latest rows.

    Versions of the table stand side by side, so that a batch that is run again after a failure reads what
    it read before; the newest version below the batch's number is its base.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = current(spark, path, below=number)
        rows = batch if old is None else old.unionByName(batch, allowMissingColumns=True)
        latest(rows, keys, order).write.mode("overwrite").parquet(f"{path}/version={number}")

    return write


def current(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """The newest version of the table that ``upsert_to`` keeps."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    found = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root) if s.getPath().getName().startswith("version=") and fs.exists(hadoop.Path(s.getPath(), "_SUCCESS"))]
    found = [v for v in found if below is None or v < below]
    return spark.read.parquet(f"{path}/version={max(found)}") if found else None
