"""Shared storage for iterative plans.

Long plans are cut by writing an intermediate table to the folder that the cluster names in
``spark.checkpoint.dir``.  Such a table survives the loss of any executor, and a later read starts
from files, not from a long lineage.  A session's tables stand in a folder of its own, which goes when the
driver's process ends; ``drop`` removes single ones as soon as nothing reads them any more.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Used only by local sessions that name no checkpoint folder, as tests do.
LOCAL_FALLBACK = "/tmp/checkpoints/quillgraph"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; local sessions without one get ``LOCAL_FALLBACK``.

    A session on a real cluster that names none is refused: a machine-local folder would lose data
    together with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/") + "/quillgraph"
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return LOCAL_FALLBACK
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system the path names."""
    _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)


def _delete(jvm, conf, path: str) -> None:
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


_run_dirs: set[str] = set()


def run_dir(spark: SparkSession) -> str:
    """The session's own folder in shared storage; it is deleted at the end of the driver's process."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/{sc.applicationId}"
    if path not in _run_dirs:
        _run_dirs.add(path)
        jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()

        def forget() -> None:
            with contextlib.suppress(Exception):  # the JVM may be gone before
                _delete(jvm, conf, path)

        atexit.register(forget)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a read of it."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillgraph_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the tables of frames that ``cut`` returned; other frames are left alone.

    Nothing that still has to be computed may read them.
    """
    for df in frames:
        path = df.__dict__.pop("_quillgraph_path", None)
        if path is not None:
            remove(df.sparkSession, path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by the Python workers of every executor (once a session)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="quillgraph-")
    path = os.path.join(folder, "quillgraph_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
