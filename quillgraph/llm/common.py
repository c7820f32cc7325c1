"""Small helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.plans.staging import ship_package

#: Rows that a kernel takes at once; bounds a worker's memory whatever the Arrow batch holds.
ROWS_AT_ONCE = 1000
#: UTF-8 bytes that a kernel takes at once (one longer text is taken alone).
BYTES_AT_ONCE = 4 << 20


def crc_fold(doc_id: str, mod: int) -> Column:
    """``crc32(doc_id as text) mod n``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


def pieces(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of at most ROWS_AT_ONCE rows and about BYTES_AT_ONCE bytes of text."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(size):
        if i > start and (held + n > BYTES_AT_ONCE or i - start >= ROWS_AT_ONCE):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def map_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text") -> DataFrame:
    """Apply ``kernel`` to bounded slices of every partition."""
    ship_package(df.sparkSession)

    def run(batches):
        for b in batches:
            for p in pieces(b, text):
                yield kernel(p)

    return df.mapInArrow(run, schema)


def planes(a: np.ndarray) -> bytes:
    """Byte planes of an array, compressed: equal high bytes stand together."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 1)


def unplanes(b: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(width, -1).T).view(kind).ravel()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    return [b or b"" for b in batch.column(name).cast(pa.binary()).to_pylist()]


def append_columns(df: DataFrame, kernel: Callable[[pa.RecordBatch], list[pa.Array]], new: list[tuple[str, str]], text: str = "text") -> tuple[DataFrame, list[str]]:
    """All columns of ``df`` and what ``kernel`` makes of them; names in use get a ``_`` in front.

    Returns the frame and the names that the new columns have.
    """
    taken, names = {c.lower() for c in df.columns}, []
    for name, _ in new:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        names.append(name)
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    schema = ", ".join([*own, *(f"`{n}` {kind}" for n, (_, kind) in zip(names, new, strict=True))])

    def whole(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, *kernel(b)], [*b.schema.names, *names])

    return map_batches(df, whole, schema, text), names
