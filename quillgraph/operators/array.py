"""Arrays: a frame (ord, value) with dense positions from 0.

Arithmetic and masks pair elements by position; statistics are one-row frames or driver numbers.  A boolean
array is an array of booleans, in which a null counts as neither true nor false.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.table import Table, aggregate
from quillgraph.plans.ordering import with_position

_FOLDS = {"sum": F.sum, "product": F.product, "min": F.min, "max": F.max, "and": F.bool_and, "or": F.bool_or}


@dataclass(frozen=True)
class Array:
    df: DataFrame

    # --- constructors ---

    @classmethod
    def of(cls, spark: SparkSession, values: Sequence, kind: str) -> Array:
        return cls(spark.createDataFrame(list(enumerate(values)), f"ord long, value {kind}"))

    @classmethod
    def from_column(cls, df: DataFrame, value: str | Column, *keys: str) -> Array:
        """A column in the order of keys."""
        c = F.col(value) if isinstance(value, str) else value
        return cls(with_position(df.select(*keys, c.alias("value")), [F.col(k).asc_nulls_first() for k in keys], "ord").select("ord", "value"))

    @classmethod
    def filled(cls, spark: SparkSession, n: int, value) -> Array:
        return cls(spark.range(n).select(F.col("id").alias("ord"), F.lit(value).alias("value")))

    @classmethod
    def ones_bool(cls, spark: SparkSession, n: int) -> Array:
        return cls.filled(spark, n, True)

    @classmethod
    def zeros_bool(cls, spark: SparkSession, n: int) -> Array:
        return cls.filled(spark, n, False)

    @classmethod
    def bools(cls, spark: SparkSession, values: Sequence) -> Array:
        return cls.of(spark, values, "boolean")

    @classmethod
    def ints(cls, spark: SparkSession, values: Sequence) -> Array:
        return cls.of(spark, values, "long")

    # --- elements ---

    def __len__(self) -> int:
        return self.df.count()

    def get(self, i: int):
        r = self.df.where(F.col("ord") == i).first()
        if r is None:
            raise IndexError(i)
        return r["value"]

    def first(self):
        return self.get(0)

    def last(self):
        return self.get(self.df.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0])

    def set(self, i: int, value) -> Array:
        return self.map(lambda c: F.when(F.col("ord") == i, F.lit(value)).otherwise(c))

    def slice(self, start: int, end: int) -> Array:
        return Array(self.df.where((F.col("ord") >= start) & (F.col("ord") < end)).withColumn("ord", F.col("ord") - start))

    def head(self, n: int = 5) -> Array:
        return self.slice(0, n)

    def tail(self, n: int = 5) -> Array:
        size = len(self)
        return self.slice(max(0, size - n), size)

    def append(self, values: Sequence) -> Array:
        more = Array.of(self.df.sparkSession, values, self.df.schema["value"].dataType.simpleString())
        return self.concat(more)

    def concat(self, other: Array) -> Array:
        return Array(self.df.unionByName(other.df.withColumn("ord", F.col("ord") + len(self))))

    def reverse(self) -> Array:
        last = self.df.agg(F.coalesce(F.max("ord"), F.lit(0))).first()[0]
        return Array(self.df.withColumn("ord", F.lit(last) - F.col("ord")))

    def sample(self, n: int, seed: int = 0) -> Array:
        """n elements by a seeded hash of their position, in order."""
        return self._renumbered(self.df.orderBy(F.xxhash64("ord", F.lit(seed)), "ord").limit(n))

    @staticmethod
    def _renumbered(df: DataFrame) -> Array:
        return Array(with_position(df.withColumnRenamed("ord", "__o"), [F.asc("__o")], "ord").select("ord", "value"))

    # --- functions of elements ---

    def map(self, f: Callable[[Column], Column]) -> Array:
        return Array(self.df.withColumn("value", f(F.col("value"))))

    def filter(self, f: Callable[[Column], Column]) -> Array:
        return self._renumbered(self.df.where(f(F.col("value"))))

    def apply_mask(self, mask: Array) -> Array:
        """The elements where a boolean array is true."""
        keep = mask.df.where("value").select("ord")
        return self._renumbered(self.df.join(keep, "ord", "left_semi"))

    def isna(self) -> Array:
        return self.map(lambda c: c.isNull())

    def notna(self) -> Array:
        return self.map(lambda c: c.isNotNull())

    def dropna(self) -> Array:
        return self.filter(lambda c: c.isNotNull())

    def fillna(self, value) -> Array:
        return self.map(lambda c: F.coalesce(c, F.lit(value)))

    def isin(self, values: Sequence) -> Array:
        return self.map(lambda c: c.isin(list(values)))

    def unique(self) -> Array:
        """Distinct values in order of their first place."""
        return self._renumbered(self.df.groupBy("value").agg(F.min("ord").alias("ord")).select("ord", "value"))

    def _with(self, other, f: Callable[[Column, Column], Column]) -> Array:
        if isinstance(other, Array):
            both = self.df.join(other.df.withColumnRenamed("value", "__v"), "ord")
            return Array(both.select("ord", f(F.col("value"), F.col("__v")).alias("value")))
        return self.map(lambda c: f(c, F.lit(other)))

    def add(self, other) -> Array:
        """By position with another array, or a number to each element."""
        return self._with(other, lambda a, b: a + b)

    def subtract(self, other) -> Array:
        return self._with(other, lambda a, b: a - b)

    def multiply(self, other) -> Array:
        return self._with(other, lambda a, b: a * b)

    def divide(self, other) -> Array:
        return self._with(other, lambda a, b: F.try_divide(a, b))

    def logical_and(self, other) -> Array:
        return self._with(other, lambda a, b: a & b)

    def logical_or(self, other) -> Array:
        return self._with(other, lambda a, b: a | b)

    def logical_not(self) -> Array:
        return self.map(lambda c: ~c)

    # --- statistics ---

    def reduce(self, how: str):
        """sum, product, min, max, and, or of the elements that are there; None of none."""
        return self.df.agg(_FOLDS[how]("value")).first()[0]

    def agg(self, *names: str) -> DataFrame:
        """One row of named statistics."""
        return self.df.agg(*[aggregate(n, "value").alias(n) for n in names])

    def truth(self) -> DataFrame:
        """One row of a boolean array: count_true, count_false, any, all, percentage of true elements.

        Of an empty array ``all`` is true, ``any`` false and the percentage 0.
        """
        yes, no = F.count_if(F.col("value")), F.count_if(~F.col("value"))
        n = F.count(F.lit(1))
        return self.df.agg(yes.alias("count_true"), no.alias("count_false"), (yes > 0).alias("any"), (yes == n).alias("all"), F.when(n > 0, 100.0 * yes / n).otherwise(0.0).alias("percentage"))

    def any(self) -> bool:
        return self.truth().first()["any"]

    def all(self) -> bool:
        return self.truth().first()["all"]

    def nonzero(self) -> Array:
        """Positions of elements that are true, or not 0."""
        return self._positions(F.col("value").cast("double") != 0)

    def false_indices(self) -> Array:
        return self._positions(~F.col("value").cast("boolean"))

    def _positions(self, where: Column) -> Array:
        return self._renumbered(self.df.where(where).select("ord", F.col("ord").alias("value")))

    def memory(self) -> DataFrame:
        """One row: elements, nulls, and bytes that the values take in storage rows (text by its length)."""
        kind = self.df.schema["value"].dataType.simpleString()
        width = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}.get(kind, 8)
        size = F.sum(F.octet_length("value")) if kind in ("string", "binary") else F.count("value") * width
        return self.df.agg(F.count(F.lit(1)).alias("elements"), F.count_if(F.col("value").isNull()).alias("nulls"), F.coalesce(size, F.lit(0)).cast("long").alias("bytes"))

    # --- as tables and graph ids ---

    def to_table(self, name: str = "value", prefix: str = "", suffix: str = "") -> Table:
        return Table(self.df.select("ord", F.col("value").alias(f"{prefix}{name}{suffix}")), "ord")

    def as_node_ids(self) -> DataFrame:
        """(node_id) of the elements, once each."""
        return self.df.where("value IS NOT NULL").select(F.col("value").cast("long").alias("node_id")).distinct()

    @classmethod
    def from_node_ids(cls, ids: DataFrame) -> Array:
        """Ids (one column) in ascending order."""
        return cls.from_column(ids.toDF("node_id"), "node_id", "node_id")


def interleave(arrays: dict[str, Array]) -> DataFrame:
    """(name, ord, value) of several arrays."""
    out = None
    for name, a in arrays.items():
        part = a.df.select(F.lit(name).alias("name"), "ord", "value")
        out = part if out is None else out.unionByName(part)
    return out


def aggregate_each(rows: DataFrame, *names: str, key: str = "name") -> DataFrame:
    """Named statistics of each of several arrays (key, ord, value)."""
    return rows.groupBy(key).agg(*[aggregate(n, "value").alias(n) for n in names])

