"""Tables: pandas-style operators as DataFrame transformations.

A ``Table`` holds a DataFrame and, where row order matters, the name of a column with dense
positions from 0.  Operators return new tables; order-dependent ones refuse a table without positions
unless they are told what to order by.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillgraph.functions.predicate import parse
from quillgraph.operators import local
from quillgraph.plans.ordering import running, shifted, trailing, with_position
from quillgraph.plans.staging import cut, ship_package

#: Distinct pairs of values that one task of Kendall's tau orders; more of them are dealt over blocks.
KENDALL_BLOCK = 1 << 18
#: Rows that a table may have to become a pandas frame on the driver.
DRIVER_ROWS = 1_000_000

_AGGREGATES = {
    "sum": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "nunique": F.count_distinct,
    "std": F.stddev_samp, "var": F.var_samp, "median": F.median, "first": F.first, "last": F.last, "any": F.bool_or, "all": F.bool_and,
}


def concordance(cells: DataFrame) -> DataFrame:
    """One row ``s``: sign(b2 - b) * n * n2 summed over all pairs of cells (a, b, n) with a < a2.

    Values of a and of b are cut into blocks in their order.  Pairs within a block of a are counted there, by
    sorting; other pairs within a block of b there, with blocks in place of a; and all the rest from the counts
    of the blocks.  Blocks grow with the cells, so that no task gets more than about cells ** (2 / 3) rows.
    """
    ship_package(cells.sparkSession)
    count = cells.count()
    size = max(KENDALL_BLOCK, round(count ** (2 / 3)))
    if count <= size:
        parts = cells.select(F.lit("all").alias("of"), F.lit(0).cast("long").alias("part"), "a", "b", "n")
    else:
        placed = cells
        for c, block in (("a", "i"), ("b", "j")):
            placed = placed.join(_value_blocks(cells, c, size, block), c)
        placed = cut(placed, "pairs")
        # an odd block holds one frequent value, within which nothing differs
        parts = placed.where("i % 2 = 0").select(F.lit("a").alias("of"), F.col("i").alias("part"), "a", "b", "n")
        parts = parts.unionByName(placed.where("j % 2 = 0").groupBy("i", "j", "b").agg(F.sum("n").alias("n")).select(F.lit("b").alias("of"), F.col("j").alias("part"), F.col("i").cast("double").alias("a"), "b", "n"))
        parts = parts.unionByName(placed.groupBy("i", "j").agg(F.sum("n").alias("n")).select(F.lit("blocks").alias("of"), F.lit(0).cast("long").alias("part"), F.col("i").cast("double").alias("a"), F.col("j").cast("double").alias("b"), "n"))
    return parts.groupBy("of", "part").applyInArrow(local.concordance, "s string").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))


def _value_blocks(cells: DataFrame, c: str, size: int, name: str) -> DataFrame:
    """(c, name): the block of each value, ascending; even ones have less than twice ``size`` cells, odd ones a single value."""
    counts = with_position(cells.groupBy(c).agg(F.count(F.lit(1)).alias("__n")), [F.col(c)], "__ord")
    upto = running(counts, "__ord", {"__upto": ("sum", F.col("__n"))})
    return upto.select(c, (2 * F.floor((F.col("__upto") - F.col("__n")) / size) + (F.col("__n") > size).cast("long")).alias(name))


def aggregate(name: str, c: Column | str) -> Column:
    """An aggregate by name; ``size`` counts rows, ``count`` counts values."""
    if name == "size":
        return F.count(F.lit(1))
    return _AGGREGATES[name](c)


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


@dataclass(frozen=True)
class Table:
    df: DataFrame
    ord: str | None = None

    # --- shape, columns, cells ---

    def _with(self, df: DataFrame) -> Table:
        return Table(df, self.ord if self.ord in df.columns else None)

    def _order(self) -> str:
        if self.ord is None:
            raise ValueError("this operator depends on row order: use ordered() first")
        return self.ord

    def ordered(self, *keys: str | Column, name: str = "ord") -> Table:
        """Dense positions from 0 in the order of keys (nulls first)."""
        return Table(with_position(self.df, [F.col(k).asc_nulls_first() if isinstance(k, str) else k for k in keys], name), name)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != self.ord]

    def numeric(self) -> list[str]:
        return [f.name for f in self.df.schema.fields if is_number(f.dataType) and f.name != self.ord]

    def nrows(self) -> int:
        return self.df.count()

    def ncols(self) -> int:
        return len(self.columns)

    def select(self, *names: str) -> Table:
        return self._with(self.df.select(*names, *([self.ord] if self.ord and self.ord not in names else [])))

    def drop_columns(self, *names: str) -> Table:
        return self._with(self.df.drop(*names))

    def with_column(self, name: str, value: Column) -> Table:
        return self._with(self.df.withColumn(name, value))

    def assign(self, **values: Column) -> Table:
        return self._with(self.df.withColumns(values))

    def rename(self, names: dict[str, str]) -> Table:
        return Table(self.df.withColumnsRenamed(names), names.get(self.ord, self.ord))

    def add_prefix(self, prefix: str) -> Table:
        return self.rename({c: prefix + c for c in self.columns})

    def add_suffix(self, suffix: str) -> Table:
        return self.rename({c: c + suffix for c in self.columns})

    def reorder(self, *names: str) -> Table:
        if set(names) != set(self.columns):
            raise ValueError("reorder takes every column once")
        return self.select(*names)

    def set_values(self, name: str, value, mask: Column) -> Table:
        """Cells of a column where ``mask`` holds."""
        return self.with_column(name, F.when(mask, value).otherwise(F.col(name)))

    def set_value(self, row: int, name: str, value) -> Table:
        return self.set_values(name, F.lit(value), F.col(self._order()) == row)

    def set_range(self, name: str, value, start: int, end: int, step: int = 1) -> Table:
        at = F.col(self._order())
        return self.set_values(name, F.lit(value), (at >= start) & (at < end) & ((at - start) % step == 0))

    def update_from(self, key: str, updates: DataFrame, names: list[str]) -> Table:
        """Columns overwritten where ``updates`` has a row with the key and a value."""
        new = updates.select(key, *[F.col(n).alias(f"__{n}") for n in names])
        out = self.df.join(new, key, "left").withColumns({n: F.coalesce(f"__{n}", n) if n in self.df.columns else F.col(f"__{n}") for n in names})
        return self._with(out.drop(*[f"__{n}" for n in names]))

    def append(self, rows: DataFrame) -> Table:
        """Rows at the end; columns that they lack are null."""
        return Table(self.df.drop(self.ord or "").unionByName(rows, allowMissingColumns=True))

    # --- positions ---

    def slice(self, start: int, end: int) -> Table:
        at = F.col(self._order())
        return self._with(self.df.where((at >= start) & (at < end)))

    def head(self, n: int = 5) -> Table:
        return self.slice(0, n)

    def tail(self, n: int = 5) -> Table:
        total = self.df.agg(F.max(self._order())).first()[0]
        return self.slice((-1 if total is None else total) + 1 - n, (1 << 62))

    def take_rows(self, rows: list[int]) -> Table:
        """Rows by position, in the order asked for, as often as asked for."""
        ask = self.df.sparkSession.createDataFrame(list(enumerate(rows)), "__to long, __from long")
        got = ask.join(self.df.withColumnRenamed(self._order(), "__from"), "__from").drop("__from")
        return Table(got.withColumnRenamed("__to", "ord"), "ord")

    def drop_rows(self, rows: list[int]) -> Table:
        gone = self.df.sparkSession.createDataFrame([(r,) for r in rows], f"{self._order()} long")
        return self._with(self.df.join(gone, self.ord, "left_anti"))

    # --- filters ---

    def filter(self, text: str | Column) -> Table:
        return self._with(self.df.where(parse(text, self.df.columns) if isinstance(text, str) else text))

    query = filter

    def isin(self, name: str, values: list | DataFrame) -> Table:
        if isinstance(values, DataFrame):
            return self._with(self.df.join(values.toDF(name).distinct(), name, "left_semi"))
        return self._with(self.df.where(F.col(name).isin(values)))

    def dropna(self, names: list[str] | None = None) -> Table:
        return self._with(self.df.na.drop(subset=names or self.columns))

    def fillna(self, values) -> Table:
        return self._with(self.df.na.fill(values))

    def isna(self) -> Table:
        return self._with(self.df.select(*[F.col(c).isNull().alias(c) for c in self.columns], *([self.ord] if self.ord else [])))

    def notna(self) -> Table:
        return self._with(self.df.select(*[F.col(c).isNotNull().alias(c) for c in self.columns], *([self.ord] if self.ord else [])))

    def null_counts(self) -> DataFrame:
        one = self.df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in self.columns])
        return one.unpivot([], self.columns, "column", "null_count")

    # --- joins ---

    def join(self, other: Table, on: str | list[str], how: str = "inner") -> Table:
        """Equi-join in which nulls match; keys stand once.

        Shared other columns get ``left_``/``right_`` in front for inner, left and right joins, and
        ``_right`` at the end of the right one for outer joins.  A right join has the right columns first.
        """
        on = [on] if isinstance(on, str) else list(on)
        if how == "right":
            return Table(self._equi(other, on, "right", right_first=True))
        if how in ("semi", "anti"):
            return self._with(self.df.join(other.df, reduce(lambda a, b: a & b, [self.df[k].eqNullSafe(other.df[k]) for k in on]), f"left_{how}"))
        return Table(self._equi(other, on, how))

    def _equi(self, other: Table, on: list[str], how: str, right_first: bool = False) -> DataFrame:
        clash = {c for c in self.columns if c in other.columns} - set(on)
        left = self.df.select(*[F.col(c).alias(f"__l_{c}") for c in self.columns])
        right = other.df.select(*[F.col(c).alias(f"__r_{c}") for c in other.columns])
        cond = reduce(lambda a, b: a & b, [left[f"__l_{k}"].eqNullSafe(right[f"__r_{k}"]) for k in on])
        both = left.join(right, cond, "full" if how == "outer" else how)
        pick = {"outer": lambda k: F.coalesce(f"__l_{k}", f"__r_{k}"), "right": lambda k: F.col(f"__r_{k}")}
        keys = [pick.get(how, lambda k: F.col(f"__l_{k}"))(k).alias(k) for k in on]
        name = (lambda c, side: f"{c}_right" if c in clash and side == "right" else c) if how == "outer" else (lambda c, side: f"{side}_{c}" if c in clash else c)
        mine = [F.col(f"__l_{c}").alias(name(c, "left")) for c in self.columns if c not in on]
        theirs = [F.col(f"__r_{c}").alias(name(c, "right")) for c in other.columns if c not in on]
        return both.select(*keys, *(theirs + mine if right_first else mine + theirs))

    def asof_join(self, other: Table, on: str, by: list[str] = (), direction: str = "backward", strict: bool = False) -> Table:
        """Each row with the last row of ``other`` at or before it in ``on`` (forward: the first at or after).

        Rows meet under equal ``by`` (nulls match); of several rows of ``other`` at one time the greatest by
        its columns counts.  ``strict`` leaves equal times out.  Columns of ``other`` that this table has too
        get ``_right``; no match gives nulls.  Both tables pass through one sort a group, without pairs;
        without ``by`` all rows are one group.
        """
        theirs = [c for c in other.columns if c != on and c not in by]
        mine = self.df.select(F.struct(*self.df.columns).alias("__l"), F.lit(None).cast(other.df.select(F.struct(on, *theirs).alias("r")).schema["r"].dataType).alias("__r"), F.col(on).alias("__t"), *[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)])
        found = other.df.select(F.lit(None).cast(mine.schema["__l"].dataType).alias("__l"), F.struct(on, *theirs).alias("__r"), F.col(on).alias("__t"), *[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)])
        back = direction == "backward"
        # at one time: the other table's rows stand first, or last if equal times are left out
        side = F.when(F.col("__l").isNull(), 1 if strict else 0).otherwise(0 if strict else 1)
        w = Window.partitionBy(*[f"__b{i}" for i in range(len(by))]).orderBy(F.asc("__t") if back else F.desc("__t"), side, F.asc("__r")).rowsBetween(Window.unboundedPreceding, 0)
        both = mine.unionByName(found).where("__t IS NOT NULL OR __l IS NOT NULL").withColumn("__m", F.last("__r", True).over(w)).where("__l IS NOT NULL")
        return self._with(both.select("__l.*", *[F.when(F.col("__t").isNotNull(), F.col(f"__m.{c}")).alias(c + "_right" if c in self.columns else c) for c in theirs]))

    def to_pandas(self):
        """The rows as a pandas frame, in order where there is one; more than ``DRIVER_ROWS`` are refused."""
        if self.df.limit(DRIVER_ROWS + 1).count() > DRIVER_ROWS:
            raise ValueError(f"the driver takes tables of up to {DRIVER_ROWS} rows")
        return (self.df.orderBy(self.ord).drop(self.ord) if self.ord else self.df).toPandas()

    def to_parquet(self, path: str) -> None:
        self.df.write.mode("overwrite").parquet(path)

    @classmethod
    def from_parquet(cls, spark, path: str, ord: str | None = None) -> Table:
        return cls(spark.read.parquet(path), ord)

    def reverse(self) -> Table:
        """Positions the other way round."""
        last = self.df.agg(F.max(self._order())).first()[0] or 0
        return self.with_column(self.ord, F.lit(last) - F.col(self.ord))

    def cross_join(self, other: Table) -> Table:
        right = other.df.select(*[F.col(c).alias(c + "_right" if c in self.columns else c) for c in other.columns])
        return Table(self.df.drop(self.ord or "").crossJoin(right))

    def concat(self, other: Table) -> Table:
        """Side by side by position; the shorter one is filled with nulls."""
        right = other.df.select(*[F.col(c).alias(c + "_y" if c in self.columns else c) for c in other.columns], F.col(other._order()).alias(self._order()))
        return self._with(self.df.join(right, self.ord, "full"))

    # --- groups ---

    def groupby(self, *keys: str) -> Groups:
        return Groups(self, list(keys))

    def aggregate(self, what: dict[str, str]) -> DataFrame:
        return self.df.agg(*[aggregate(f, c).alias(c) for c, f in what.items()])

    def pivot_table(self, index: list[str], column: str, value: str, how: str = "sum", values: list | None = None) -> Table:
        """One column ``<column>_<value>`` for each value (given, or found with one distinct query)."""
        if values is None:
            values = [r[0] for r in self.df.select(column).distinct().orderBy(column).collect()]
        out = self.df.groupBy(*index).pivot(column, values).agg(aggregate(how, value))
        return Table(out.withColumnsRenamed({("null" if v is None else str(v)): f"{column}_{v}" for v in values}))

    def melt(self, ids: list[str], values: list[str], var: str = "variable", value: str = "value") -> Table:
        return Table(self.df.unpivot(ids, values, var, value))

    def value_counts(self, name: str, sort: bool = True, ascending: bool = False, dropna: bool = True) -> DataFrame:
        rows = self.df.where(F.col(name).isNotNull()) if dropna else self.df
        out = rows.groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("count"))
        return out.orderBy(F.asc("count") if ascending else F.desc("count"), "value") if sort else out

    def describe(self) -> DataFrame:
        """One row a numeric column: count, mean, std (population), min, quartiles, max."""
        stats = [F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).cast("double").alias("min"), *[F.percentile(c, q).alias(n) for q, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))], F.max(c).cast("double").alias("max")) for c in self.numeric()]
        return self.df.agg(*[s.alias(f"s{i}") for i, s in enumerate(stats)]).select(F.explode(F.array(*[f"s{i}" for i in range(len(stats))])).alias("s")).select("s.*")

    def profile(self) -> DataFrame:
        """One row a column: type, rows, nulls, distinct values, cardinality ratio."""
        n = F.count(F.lit(1))
        stats = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), n.alias("rows"), F.count_if(F.col(f.name).isNull()).alias("nulls"), F.count_distinct(F.col(f.name).cast("string")).alias("unique")) for f in self.df.schema.fields if f.name != self.ord]
        out = self.df.agg(*[s.alias(f"s{i}") for i, s in enumerate(stats)]).select(F.explode(F.array(*[f"s{i}" for i in range(len(stats))])).alias("s")).select("s.*")
        return out.withColumn("cardinality", F.when(F.col("rows") > F.col("nulls"), F.col("unique") / (F.col("rows") - F.col("nulls"))))

    def validate_schema(self, expected: dict[str, str]) -> DataFrame:
        own = dict(self.df.dtypes)
        rows = [(c, t, own.get(c), own.get(c) == t) for c, t in expected.items()]
        return self.df.sparkSession.createDataFrame(rows, "column string, expected string, actual string, ok boolean")

    def outliers(self, name: str, factor: float = 1.5) -> Table:
        """Rows with ``is_outlier``; quartiles are the values at floor(q * n) of the sorted column."""
        n = self.df.agg(F.count(name)).first()[0]
        q1, q3 = (self.nth(name, int(q * n)) if n else 0.0 for q in (0.25, 0.75))
        low, high = q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)
        return self.with_column("is_outlier", F.coalesce((F.col(name) < low) | (F.col(name) > high), F.lit(False)))

    def nth(self, name: str, k: int):
        """The value at position k of the sorted non-null column, found from counts of its values."""
        counts = self.df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        placed = with_position(counts, [F.asc("v")], "pos")
        summed = running(placed, "pos", {"upto": ("sum", F.col("n"))})
        return summed.where(F.col("upto") > k).agg(F.min("v")).first()[0]

    def quantile(self, name: str, q: float, how: str = "linear"):
        """Exact quantile: linear, lower, higher, midpoint or nearest."""
        if how == "linear":
            return self.df.agg(F.percentile(name, q)).first()[0]
        n = self.df.agg(F.count(name)).first()[0]
        if not n:
            return None
        at = q * (n - 1)
        low, high = int(at), min(int(at) + (at > int(at)), n - 1)
        a = self.nth(name, low)
        b = a if high == low else self.nth(name, high)
        return {"lower": a, "higher": b, "midpoint": (a + b) / 2, "nearest": a if at - low <= 0.5 else b}[how]

    def corr(self, a: str, b: str, method: str = "pearson") -> DataFrame:
        """One row ``corr`` over rows where both are there: pearson, spearman or kendall (tau-a)."""
        rows = self.df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
        if method == "pearson":
            return rows.agg(F.corr("a", "b").alias("corr"))
        if method == "spearman":
            # ranks come from counts of values, and only distinct pairs meet them: no row is sorted or joined
            cells = cut(rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "pairs")
            ranked = cells
            for c in ("a", "b"):
                ranked = ranked.join(value_ranks(cells.groupBy(c).agg(F.sum("n").alias("__n")), c, f"r{c}"), c)
            x, y, n = F.col("ra"), F.col("rb"), F.col("n")
            sums = ranked.agg(F.sum(n).alias("t"), F.sum(n * x).alias("x"), F.sum(n * y).alias("y"), F.sum(n * x * y).alias("xy"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"))
            spread = lambda c: F.col("t") * F.col(c + c) - F.col(c) * F.col(c)
            return sums.select(F.try_divide(F.col("t") * F.col("xy") - F.col("x") * F.col("y"), F.sqrt(spread("x")) * F.sqrt(spread("y"))).alias("corr"))
        # tau from the counts of distinct pairs of values
        cells = cut(rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "pairs")
        total = cells.agg(F.sum("n").cast("double").alias("t"), (F.min("a") < F.max("a")).alias("differ"))
        tau = F.try_divide(F.coalesce("s", F.lit(0)).cast("double"), F.col("t") * (F.col("t") - 1) / 2)
        # a value that is no number is neither more nor less than others; without two values of a there is no pair
        return concordance(cells.where(~F.isnan("b"))).crossJoin(F.broadcast(total)).select(F.when(F.col("differ"), tau).alias("corr"))

    def corr_matrix(self) -> DataFrame:
        """Pearson matrix over numeric columns with an ``index`` column."""
        return self._matrix(lambda a, b: F.corr(F.col(a).cast("double"), F.col(b).cast("double")))

    def cov_matrix(self, ddof: int = 1) -> DataFrame:
        f = F.covar_samp if ddof else F.covar_pop
        return self._matrix(lambda a, b: f(F.col(a).cast("double"), F.col(b).cast("double")))

    def _matrix(self, f: Callable[[str, str], Column]) -> DataFrame:
        names = self.numeric()
        one = self.df.agg(*[f(a, b).alias(f"m_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)])
        rows = F.array(*[F.struct(F.lit(a).alias("index"), *[F.col(f"m_{i}_{j}").alias(b) for j, b in enumerate(names)]) for i, a in enumerate(names)])
        return one.select(F.explode(rows).alias("r")).select("r.*")

    # --- windows by position ---

    def rolling(self, name: str, window: int, op: str, out: str | None = None, by: list[str] = ()) -> Table:
        """Trailing mean, sum, min, max or std (population); null until the window is full."""
        f = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_pop}[op]
        return self._with(trailing(self.df, self._order(), window, {out or f"{name}_rolling_{window}_{op}": lambda w: f(name).over(w)}, list(by)))

    def rolling_all(self, window: int, op: str, by: list[str] = ()) -> Table:
        out = self
        for c in [c for c in self.numeric() if c not in by]:
            out = out.rolling(c, window, op, by=by)
        return out

    def expanding(self, name: str, op: str, out: str | None = None, by: list[str] = ()) -> Table:
        """From the first row on: mean, sum, min, max or std (population)."""
        out = out or f"{name}_expanding_{op}"
        c = F.col(name).cast("double")
        if op in ("sum", "min", "max"):
            return self._with(running(self.df, self._order(), {out: (op, F.col(name))}, list(by)))
        parts = running(self.df, self._order(), {"__n": ("count", c), "__s": ("sum", c), "__q": ("sum", c * c)}, list(by))
        mean = F.col("__s") / F.col("__n")
        value = mean if op == "mean" else F.sqrt(F.greatest(F.col("__q") / F.col("__n") - mean * mean, F.lit(0.0)))
        return self._with(parts.withColumn(out, F.when(F.col("__n") > 0, value)).drop("__n", "__s", "__q"))

    def expanding_all(self, op: str, by: list[str] = ()) -> Table:
        out = self
        for c in [c for c in self.numeric() if c not in by]:
            out = out.expanding(c, op, by=by)
        return out

    def cumsum(self, name: str, out: str, by: list[str] = ()) -> Table:
        """Running sum that repeats on nulls and is 0 before the first number."""
        done = running(self.df, self._order(), {out: ("sum", F.col(name))}, list(by))
        return self._with(done.withColumn(out, F.coalesce(out, F.lit(0))))

    def cummin(self, name: str, out: str, by: list[str] = ()) -> Table:
        return self._with(running(self.df, self._order(), {out: ("min", F.col(name))}, list(by)))

    def cummax(self, name: str, out: str, by: list[str] = ()) -> Table:
        return self._with(running(self.df, self._order(), {out: ("max", F.col(name))}, list(by)))

    def shift(self, name: str, periods: int, out: str, by: list[str] = (), fill=None) -> Table:
        return self._with(shifted(self.df, self._order(), {out: (F.col(name), periods)}, list(by), fill))

    def pct_change(self, name: str, out: str, periods: int = 1, by: list[str] = ()) -> Table:
        """(x - before) / before; null where before is missing or 0."""
        done = shifted(self.df, self._order(), {"__b": (F.col(name), periods)}, list(by))
        return self._with(done.withColumn(out, F.when(F.col("__b") != 0, F.try_divide(F.col(name) - F.col("__b"), F.col("__b")))).drop("__b"))

    # --- sorting, top-k, samples, sets ---

    def sort_values(self, *keys: str, ascending: list[bool] | bool = True) -> DataFrame:
        """Nulls first ascending, last descending; ties by position where there is one."""
        up = [ascending] * len(keys) if isinstance(ascending, bool) else ascending
        return self.df.orderBy(*[F.col(k).asc_nulls_first() if a else F.col(k).desc_nulls_last() for k, a in zip(keys, up, strict=True)], *([self.ord] if self.ord else []))

    def nlargest(self, n: int, name: str, *ties: str) -> DataFrame:
        return self.df.where(F.col(name).isNotNull()).orderBy(F.desc(name), *ties).limit(n)

    def nsmallest(self, n: int, name: str, *ties: str) -> DataFrame:
        return self.df.where(F.col(name).isNotNull()).orderBy(F.asc(name), *ties).limit(n)

    def sample(self, n: int | None = None, fraction: float | None = None, weight: str | None = None, replace: bool = False, seed: int = 0) -> Table:
        """A random sample; ``weight`` draws rows in proportion to it.

        Exact n without replacement orders by exponential keys -ln(u)/w and takes the least n.
        """
        if n is None and weight is None:
            return self._with(self.df.sample(replace, float(fraction), seed))
        if n is None:
            n = round(fraction * self.df.count())
        if not replace:
            key = -F.log(1.0 - F.rand(seed)) / (F.col(weight) if weight else F.lit(1.0))
            rows = self.df.where(F.col(weight) > 0) if weight else self.df
            return self._with(rows.orderBy(key).limit(n))
        w = F.col(weight) if weight else F.lit(1.0)
        placed = self if self.ord else Table(with_position(self.df, [F.xxhash64(*self.df.columns)], "__pos"), "__pos")
        ends = running(placed.df.withColumn("__w", w.cast("double")), placed.ord, {"__end": ("sum", F.col("__w"))}).where("__w > 0")
        total = ends.agg(F.max("__end")).first()[0] or 0.0
        # a draw falls into the bucket of its share; each bucket holds the rows that reach into it
        buckets = max(1, n)
        share = lambda c: F.least(F.floor(c / total * buckets), F.lit(buckets - 1)).cast("long")
        draws = self.df.sparkSession.range(n).select((F.rand(seed) * total).alias("__u")).withColumn("__b", share(F.col("__u")))
        reach = ends.withColumn("__b", F.explode(F.sequence(share(F.col("__end") - F.col("__w")), share(F.col("__end")))))
        got = draws.join(reach, "__b").where((F.col("__u") < F.col("__end")) & (F.col("__u") >= F.col("__end") - F.col("__w")))
        return self._with(got.drop("__b", "__u", "__w", "__end", "__pos"))

    def drop_duplicates(self, subset: list[str] | None = None) -> Table:
        """The first row (by position, where there is one) of each combination."""
        subset = subset or self.columns
        if self.ord is None:
            return self._with(self.df.dropDuplicates(subset))
        rest = [c for c in self.df.columns if c not in subset]
        picked = self.df.groupBy(*subset).agg(F.min_by(F.struct(*rest), self.ord).alias("__r")) if rest else self.df.distinct()
        return self._with(picked.select(*subset, "__r.*").select(*self.df.columns) if rest else picked)

    def union(self, other: Table) -> Table:
        return Table(self.df.select(*self.columns).unionByName(other.df.select(*self.columns)).distinct())

    def stack(self, other: Table) -> Table:
        return Table(self.df.select(*self.columns).unionByName(other.df.select(*self.columns)))

    def intersect(self, other: Table) -> Table:
        return Table(self.df.select(*self.columns).intersect(other.df.select(*self.columns)))

    def subtract(self, other: Table) -> Table:
        return Table(self.df.select(*self.columns).subtract(other.df.select(*self.columns)))

    # --- functions of the caller ---

    def apply_to_columns(self, f: Callable[[Column], Column], names: list[str] | None = None) -> Table:
        return self._with(self.df.withColumns({c: f(F.col(c)) for c in names or self.columns}))

    def apply_to_rows(self, f: Callable, out: str, kind: str) -> Table:
        """``f`` gets a pandas frame of all columns and returns a series; batches travel through Arrow."""
        import pandas as pd

        udf = F.pandas_udf(lambda rows: pd.Series(f(rows)), kind)
        return self.with_column(out, udf(F.struct(*self.columns)))

    def filter_rows(self, f: Callable) -> Table:
        import pandas as pd

        udf = F.pandas_udf(lambda rows: pd.Series(f(rows)), "boolean")
        return self._with(self.df.where(udf(F.struct(*self.columns))))


def value_ranks(counts: DataFrame, name: str, out: str) -> DataFrame:
    """Average ranks of ties from 1, from how often (``__n``) each value occurs."""
    placed = running(with_position(counts, [F.asc(name)], "__p"), "__p", {"__upto": ("sum", F.col("__n"))})
    return placed.select(name, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(out))


def rank_values(df: DataFrame, name: str, out: str) -> DataFrame:
    """Rows with the average rank of their value, from 1 (no global sort of the rows)."""
    return df.join(value_ranks(df.groupBy(name).agg(F.count(F.lit(1)).alias("__n")), name, out), name)


@dataclass(frozen=True)
class Groups:
    """Rows grouped by keys; a null key is a group of its own."""

    table: Table
    keys: list[str]

    @property
    def df(self) -> DataFrame:
        return self.table.df

    def _rest(self) -> list[str]:
        return [c for c in self.table.numeric() if c not in self.keys]

    def agg(self, what: dict[str, str | list[str]]) -> DataFrame:
        """{column: function(s)}; one function keeps the column's name, several add theirs."""
        made = [aggregate(f, c).alias(c if isinstance(fs, str) else f"{c}_{f}") for c, fs in what.items() for f in ([fs] if isinstance(fs, str) else fs)]
        return self.df.groupBy(*self.keys).agg(*made)

    def _all(self, f: str) -> DataFrame:
        return self.agg(dict.fromkeys(self._rest(), f))

    def sum(self) -> DataFrame:
        return self._all("sum")

    def mean(self) -> DataFrame:
        return self._all("mean")

    def max(self) -> DataFrame:
        return self._all("max")

    def min(self) -> DataFrame:
        return self._all("min")

    def count(self) -> DataFrame:
        return self.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("count"))

    def all(self) -> DataFrame:
        names = [f.name for f in self.df.schema.fields if isinstance(f.dataType, T.BooleanType)]
        return self.df.groupBy(*self.keys).agg(*[F.bool_and(c).alias(c) for c in names])

    def describe(self) -> DataFrame:
        stats = [F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")) for c in self._rest()]
        out = self.df.groupBy(*self.keys).agg(F.array(*stats).alias("s"))
        return out.select(*self.keys, F.explode("s").alias("s")).select(*self.keys, "s.*")

    def filter(self, condition: str | Column, **made: Column) -> DataFrame:
        """Rows of the groups whose aggregates ``made`` meet the condition."""
        kept = self.df.groupBy(*self.keys).agg(*[c.alias(n) for n, c in made.items()]).where(condition).select(*[F.col(k).alias(f"__{k}") for k in self.keys])
        cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys])
        return self.df.join(kept, cond, "left_semi")

    def map(self, f: Callable, schema: str) -> DataFrame:
        """``f`` turns each group, as a pandas frame, into another (groups must fit one task)."""
        return self.df.groupBy(*self.keys).applyInPandas(f, schema)

    def _ranked(self) -> DataFrame:
        keys = self.df.select(*self.keys).distinct()
        return with_position(keys, [F.col(k).asc_nulls_first() for k in self.keys], "__g")

    def take(self, n: int, skip: int = 0) -> DataFrame:
        """Rows of n groups in key order, after ``skip`` of them."""
        picked = self._ranked().where((F.col("__g") >= skip) & (F.col("__g") < skip + n)).select(*[F.col(k).alias(f"__{k}") for k in self.keys])
        return self.df.join(picked, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys]), "left_semi")

    def sample(self, n: int, seed: int = 0) -> DataFrame:
        """Rows of n random groups."""
        picked = self.df.select(*self.keys).distinct().orderBy(F.rand(seed)).limit(n).select(*[F.col(k).alias(f"__{k}") for k in self.keys])
        return self.df.join(picked, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys]), "left_semi")

    def join(self, other: Groups, on: list[str], how: str = "inner") -> DataFrame:
        """Groups with equal keys joined on further columns."""
        return self.table.join(other.table, [*self.keys, *on], how).df

    def shape(self) -> DataFrame:
        """One row: groups, rows, columns."""
        return self.count().agg(F.count(F.lit(1)).alias("groups"), F.sum("count").alias("rows"), F.lit(len(self.table.columns)).alias("cols"))
