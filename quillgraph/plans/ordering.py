"""Global row positions, running totals and trailing windows without a single-task sort.

Rows are range-partitioned by their keys; positions come from a local row number and one offset for
each range.  Running totals and trailing windows then work on blocks of consecutive positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.plans.staging import cut

#: Rows of a block of consecutive positions.
BLOCK = 1 << 18


def with_position(df: DataFrame, keys: list[Column], name: str = "ord") -> DataFrame:
    """``df`` with its row number from 0 in the order of ``keys`` (ties in any, but a stable, order)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id()), "ordered")
    sizes = ranged.groupBy("__part").count()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*keys)) - 1
    placed = ranged.withColumn("__local", local).join(F.broadcast(starts), "__part")
    return placed.withColumn(name, (F.col("__start") + F.col("__local")).cast("long")).drop("__part", "__local", "__start")


def running(df: DataFrame, ord_col: str, values: dict[str, tuple[str, Column]], partition: list[str] = ()) -> DataFrame:
    """Columns with running aggregates: name -> (sum | min | max | count, column).

    With partition columns this is an ordinary window; without, blocks of positions are totalled first
    and each block continues from the total of those before it.
    """
    fold = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    if partition:
        w = Window.partitionBy(*partition).orderBy(ord_col).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: fold[op](c).over(w) for name, (op, c) in values.items()})
    blocked = df.withColumn("__block", F.floor(F.col(ord_col) / BLOCK))
    totals = blocked.groupBy("__block").agg(*[fold[op](c).alias(f"__t_{name}") for name, (op, c) in values.items()])
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    again = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.sum}
    carried = totals.select("__block", *[again[op](f"__t_{name}").over(before).alias(f"__c_{name}") for name, (op, _) in values.items()])
    w = Window.partitionBy("__block").orderBy(ord_col).rowsBetween(Window.unboundedPreceding, 0)
    out = blocked.join(F.broadcast(carried), "__block")
    made = {}
    for name, (op, c) in values.items():
        own, old = fold[op](c).over(w), F.col(f"__c_{name}")
        if op in ("sum", "count"):
            made[name] = F.when(own.isNull(), old).otherwise(own + F.coalesce(old, F.lit(0)))
        else:
            made[name] = (F.least if op == "min" else F.greatest)(own, old)
    return out.withColumns(made).drop("__block", *[f"__c_{name}" for name in values])


def trailing(df: DataFrame, ord_col: str, window: int, made: dict[str, "callable"], partition: list[str] = ()) -> DataFrame:
    """Columns over the last ``window`` rows (the row itself included), null before there are as many.

    made: name -> function from a window spec to a column.
    """
    full = lambda keys: Window.partitionBy(*keys).orderBy(ord_col).rowsBetween(-(window - 1), 0)
    seen = lambda keys: F.count(F.lit(1)).over(full(keys)) >= window
    if partition:
        return df.withColumns({n: F.when(seen(partition), f(full(partition))) for n, f in made.items()})
    size = max(BLOCK, window)
    at = F.floor(F.col(ord_col) / size)
    # the last rows of a block also stand before the next one
    homes = F.when(F.col(ord_col) % size >= size - (window - 1), F.array(at, at + 1)).otherwise(F.array(at))
    spread = df.withColumn("__home", F.explode(homes))
    out = spread.withColumns({n: F.when(seen(["__home"]), f(full(["__home"]))) for n, f in made.items()})
    return out.where(F.col("__home") == at).drop("__home")


def shifted(df: DataFrame, ord_col: str, made: dict[str, tuple[Column, int]], partition: list[str] = (), fill=None) -> DataFrame:
    """Columns holding the value ``periods`` rows before (after, if negative): name -> (column, periods)."""
    if partition:
        w = Window.partitionBy(*partition).orderBy(ord_col)
        lagged = lambda c, p: F.lag(c, p, fill).over(w) if p >= 0 else F.lead(c, -p, fill).over(w)
        return df.withColumns({n: lagged(c, p) for n, (c, p) in made.items()})
    out = df
    for n, (c, p) in made.items():
        # positions are dense, so that a shift is a join by position
        other = df.select((F.col(ord_col) + p).alias(ord_col), c.alias(n), F.lit(True).alias("__hit"))
        out = out.join(other, ord_col, "left")
        if fill is not None:
            out = out.withColumn(n, F.when(F.col("__hit"), F.col(n)).otherwise(F.lit(fill)))
        out = out.drop("__hit")
    return out
