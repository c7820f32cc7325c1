"""Matrices as cells: a frame (i, j, v) of non-zero values and a shape.

Element-wise functions that don't map 0 to 0 densify first.  Decompositions run in NumPy on the driver,
behind a check of the number of cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cells of a matrix that a driver kernel takes.
KERNEL_CELLS = 4_000_000


@dataclass(frozen=True)
class Matrix:
    cells: DataFrame
    rows: int
    cols: int

    # --- constructors ---

    @classmethod
    def of(cls, spark: SparkSession, a) -> Matrix:
        a = np.asarray(a, float)
        data = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
        return cls(spark.createDataFrame(data, "i long, j long, v double"), *a.shape)

    @classmethod
    def zeros(cls, spark: SparkSession, rows: int, cols: int) -> Matrix:
        return cls(spark.createDataFrame([], "i long, j long, v double"), rows, cols)

    @classmethod
    def ones(cls, spark: SparkSession, rows: int, cols: int) -> Matrix:
        cells = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("i"), (F.col("id") % cols).alias("j"), F.lit(1.0).alias("v"))
        return cls(cells, rows, cols)

    @classmethod
    def identity(cls, spark: SparkSession, n: int) -> Matrix:
        return cls(spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")), n, n)

    @classmethod
    def from_arrays(cls, df: DataFrame, key: str, array: str, rows: int, cols: int) -> Matrix:
        """Rows from array columns: ``key`` is the row number."""
        return cls(df.select(F.col(key).cast("long").alias("i"), F.posexplode(array).alias("j", "v")).select("i", F.col("j").cast("long"), F.col("v").cast("double")), rows, cols)

    @classmethod
    def adjacency(cls, edges: DataFrame, n: int, weight: str | None = None, directed: bool = False) -> Matrix:
        """Distinct 0/1 cells, or sums of weights; both ways for undirected edges."""
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        e = edges.select(F.col("source").alias("i"), F.col("target").alias("j"), w.alias("v"))
        if not directed:
            e = e.unionByName(e.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
        return cls(e.groupBy("i", "j").agg((F.sum if weight else F.max)("v").alias("v")), n, n)

    def _with(self, cells: DataFrame, rows: int | None = None, cols: int | None = None) -> Matrix:
        return Matrix(cells, self.rows if rows is None else rows, self.cols if cols is None else cols)

    def dense(self) -> Matrix:
        full = Matrix.ones(self.cells.sparkSession, self.rows, self.cols).cells.drop("v")
        return self._with(full.join(self.cells, ["i", "j"], "left").na.fill(0.0, ["v"]))

    # --- cells and shape ---

    def get(self, i: int, j: int) -> float:
        r = self.cells.where((F.col("i") == i) & (F.col("j") == j)).first()
        return r["v"] if r else 0.0

    def set(self, i: int, j: int, v: float) -> Matrix:
        rest = self.cells.where((F.col("i") != i) | (F.col("j") != j))
        return self._with(rest.unionByName(self.cells.sparkSession.createDataFrame([(i, j, float(v))], "i long, j long, v double")))

    def row(self, i: int) -> DataFrame:
        return self.cells.where(F.col("i") == i).select("j", "v")

    def column(self, j: int) -> DataFrame:
        return self.cells.where(F.col("j") == j).select("i", "v")

    def block(self, rows: int, cols: int) -> Matrix:
        return self._with(self.cells.where((F.col("i") < rows) & (F.col("j") < cols)), rows, cols)

    def transpose(self) -> Matrix:
        return Matrix(self.cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), self.cols, self.rows)

    def reshape(self, rows: int, cols: int) -> Matrix:
        if rows * cols != self.rows * self.cols:
            raise ValueError("the number of cells changes")
        at = F.col("i") * self.cols + F.col("j")
        return Matrix(self.cells.select(F.floor(at / cols).alias("i"), (at % cols).alias("j"), "v"), rows, cols)

    def concatenate(self, other: Matrix, axis: int = 0) -> Matrix:
        if axis == 0:
            moved = other.cells.withColumn("i", F.col("i") + self.rows)
            return Matrix(self.cells.unionByName(moved), self.rows + other.rows, self.cols)
        moved = other.cells.withColumn("j", F.col("j") + self.cols)
        return Matrix(self.cells.unionByName(moved), self.rows, self.cols + other.cols)

    def split(self, points: list[int], axis: int = 0) -> list[Matrix]:
        end, key = (self.rows, "i") if axis == 0 else (self.cols, "j")
        out = []
        for a, b in zip([0, *points], [*points, end], strict=True):
            cells = self.cells.where((F.col(key) >= a) & (F.col(key) < b)).withColumn(key, F.col(key) - a)
            out.append(Matrix(cells, b - a, self.cols) if axis == 0 else Matrix(cells, self.rows, b - a))
        return out

    def tile(self, down: int, across: int) -> Matrix:
        at = F.explode(F.sequence(F.lit(0), F.lit(down * across - 1))).alias("t")
        cells = self.cells.select("*", at).select((F.col("i") + F.floor(F.col("t") / across) * self.rows).alias("i"), (F.col("j") + F.col("t") % across * self.cols).alias("j"), "v")
        return Matrix(cells, self.rows * down, self.cols * across)

    # --- arithmetic ---

    def matmul(self, other: Matrix) -> Matrix:
        a = self.cells.select("i", F.col("j").alias("k"), "v")
        b = other.cells.select(F.col("i").alias("k"), "j", F.col("v").alias("w"))
        return Matrix(a.join(b, "k").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v")), self.rows, other.cols)

    def power(self, k: int) -> Matrix:
        if k == 0:
            return Matrix.identity(self.cells.sparkSession, self.rows)
        half = self.power(k // 2) if k > 1 else None
        return self if half is None else half.matmul(half) if k % 2 == 0 else half.matmul(half).matmul(self)

    def add(self, other: Matrix, sign: float = 1.0) -> Matrix:
        both = self.cells.unionByName(other.cells.withColumn("v", F.col("v") * sign))
        return self._with(both.groupBy("i", "j").agg(F.sum("v").alias("v")))

    def subtract(self, other: Matrix) -> Matrix:
        return self.add(other, -1.0)

    def hadamard(self, other: Matrix) -> Matrix:
        b = other.cells.select("i", "j", F.col("v").alias("w"))
        return self._with(self.cells.join(b, ["i", "j"]).select("i", "j", (F.col("v") * F.col("w")).alias("v")))

    def scale(self, k: float) -> Matrix:
        return self._with(self.cells.withColumn("v", F.col("v") * k))

    def map(self, f, keeps_zero: bool = True) -> Matrix:
        """``f`` of every cell; a function of 0 that isn't 0 needs all cells."""
        base = self if keeps_zero else self.dense()
        return base._with(base.cells.withColumn("v", f(F.col("v"))))

    def softmax(self) -> Matrix:
        d, row = self.dense(), Window.partitionBy("i")
        e = d.cells.withColumn("v", F.exp(F.col("v") - F.max("v").over(row)))
        return d._with(e.withColumn("v", F.col("v") / F.sum("v").over(row)))

    def dropout(self, p: float, seed: int = 0) -> Matrix:
        draw = F.pmod(F.xxhash64("i", "j", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
        return self._with(self.cells.where(draw >= p).withColumn("v", F.col("v") / (1 - p)))

    # --- statistics ---

    def stats(self) -> DataFrame:
        """One row over all cells: sum, mean, min, max, frobenius, l1, inf, zeros, trace."""
        n = self.rows * self.cols
        z = F.count_if(F.col("v") != 0)
        low = lambda f, pick: F.when(z < n, pick(f("v"), F.lit(0.0))).otherwise(f("v"))
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        return self.cells.agg(zero(F.sum("v")).alias("sum"), (zero(F.sum("v")) / n).alias("mean"), zero(low(F.min, F.least)).alias("min"), zero(low(F.max, F.greatest)).alias("max"), F.sqrt(zero(F.sum(F.col("v") * F.col("v")))).alias("frobenius"), zero(F.sum(F.abs("v"))).alias("l1"), zero(F.max(F.abs("v"))).alias("inf"), (F.lit(n) - z).alias("zeros"), zero(F.sum(F.when(F.col("i") == F.col("j"), F.col("v")))).alias("trace"))

    def axis(self, axis: int = 0) -> DataFrame:
        """Per column (axis 0) or row (axis 1): sum, mean, var and std (sample), min, max; zeros count."""
        key, n, size = ("j", self.rows, self.cols) if axis == 0 else ("i", self.cols, self.rows)
        every = self.cells.sparkSession.range(size).toDF(key)
        g = self.cells.groupBy(key).agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("k"))
        x = every.join(g, key, "left").na.fill(0.0, ["s", "q"]).na.fill(0, ["k"])
        var = F.greatest((F.col("q") - F.col("s") * F.col("s") / n) / max(n - 1, 1), F.lit(0.0))
        edge = lambda c, pick: F.when(F.col("k") == n, F.col(c)).otherwise(pick(F.coalesce(c, F.lit(0.0)), F.lit(0.0)))
        return x.select(key, F.col("s").alias("sum"), (F.col("s") / n).alias("mean"), var.alias("var"), F.sqrt(var).alias("std"), edge("lo", F.least).alias("min"), edge("hi", F.greatest).alias("max"))

    def is_square(self) -> bool:
        return self.rows == self.cols

    def is_symmetric(self, tol: float = 1e-9) -> bool:
        return self.is_square() and self.subtract(self.transpose()).cells.where(F.abs("v") > tol).isEmpty()

    def is_sparse(self, share: float = 0.5) -> bool:
        """Whether more than ``share`` of the cells are zero."""
        return self.cells.where("v <> 0").count() < (1 - share) * self.rows * self.cols

    def is_adjacency(self) -> bool:
        """Whether it is square and holds nothing but 0 and 1."""
        return self.is_square() and self.cells.where("v NOT IN (0, 1)").isEmpty()

    # --- graphs ---

    def degrees(self) -> Matrix:
        return self._with(self.cells.groupBy("i").agg(F.sum("v").alias("v")).select("i", F.col("i").alias("j"), "v"))

    def laplacian(self) -> Matrix:
        return self.degrees().subtract(self)

    def normalized(self, eps: float = -0.5) -> Matrix:
        """D^eps A D^eps, D the row sums."""
        d = self.degrees().cells.where("v > 0").select("i", F.pow("v", F.lit(eps)).alias("d"))
        out = self.cells.join(d, "i").join(d.select(F.col("i").alias("j"), F.col("d").alias("e")), "j")
        return self._with(out.select("i", "j", (F.col("d") * F.col("v") * F.col("e")).alias("v")))

    # --- driver kernels ---

    def to_numpy(self) -> np.ndarray:
        if self.rows * self.cols > KERNEL_CELLS:
            raise ValueError(f"the driver takes matrices of up to {KERNEL_CELLS} cells")
        out = np.zeros((self.rows, self.cols))
        for i, j, v in self.cells.collect():
            out[i, j] = v
        return out

    def determinant(self) -> float:
        return float(np.linalg.det(self.to_numpy()))

    def inverse(self) -> Matrix:
        return Matrix.of(self.cells.sparkSession, np.linalg.inv(self.to_numpy()))

    def solve(self, b: np.ndarray) -> np.ndarray:
        return np.linalg.solve(self.to_numpy(), b)

    def svd(self):
        return np.linalg.svd(self.to_numpy(), full_matrices=False)

    def qr(self):
        return np.linalg.qr(self.to_numpy())

    def cholesky(self) -> np.ndarray:
        return np.linalg.cholesky(self.to_numpy())

    def lu(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(P, L, U) with partial pivoting: P A = L U."""
        u = self.to_numpy()
        n = len(u)
        p, low = np.eye(n), np.zeros((n, n))
        for k in range(n):
            top = k + int(np.abs(u[k:, k]).argmax())
            for m in (u, p, low):
                m[[k, top]] = m[[top, k]]
            if u[k, k]:
                low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
                u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
        return p, low + np.eye(n), np.triu(u)

    def eigen(self):
        a = self.to_numpy()
        return np.linalg.eigh(a) if np.allclose(a, a.T) else np.linalg.eig(a)

    def rank(self) -> int:
        return int(np.linalg.matrix_rank(self.to_numpy()))

    def dominant(self, rounds: int = 50) -> tuple[float, DataFrame]:
        """Dominant eigenvalue and vector (i, x) by distributed power iteration."""
        from quillgraph.plans.staging import cut

        spark = self.cells.sparkSession
        x = spark.range(self.rows).select(F.col("id").alias("j"), F.lit(self.rows**-0.5).alias("x"))
        value = 0.0
        for _ in range(rounds):
            y = cut(self.cells.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y")), "power")
            size = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0]
            if not size:
                break
            old, value = value, size
            x = y.select(F.col("i").alias("j"), (F.col("y") / size).alias("x"))
            if abs(value - old) < 1e-12 * value:
                break
        return value, x.withColumnRenamed("j", "i")
