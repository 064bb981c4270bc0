"""Matrices as long tables `(row, col, value)`.

Sums per row or column are aggregates with map-side partials joined back to the cells, not windows: a window would put
a row that holds a large share of the cells in one task, while the join of a skewed row is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from topicspark.functions.special import digamma
from topicspark.functions.vectors import TINY


def from_arrays(df: DataFrame, row_col: str, array_col: str) -> DataFrame:
    """One matrix row per input row."""
    return (df.select(F.col(row_col).alias("row"), F.posexplode(array_col).alias("col", "value"))
            .withColumn("value", F.col("value").cast("double")))


def to_arrays(m: DataFrame, n_cols: int) -> DataFrame:
    """`(row, values)`, absent cells as 0.  The array of a row has the fixed length `n_cols`."""
    pairs = F.map_from_entries(F.collect_list(F.struct("col", "value")))
    return (m.groupBy("row").agg(pairs.alias("_cells"))
            .select("row", F.transform(F.sequence(F.lit(0), F.lit(n_cols - 1)),
                                       lambda c: F.coalesce(F.col("_cells")[c], F.lit(0.0))).alias("values")))


def cells(m: DataFrame, fn) -> DataFrame:
    """Apply a function to every value."""
    return m.withColumn("value", fn(F.col("value")))


def row_of(m: DataFrame, i: int) -> DataFrame:
    return m.where(F.col("row") == i).select("col", "value")


def column_of(m: DataFrame, j: int) -> DataFrame:
    return m.where(F.col("col") == j).select("row", "value")


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def fold_rows(m: DataFrame) -> DataFrame:
    """Add the rows up: one sum per column."""
    return m.groupBy("col").agg(F.sum("value").alias("value"))


def fold_cols(m: DataFrame) -> DataFrame:
    """Add the columns up: one sum per row."""
    return m.groupBy("row").agg(F.sum("value").alias("value"))


def fold_all(m: DataFrame) -> DataFrame:
    return m.agg(F.sum("value").alias("value"))


def max_value(m: DataFrame) -> DataFrame:
    return m.agg(F.max("value").alias("value"))


def max_per_row(m: DataFrame) -> DataFrame:
    return m.groupBy("row").agg(F.max("value").alias("value"))


def _with_group(m: DataFrame, by: str, aggregate: Column, name: str) -> DataFrame:
    return m.join(m.groupBy(by).agg(aggregate.alias(name)), by)


def _other(by: str) -> str:
    return {"row": "col", "col": "row"}[by]


def normalise(m: DataFrame, by: str) -> DataFrame:
    """Divide each value by its row's or column's sum."""
    return (_with_group(m, by, F.sum("value"), "_total")
            .select("row", "col", (F.col("value") / (F.col("_total") + F.lit(TINY))).alias("value")))


def dirichlet_expectation(m: DataFrame, by: str = "row") -> DataFrame:
    """psi(value) - psi(sum over its row, or over its column)."""
    return (_with_group(m, by, F.sum("value"), "_total")
            .select("row", "col", (digamma(F.col("value")) - digamma(F.col("_total"))).alias("value")))


def logsumexp_rows(m: DataFrame) -> DataFrame:
    """`(row, value)`: log of the sum of exponentials of each row, shifted by the row's largest value."""
    shifted = _with_group(m, "row", F.max("value"), "_top")
    return (shifted.groupBy("row")
            .agg((F.max("_top") + F.log(F.sum(F.exp(F.col("value") - F.col("_top"))))).alias("value")))


def softmax_rows(m: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """exp(value - logsumexp(row)); with `weights(row, weight)` multiplied by the row's weight."""
    norm = logsumexp_rows(m).withColumnRenamed("value", "_lse")
    out = m.join(norm, "row").withColumn("value", F.exp(F.col("value") - F.col("_lse")))
    if weights is not None:
        out = out.join(weights, "row").withColumn("value", F.col("value") * F.col("weight"))
    return out.select("row", "col", "value")


def exp_times_weight(m: DataFrame, weights: DataFrame) -> DataFrame:
    """exp(value) times the weight of the row."""
    return (m.join(weights, "row")
            .select("row", "col", (F.exp("value") * F.col("weight")).alias("value")))


def _zip_cells(a: DataFrame, b: DataFrame, fn) -> DataFrame:
    left = a.withColumnRenamed("value", "_a")
    right = b.withColumnRenamed("value", "_b")
    return left.join(right, ["row", "col"]).select("row", "col", fn(F.col("_a"), F.col("_b")).alias("value"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    return _zip_cells(a, b, lambda x, y: x * y)


def blend(old: DataFrame, new: DataFrame, rho: float) -> DataFrame:
    """(1 - rho) * old + rho * new."""
    return _zip_cells(old, new, lambda x, y: F.lit(1.0 - rho) * x + F.lit(rho) * y)


def mean_abs_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    return _zip_cells(a, b, lambda x, y: F.abs(x - y)).agg(F.avg("value").alias("value"))


def _with_vector(m: DataFrame, v: DataFrame, axis: str, fn) -> DataFrame:
    vec = v.select(F.col("idx").alias(axis), F.col("value").alias("_v"))
    return m.join(vec, axis).select("row", "col", fn(F.col("value"), F.col("_v")).alias("value"))


def add_col_vector(m: DataFrame, v: DataFrame) -> DataFrame:
    """value + v[row], for `v(idx, value)`."""
    return _with_vector(m, v, "row", lambda x, y: x + y)


def add_row_vector(m: DataFrame, v: DataFrame) -> DataFrame:
    """value + v[col]."""
    return _with_vector(m, v, "col", lambda x, y: x + y)


def mul_row_vector(m: DataFrame, v: DataFrame) -> DataFrame:
    """value * v[col]."""
    return _with_vector(m, v, "col", lambda x, y: x * y)


def l1_distance(v: DataFrame, w: DataFrame) -> DataFrame:
    """Sum of absolute differences of two `(idx, value)` vectors."""
    left, right = v.withColumnRenamed("value", "_a"), w.withColumnRenamed("value", "_b")
    return left.join(right, "idx").agg(F.sum(F.abs(F.col("_a") - F.col("_b"))).alias("value"))


def add_deltas(m: DataFrame, deltas: DataFrame) -> DataFrame:
    """Change cells by adding delta rows; a cell is created by its first delta."""
    return (m.select("row", "col", "value").unionByName(deltas.select("row", "col", "value"))
            .groupBy("row", "col").agg(F.sum("value").alias("value")))


def set_cells(m: DataFrame, updates: DataFrame) -> DataFrame:
    """Replace (or create) cells."""
    new = updates.select("row", "col", F.col("value").alias("_new"))
    return (m.join(new, ["row", "col"], "full_outer")
            .select("row", "col", F.coalesce("_new", "value").alias("value")))


def dense(m: DataFrame, rows: DataFrame, n_cols: int) -> DataFrame:
    """Every cell of `rows` x 0..n_cols-1, absent ones as 0: each row generates its own columns."""
    grid = rows.select("row", F.explode(F.sequence(F.lit(0), F.lit(n_cols - 1))).alias("col"))
    return (grid.join(m, ["row", "col"], "left")
            .select("row", "col", F.coalesce("value", F.lit(0.0)).alias("value")))


def flip_cumsum(vectors: DataFrame) -> DataFrame:
    """For each vector `(vec, idx, value)` of fixed length n: output i is the sum of inputs n-1 down to n-1-i, where
    input 0 is never added, and the last output is 0.  A vector has one element per topic, so a window holds one
    vector."""
    # the ordering column has to be the data's own index; the window is per vector
    tail = Window.partitionBy("vec").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    size = Window.partitionBy("vec")
    summed = vectors.select("vec", "idx", F.sum("value").over(tail).alias("_s"), F.max("idx").over(size).alias("_last"))
    return summed.select("vec",
                         F.when(F.col("idx") == 0, F.col("_last")).otherwise(F.col("_last") - F.col("idx")).alias("idx"),
                         F.when(F.col("idx") == 0, F.lit(0.0)).otherwise(F.col("_s")).alias("value"))


def stick_terms(pairs: DataFrame) -> DataFrame:
    """Stick-breaking terms of `(vec, idx, a, b)`, the two rows of a 2 x T matrix: with E the expectation of each
    column, output j is E[a]_j plus the sum of E[b]_1 .. E[b]_j."""
    expected = pairs.select("vec", "idx",
                            (digamma(F.col("a")) - digamma(F.col("a") + F.col("b"))).alias("_ea"),
                            (digamma(F.col("b")) - digamma(F.col("a") + F.col("b"))).alias("_eb"))
    upto = Window.partitionBy("vec").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    counted = F.when(F.col("idx") >= 1, F.col("_eb")).otherwise(F.lit(0.0))
    return expected.select("vec", "idx", (F.sum(counted).over(upto) + F.col("_ea")).alias("value"))
