"""Functions of `array<double>` columns: one vector per row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from topicspark.functions.special import digamma, lgamma

TINY = 1e-100  # added to a normaliser so that an all-zero vector stays zero


def vec_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def vec_max(v: Column) -> Column:
    return F.array_max(v)


def vec_normalise(v: Column) -> Column:
    total = vec_sum(v) + F.lit(TINY)
    return F.transform(v, lambda x: x / total)


def vec_logsumexp(v: Column) -> Column:
    """log of the sum of exponentials, shifted by the largest element."""
    top = F.array_max(v)
    return top + F.log(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))


def vec_l1(v: Column, w: Column) -> Column:
    return vec_sum(F.zip_with(v, w, lambda a, b: F.abs(a - b)))


def vec_mul(v: Column, w: Column) -> Column:
    return F.zip_with(v, w, lambda a, b: a * b)


def vec_add(v: Column, w: Column) -> Column:
    return F.zip_with(v, w, lambda a, b: a + b)


def vec_exp(v: Column) -> Column:
    return F.transform(v, F.exp)


def vec_lgamma(v: Column) -> Column:
    return F.transform(v, lgamma)


def vec_dirichlet_expectation(v: Column) -> Column:
    """psi(x_i) - psi(sum x)."""
    base = digamma(vec_sum(v))
    return F.transform(v, lambda x: digamma(x) - base)


UNROLL = 64  # up to this length, element-wise work is spelled out so that it compiles


def elementwise(size: int, fn) -> Column:
    """An array of `fn(k)`, where `fn(k)` is a column expression that may use element k of array columns."""
    if size > UNROLL:
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), fn)
    return F.array(*[fn(F.lit(k)) for k in range(size)])


def share_of_sum(rows: DataFrame, keep: list[str], size: int, fn, name: str) -> DataFrame:
    """`keep` columns plus an array `name` of `fn(k) / sum over k`, where `fn(k)` is a column expression.

    The elements are named columns between two projections, so each is computed once and all of it compiles; nested
    higher-order functions are interpreted element by element, and an array in between would be inlined element-wise into
    every use of the sum.
    """
    if size > UNROLL:
        whole = rows.select(*keep, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), fn).alias("_raw"))
        return (whole.withColumn("_total", vec_sum(F.col("_raw")))
                .select(*keep, F.transform("_raw", lambda x: x / F.col("_total")).alias(name)))
    parts = [f"_r{k}" for k in range(size)]
    flat = rows.select(*keep, *[fn(F.lit(k)).alias(p) for k, p in enumerate(parts)])
    total = F.col(parts[0])
    for p in parts[1:]:
        total = total + F.col(p)
    return (flat.withColumn("_total", total)
            .select(*keep, F.array(*[F.col(p) / F.col("_total") for p in parts]).alias(name)))


def literal_vector(values) -> Column:
    """A fixed vector of one number per topic as a column."""
    return F.array(*[F.lit(float(x)) for x in values])


def sum_vectors(column: str, size: int, weight: str | None = None) -> Column:
    """Aggregate: element-wise sum of a fixed-length array column, each row times `weight` if given.

    One SUM per element is a plain hash aggregate with map-side partials; it ships one array per key, where an exploded
    (key, element) form would ship `size` rows.
    """
    w = F.col(weight) if weight else None
    return F.array(*[F.sum(F.col(column)[k] if w is None else F.col(column)[k] * w) for k in range(size)])


def array_to_line(v: Column) -> Column:
    """Elements joined by commas."""
    return F.array_join(v.cast("array<string>"), ",")
