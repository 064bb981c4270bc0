"""Random values that depend only on a seed and on row keys, so a retried task draws the same numbers."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, functions as F

from topicspark.functions.vectors import elementwise

GAMMA_SHAPE, GAMMA_SCALE = 100.0, 0.01          # starting values of the parameter matrices: mean 1, sd 0.1
_UNIFORM_WIDTH = 0.1 * math.sqrt(3.0)           # half width of a uniform with the same mean and sd


def u01(seed: int, *keys) -> Column:
    """A uniform in [0, 1) from the md5 of `seed:key:key...`; 32 bits, the same in any SQL engine with md5."""
    parts = [F.lit(str(seed))] + [k.cast("string") if isinstance(k, Column) else F.col(k).cast("string") for k in keys]
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def fast_u01(seed: int, *keys) -> Column:
    """A uniform in [0, 1) from the upper 53 bits of a 64-bit hash: many times cheaper than md5, but Spark's own."""
    parts = [F.lit(seed)] + [k if isinstance(k, Column) else F.col(k) for k in keys]
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0 ** -53)


def uniform(portable: bool):
    return u01 if portable else fast_u01


def uniform_topic(seed: int, n_topics: int, *keys, portable: bool = True) -> Column:
    """A uniform topic number for a token."""
    return F.floor(uniform(portable)(seed, *keys) * F.lit(float(n_topics))).cast("int")


def near_one(seed: int, *keys) -> Column:
    """A value with the mean and spread of Gamma(100, 0.01), drawn by hash instead of by a sampler."""
    return F.lit(1.0) + F.lit(_UNIFORM_WIDTH) * (F.lit(2.0) * u01(seed, *keys) - F.lit(1.0))


def near_one_array(seed: int, n_topics: int, *keys) -> Column:
    return elementwise(n_topics, lambda k: near_one(seed, *keys, k))


def draw_category(weights: Column, u: Column, n: int) -> Column:
    """The category of unnormalised weights that a draw `u` from [0, 1) falls on, by cumulative sums."""
    total = reduce(lambda a, b: a + b, [weights[k] for k in range(n)])
    below, out = F.lit(0.0), F.lit(0)
    for k in range(n - 1):
        below = below + weights[k]
        out = out + F.when(below < u * total, 1).otherwise(0)
    return out
