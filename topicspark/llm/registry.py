"""Queries of this subpackage and their SQL twins, and small helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is what another engine must get from the same tables."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, _UPPER, _UPPER.lower())


def text_of(name: str = "text") -> Column:
    """A missing text is an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once: inside it the value is a variable, which no optimizer rule can expand."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
