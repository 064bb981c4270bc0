"""Learning rates and string helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: everything outside the character ranges that XML 1.0 allows.
_NOT_XML = r"[^\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}]"


def learning_rate(t, scale: float = 1.0, tau0: float = 1025.0, kappa: float = 0.7):
    """max(0, scale * (tau0 + t)^-kappa) for a step number given as a column or as a Python number."""
    if isinstance(t, Column):
        return F.greatest(F.lit(0.0), F.lit(scale) * F.pow(F.lit(tau0) + t, F.lit(-kappa)))
    return max(0.0, scale * (tau0 + t) ** -kappa)


def strip_xml(text: Column) -> Column:
    """Drop characters that XML 1.0 forbids, and all beyond the basic plane; a null becomes an empty string."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _NOT_XML, "")


def parse_pairs(tokens: Column) -> Column:
    """`['3:2', ...]` to an array of `(pos, word_id, freq)`."""
    return F.transform(
        tokens,
        lambda token, pos: F.struct(
            pos.alias("pos"),
            F.split_part(token, F.lit(":"), F.lit(1)).cast("int").alias("word_id"),
            F.split_part(token, F.lit(":"), F.lit(2)).cast("int").alias("freq")))


def vector_to_json(v: Column) -> Column:
    return F.to_json(v)


def vector_from_json(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def sparse_to_json(words: Column, values: Column) -> Column:
    """A `{word: value}` object from parallel arrays."""
    return F.to_json(F.map_from_arrays(words.cast("array<string>"), values))


def sparse_from_json(text: Column) -> Column:
    """json keys are text; they become word numbers again."""
    return F.transform_keys(F.from_json(text, "map<string,double>"), lambda key, _: key.cast("int"))
