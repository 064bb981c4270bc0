"""Whitening of embeddings by a covariance over weighted distinct vectors.

Every entry c of a vector becomes x = floor(256 c).  Equal x vectors are one fit row, whose weight is one, or their number with
`weights="count"`: a vector that fills a third of the table is then one row of the fit, whatever its copies.  The distinct
rows are written once; three passes go over them, each of which adds up in its tasks and sends a number per dimension or per
pair of dimensions:

* n and the sums S, exact whole numbers;
* the covariance: each batch is centred by S / n and multiplied by its weighted self (one matrix product), the d x d products
  are added;
* the whitened coordinates of each distinct vector, once, and their covariance, centred again, against the identity.

Rows and their whitened vectors meet again in a join on 128 bits of x.  A vector with many copies is a hot key: rows of keys above a
thousandth of all rows (so at most a thousand keys, the proven bound of the list that is broadcast) are dealt to as many salts
as the key has portions of `_PORTION` rows, and the distinct row is repeated per salt.

Only n, S, the d x d covariance and the few eigenvectors pass the driver.

Cases: rows whose vector is null, or holds a null or non-finite entry, are left out.  Repeated rows give equal rows, repeated and
null ids are carried through.  Vectors of another length are a space of their own, fitted apart; empty vectors have no
components and so no rows.  A component whose eigenvalue is not positive (up to rounding) cannot be whitened and is left out, so
a space of a single distinct vector gives no rows.  Of tied eigenvalues any orthonormal vectors are right.  `deviation` beyond 64
bits is null.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from topicspark.llm.registry import query, table
from topicspark.llm.stages import Steps

SCALE, COMPONENTS = 256, 4
_PORTION, _HOT_KEYS = 500, 1000
_BATCH_ROWS = 8_192
KEY = ["h1", "h2"]             # 128 bits that stand for x where rows meet again


def whole_numbers(vector: Column) -> Column:
    """floor(SCALE c) of each entry."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * F.lit(float(SCALE))).cast("long"))


def usable(vector: Column) -> Column:
    def bad(c):
        c = c.cast("double")
        return c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))

    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def key_of(x: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), x).alias(name) for seed, name in enumerate(KEY)]


def _matrix(column: pa.Array, d: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(kind)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _BATCH_ROWS):
            yield batch.slice(at, _BATCH_ROWS)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel()))


def sums(distinct: DataFrame, d: int) -> tuple[int, list[int]]:
    """Total weight and weighted sum of every dimension: exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d + 1, dtype=object)             # Python's whole numbers
        for batch in _batches(batches):
            x, weight = _matrix(batch.column(0), d, np.int64), batch.column(1).to_numpy(zero_copy_only=False)
            if float(np.abs(x.astype(np.float64)).max(initial=0)) * float(weight.sum()) < 2.0 ** 62:
                part = weight @ x
            else:
                part = weight.astype(object) @ x.astype(object)
            total[:d] += part.astype(object)
            total[d] += int(weight.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1, dtype=np.int32)), pa.array([str(t) for t in total])], ["i", "value"])

    cells = distinct.select("x", "weight").mapInArrow(run, "i int, value string")
    rows = cells.groupBy("i").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()     # d + 1 numbers
    found = {r["i"]: int(r["value"]) for r in rows}
    return found[d], [found[k] for k in range(d)]


def centred_products(rows: DataFrame, d: int, mean: np.ndarray) -> np.ndarray:
    """Weighted sum of (x - mean) (x - mean)^T over `rows(x, weight)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in _batches(batches):
            x = _matrix(batch.column(0), d, np.float64) - mean
            total += (x * batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]).T @ x
        i, j = np.divmod(np.arange(d * d), d)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())],
                                         ["i", "j", "value"])

    cells = rows.select("x", "weight").mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    out = np.zeros((d, d))
    for r in cells.toLocalIterator():                     # d x d numbers
        out[r["i"], r["j"]] = r["value"]
    return (out + out.T) / 2


def principal(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues and their unit eigenvectors as columns, those that are zero by rounding left out."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = values > max(values[0], 0.0) * len(values) * np.finfo(np.float64).eps
    many = min(components, int(real.sum()))
    return values[:many], vectors[:, :many]


def whitened_distinct(distinct: DataFrame, d: int, n: int, total: list[int], values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """(h1, h2, weight, deviation, whitened) of every distinct vector: each is projected once."""
    mean = np.array([s / n for s in total])               # division of whole numbers, rounded once
    to = vectors / np.sqrt(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            x = _matrix(batch.column(0), d, np.int64)
            most = n * float(np.abs(x.astype(np.float64)).max(initial=0)) + max(abs(s) for s in total)
            kind = np.int64 if d * most * most < 2.0 ** 62 else object       # whole numbers of any size
            apart = x.astype(kind) * n - np.array(total, dtype=kind)
            deviation = (apart * apart).sum(axis=1).tolist()
            fits = [v if v < 1 << 63 else None for v in deviation]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fits, pa.int64()), _lists((x - mean) @ to)],
                                             ["weight", "h1", "h2", "deviation", "whitened"])

    return distinct.select("x", "weight", *KEY).mapInArrow(
        run, "weight long, h1 long, h2 long, deviation long, whitened array<double>")


def join_back(rows: DataFrame, distinct: DataFrame, counts: DataFrame, portion: int = _PORTION) -> DataFrame:
    """`rows(id, h1, h2)` with the columns of `distinct(h1, h2, ...)`; hot keys are dealt to salts, by `counts(h1, h2, copies)`."""
    total = counts.agg(F.sum("copies")).first()[0] or 0
    many = max(portion, total // _HOT_KEYS)               # so at most _HOT_KEYS keys are hot
    hot = F.broadcast(counts.where(F.col("copies") > many).select(*KEY, F.ceil(F.col("copies") / portion).cast("int").alias("salts")))
    salted = (rows.join(hot, KEY, "left")
              .withColumn("salt", F.coalesce(F.floor(F.rand(1) * F.col("salts")).cast("int"), F.lit(0))).drop("salts"))
    copies = (distinct.join(hot, KEY, "left")
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts"))
    return salted.join(copies, [*KEY, "salt"]).drop("salt", *KEY)


def whiten(vectors: DataFrame, components: int = COMPONENTS, weights: str = "one", id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error for each usable row and each of the first components.

    `weights` is "one" (every distinct vector counts once) or "count" (as often as it occurs).
    """
    if weights not in ("one", "count"):
        raise ValueError("weights must be 'one' or 'count'")
    steps = Steps(vectors.sparkSession, "whitening")
    rows = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), whole_numbers(F.col(vector_col)).alias("x"))
    counts = steps.save(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).select("*", *key_of(F.col("x"))), "distinct")
    weight = F.col("copies") if weights == "count" else F.lit(1).cast("long")
    lengths = sorted(r["d"] for r in counts.select(F.size("x").alias("d")).distinct().collect())   # one number per vector length
    parts = []
    for d in (d for d in lengths if d):
        of_length = F.size("x") == d
        distinct = counts.where(of_length).select("x", weight.alias("weight"), *KEY)
        n, total = sums(distinct, d)
        covariance = centred_products(distinct, d, np.array([s / n for s in total])) / n
        values, axes = principal(covariance, components)
        if not len(values):
            continue
        done = steps.save(whitened_distinct(distinct, d, n, total, values, axes), f"whitened-{d}")
        k = len(values)
        white = done.select(F.col("whitened").alias("x"), "weight")
        centre = white.agg(F.array(*[F.sum(F.col("x")[i] * F.col("weight")) / n for i in range(k)])).first()[0]
        error = float(np.abs(centred_products(white, k, np.array(centre)) / n - np.eye(k)).max())
        share = values / np.trace(covariance)
        joined = join_back(rows.where(of_length).select("id", *key_of(F.col("x"))), done.drop("weight"), counts.where(of_length))
        explained = F.array(*[F.lit(float(s)) for s in share])
        parts.append(joined.select("id", F.posexplode("whitened").alias("component", "whitened"), "deviation").select(
            F.col("id").alias(id_col), (F.col("component") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
            "deviation", "whitened", explained[F.col("component")].alias("explained"), F.lit(error).alias("identity_error")))
    if not parts:
        return rows.limit(0).select(
            F.col("id").alias(id_col), F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
            F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
