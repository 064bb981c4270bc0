"""Matrix and vector operators over the `embeddings` table seen as a matrix (row = vec_id, col = element number)."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicspark.functions import special, vectors
from topicspark.operators import matrix as mx
from topicspark.queries.base import MATRIX, dig, query, r_sql, rounded, table

# A second matrix and vectors derived from the first, so that binary operators have two different operands.
_POSITIVE = MATRIX + ", q AS (SELECT row, col, abs(value) + 0.1e0 AS value FROM m)"
_SECOND = MATRIX + ", o AS (SELECT row, col, value * value + col AS value FROM m)"
_ROWVEC = MATRIX + ", v AS (SELECT col AS idx, sum(value) AS value FROM m GROUP BY col)"
_COLVEC = MATRIX + ", v AS (SELECT row AS idx, sum(value) AS value FROM m GROUP BY row)"


def _m(spark, d):
    return mx.from_arrays(table(spark, d, "embeddings"), "vec_id", "embedding")


def _positive(spark, d):
    return mx.cells(_m(spark, d), lambda x: F.abs(x) + F.lit(0.1))


def _second(m):
    return m.withColumn("value", F.col("value") * F.col("value") + F.col("col"))


def _row_vector(m):
    return mx.fold_rows(m).withColumnRenamed("col", "idx")


def _col_vector(m):
    return mx.fold_cols(m).withColumnRenamed("row", "idx")


def _out(df, digits=6):
    return df.withColumn("value", rounded("value", digits))


V = r_sql("value")


@query("matrix_cells", f"WITH {MATRIX} SELECT row, col, {V} AS value FROM m")
def matrix_cells(spark, d):
    return _out(_m(spark, d))


@query("fold_rows", f"WITH {MATRIX} SELECT col, {r_sql('sum(value)')} AS value FROM m GROUP BY col")
def fold_rows(spark, d):
    return _out(mx.fold_rows(_m(spark, d)))


@query("fold_cols", f"WITH {MATRIX} SELECT row, {r_sql('sum(value)')} AS value FROM m GROUP BY row")
def fold_cols(spark, d):
    return _out(mx.fold_cols(_m(spark, d)))


@query("fold_matrix", f"WITH {MATRIX} SELECT {r_sql('sum(value)')} AS value FROM m")
def fold_matrix(spark, d):
    return _out(mx.fold_all(_m(spark, d)))


@query("fold_vectors", f"WITH {MATRIX} SELECT row, {r_sql('sum(value)')} AS value FROM m GROUP BY row")
def fold_vectors(spark, d):
    """The row-wise form: one vector per row, no shuffle."""
    v = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), rounded(vectors.vec_sum(v)).alias("value"))


@query("max_value", f"WITH {MATRIX} SELECT {r_sql('max(value)')} AS value FROM m")
def max_value(spark, d):
    return _out(mx.max_value(_m(spark, d)))


@query("max_per_row", f"WITH {MATRIX} SELECT row, {r_sql('max(value)')} AS value FROM m GROUP BY row")
def max_per_row(spark, d):
    return _out(mx.max_per_row(_m(spark, d)))


@query("matrix_column", f"WITH {MATRIX} SELECT row, {V} AS value FROM m WHERE col = 3")
def matrix_column(spark, d):
    return _out(mx.column_of(_m(spark, d), 3))


@query("matrix_row", f"WITH {MATRIX} SELECT col, {V} AS value FROM m WHERE row = 3")
def matrix_row(spark, d):
    return _out(mx.row_of(_m(spark, d), 3))


@query("transpose", f"WITH {MATRIX} SELECT col AS row, row AS col, {V} AS value FROM m")
def transpose(spark, d):
    return _out(mx.transpose(_m(spark, d)))


@query("elem_exp", f"WITH {MATRIX} SELECT row, col, {r_sql('exp(value)')} AS value FROM m")
def elem_exp(spark, d):
    return _out(mx.cells(_m(spark, d), F.exp))


@query("row_norm", f"WITH {_POSITIVE} SELECT row, col, "
                   f"{r_sql('value / (sum(value) OVER (PARTITION BY row) + 1e-100)', 8)} AS value FROM q")
def row_norm(spark, d):
    return _out(mx.normalise(_positive(spark, d), "row"), 8)


@query("col_norm", f"WITH {_POSITIVE} SELECT row, col, "
                   f"{r_sql('value / (sum(value) OVER (PARTITION BY col) + 1e-100)', 8)} AS value FROM q")
def col_norm(spark, d):
    return _out(mx.normalise(_positive(spark, d), "col"), 8)


@query("vec_norm", f"WITH {_POSITIVE} SELECT row, CAST(col AS INTEGER) AS col, "
                   f"{r_sql('value / (sum(value) OVER (PARTITION BY row) + 1e-100)', 8)} AS value FROM q")
def vec_norm(spark, d):
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.abs(x) + F.lit(0.1))
    return (table(spark, d, "embeddings")
            .select(F.col("vec_id").alias("row"), F.posexplode(vectors.vec_normalise(v)).alias("col", "value"))
            .withColumn("value", rounded("value", 8)))


_LSE = MATRIX + (", t AS (SELECT row, max(value) AS top FROM m GROUP BY row), "
                 "l AS (SELECT row, max(top) + ln(sum(exp(value - top))) AS lse FROM m JOIN t USING (row) GROUP BY row)")


@query("logsumexp", f"WITH {_LSE} SELECT row, {r_sql('lse')} AS value FROM l")
def logsumexp(spark, d):
    return _out(mx.logsumexp_rows(_m(spark, d)))


@query("vec_logsumexp", f"WITH {_LSE} SELECT row, {r_sql('lse')} AS value FROM l")
def vec_logsumexp(spark, d):
    v = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row"),
                                                rounded(vectors.vec_logsumexp(v)).alias("value"))


@query("softmax_rows", f"WITH {_LSE} SELECT row, col, {r_sql('exp(value - lse)', 8)} AS value FROM m JOIN l USING (row)")
def softmax_rows(spark, d):
    return _out(mx.softmax_rows(_m(spark, d)), 8)


def _weights(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), (F.col("label") + 1).alias("weight"))


@query("softmax_rows_weighted",
       f"WITH {_LSE} SELECT m.row, col, {r_sql('exp(value - lse) * (label + 1)', 8)} AS value FROM m JOIN l USING (row) "
       "JOIN embeddings e ON e.vec_id = m.row")
def softmax_rows_weighted(spark, d):
    return _out(mx.softmax_rows(_m(spark, d), _weights(spark, d)), 8)


@query("exp_times_weight",
       f"WITH {MATRIX} SELECT m.row, col, {r_sql('exp(value) * (label + 1)')} AS value FROM m "
       "JOIN embeddings e ON e.vec_id = m.row")
def exp_times_weight(spark, d):
    return _out(mx.exp_times_weight(_m(spark, d), _weights(spark, d)))


@query("elem_mul", f"WITH {_SECOND} SELECT row, col, {r_sql('m.value * o.value')} AS value FROM m JOIN o USING (row, col)")
def elem_mul(spark, d):
    m = _m(spark, d)
    return _out(mx.multiply(m, _second(m)))


@query("vec_mul", f"WITH {_SECOND} SELECT row, {r_sql('sum(m.value * o.value)')} AS value "
                  "FROM m JOIN o USING (row, col) GROUP BY row")
def vec_mul(spark, d):
    v = F.col("embedding").cast("array<double>")
    w = F.transform(v, lambda x, i: x * x + i)
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("row"), rounded(vectors.vec_sum(vectors.vec_mul(v, w))).alias("value"))


@query("blend", f"WITH {_SECOND} SELECT row, col, {r_sql('0.75e0 * m.value + 0.25e0 * o.value')} AS value "
                "FROM m JOIN o USING (row, col)")
def blend(spark, d):
    m = _m(spark, d)
    return _out(mx.blend(m, _second(m), 0.25))


@query("mean_abs_diff", f"WITH {_SECOND} SELECT {r_sql('avg(abs(m.value - o.value))')} AS value "
                        "FROM m JOIN o USING (row, col)")
def mean_abs_diff(spark, d):
    m = _m(spark, d)
    return _out(mx.mean_abs_diff(m, _second(m)))


@query("l1_diff", f"WITH {_ROWVEC}, w AS (SELECT col AS idx, sum(value * value) AS value FROM m GROUP BY col) "
                  f"SELECT {r_sql('sum(abs(v.value - w.value))')} AS value FROM v JOIN w USING (idx)")
def l1_diff(spark, d):
    m = _m(spark, d)
    squares = _row_vector(mx.cells(m, lambda x: x * x))
    return _out(mx.l1_distance(_row_vector(m), squares))


@query("vec_l1", f"WITH {_SECOND} SELECT row, {r_sql('sum(abs(m.value - o.value))')} AS value "
                 "FROM m JOIN o USING (row, col) GROUP BY row")
def vec_l1(spark, d):
    v = F.col("embedding").cast("array<double>")
    w = F.transform(v, lambda x, i: x * x + i)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row"),
                                                rounded(vectors.vec_l1(v, w)).alias("value"))


@query("add_row_vec", f"WITH {_ROWVEC} SELECT row, col, {r_sql('m.value + v.value')} AS value FROM m JOIN v ON idx = col")
def add_row_vec(spark, d):
    m = _m(spark, d)
    return _out(mx.add_row_vector(m, _row_vector(m)))


@query("add_col_vec", f"WITH {_COLVEC} SELECT row, col, {r_sql('m.value + v.value')} AS value FROM m JOIN v ON idx = row")
def add_col_vec(spark, d):
    m = _m(spark, d)
    return _out(mx.add_col_vector(m, _col_vector(m)))


@query("mul_row_vec", f"WITH {_ROWVEC} SELECT row, col, {r_sql('m.value * v.value')} AS value FROM m JOIN v ON idx = col")
def mul_row_vec(spark, d):
    m = _m(spark, d)
    return _out(mx.mul_row_vector(m, _row_vector(m)))


@query("add_deltas", f"WITH {_SECOND}, b AS (SELECT * FROM m UNION ALL SELECT row, col + 1, value FROM o) "
                     f"SELECT row, col, {r_sql('sum(value)')} AS value FROM b GROUP BY row, col")
def add_deltas(spark, d):
    m = _m(spark, d)
    return _out(mx.add_deltas(m, _second(m).withColumn("col", F.col("col") + 1)))


@query("set_cells", f"WITH {_SECOND}, n AS (SELECT row, col + 1 AS col, value AS fresh FROM o) "
                    f"SELECT row, col, {r_sql('coalesce(fresh, value)')} AS value FROM m FULL JOIN n USING (row, col)")
def set_cells(spark, d):
    m = _m(spark, d)
    return _out(mx.set_cells(m, _second(m).withColumn("col", F.col("col") + 1)))


@query("dense_matrix", f"WITH {MATRIX} SELECT row, col, CASE WHEN value > 0 THEN {V} ELSE 0e0 END AS value FROM m")
def dense_matrix(spark, d):
    m = _m(spark, d)
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("row"))
    return _out(mx.dense(m.where("value > 0"), rows, 64))


@query("dirichlet_exp_row", f"WITH {_POSITIVE}, t AS (SELECT row, sum(value) AS total FROM q GROUP BY row) SELECT row, "
                            f"col, {r_sql(dig('value') + ' - ' + dig('total'))} AS value FROM q JOIN t USING (row)")
def dirichlet_exp_row(spark, d):
    return _out(mx.dirichlet_expectation(_positive(spark, d), "row"))


@query("dirichlet_exp_col", f"WITH {_POSITIVE}, t AS (SELECT col, sum(value) AS total FROM q GROUP BY col) SELECT row, "
                            f"col, {r_sql(dig('value') + ' - ' + dig('total'))} AS value FROM q JOIN t USING (col)")
def dirichlet_exp_col(spark, d):
    return _out(mx.dirichlet_expectation(_positive(spark, d), "col"))


@query("dirichlet_exp_vec", f"WITH {_POSITIVE}, t AS (SELECT row, sum(value) AS total FROM q GROUP BY row) SELECT row, "
                            f"col, {r_sql(dig('value') + ' - ' + dig('total'))} AS value FROM q JOIN t USING (row)")
def dirichlet_exp_vec(spark, d):
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.abs(x) + F.lit(0.1))
    e = vectors.vec_dirichlet_expectation(F.col("v"))
    return (table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), v.alias("v"))
            .select("row", F.posexplode(e).alias("col", "value")).withColumn("value", rounded("value")))


@query("flip_cumsum",
       f"WITH {MATRIX}, s AS (SELECT row, col, sum(value) OVER (PARTITION BY row ORDER BY col DESC) AS s FROM m) "
       f"SELECT row AS vec, CAST(CASE WHEN col = 0 THEN 63 ELSE 63 - col END AS INTEGER) AS idx, "
       f"CASE WHEN col = 0 THEN 0e0 ELSE {r_sql('s')} END AS value FROM s")
def flip_cumsum(spark, d):
    v = _m(spark, d).select(F.col("row").alias("vec"), F.col("col").alias("idx"), "value")
    return _out(mx.flip_cumsum(v))


_A, _B = "(abs(value) + 0.1e0)", "(value * value + 0.2e0)"


@query("stick_terms",
       f"WITH {MATRIX}, e AS (SELECT row, col, {dig(_A)} - {dig(_A + ' + ' + _B)} AS ea, {dig(_B)} - "
       f"{dig(_A + ' + ' + _B)} AS eb FROM m) SELECT row AS vec, col AS idx, "
       f"{r_sql('ea + sum(CASE WHEN col >= 1 THEN eb ELSE 0e0 END) OVER (PARTITION BY row ORDER BY col)', 5)} AS value FROM e")
def stick_terms(spark, d):
    v = F.col("value")
    pairs = _m(spark, d).select(F.col("row").alias("vec"), F.col("col").alias("idx"),
                                (F.abs(v) + 0.1).alias("a"), (v * v + 0.2).alias("b"))
    return _out(mx.stick_terms(pairs), 5)


@query("lgamma", f"SELECT l_orderkey, l_linenumber, l_partkey, {r_sql('lgamma(l_quantity + l_discount)')} AS value FROM lineitem")
def lgamma(spark, d):
    x = F.col("l_quantity") + F.col("l_discount")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                              rounded(special.lgamma(x)).alias("value"))


@query("digamma", f"SELECT l_orderkey, l_linenumber, l_partkey, {r_sql(dig('(l_quantity + l_discount)'))} AS value FROM lineitem")
def digamma(spark, d):
    x = F.col("l_quantity") + F.col("l_discount")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                              rounded(special.digamma(x)).alias("value"))


@query("vec_lgamma", f"WITH {_POSITIVE} SELECT row, {r_sql('sum(lgamma(value))', 5)} AS value FROM q GROUP BY row")
def vec_lgamma(spark, d):
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.abs(x) + F.lit(0.1))
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("row"), rounded(vectors.vec_sum(vectors.vec_lgamma(v)), 5).alias("value"))
