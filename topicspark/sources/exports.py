"""Text exports of matrices, rankings and document topics.

Files are written by Spark in row order over several part files; a header, where there is one, is a row of the first part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from topicspark.functions.vectors import array_to_line
from topicspark.operators.matrix import to_arrays


def matrix_lines(m: DataFrame, n_cols: int, integer: bool = False, rows: DataFrame | None = None) -> DataFrame:
    """`(row, line)`: the values of a row joined by commas, absent cells as 0.

    With `rows(row)` every listed row has a line, so that the number of a line names its row; without it, rows with cells.
    A line has `n_cols` values: with one column per topic it is short, whatever the corpus.
    """
    values = F.col("values").cast("array<bigint>") if integer else F.col("values")
    full = to_arrays(m, n_cols)
    if rows is not None:
        full = rows.select("row").join(full, "row", "left").withColumn(
            "values", F.coalesce("values", F.array_repeat(F.lit(0.0), n_cols)))
    return full.select("row", array_to_line(values).alias("line"))


def _write_rows(lines: DataFrame, path: str) -> None:
    """Row order is kept by a range partitioning on the row number."""
    lines.repartitionByRange("row").sortWithinPartitions("row").select("line").write.mode("overwrite").text(path)


def write_matrix_csv(m: DataFrame, n_cols: int, path: str, integer: bool = False, rows: DataFrame | None = None) -> None:
    _write_rows(matrix_lines(m, n_cols, integer, rows), path)


def labelled_lines(m: DataFrame, labels: DataFrame, n_cols: int, integer: bool = True, rows: DataFrame | None = None) -> DataFrame:
    """As `matrix_lines`, each line starting with the quoted label of its row (`labels(row, label)`).

    With `rows=labels` every labelled row has a line, also one without cells.
    """
    return (matrix_lines(m, n_cols, integer, rows).join(labels, "row")
            .select("row", F.concat(F.lit('"'), "label", F.lit('",'), "line").alias("line")))


def write_labelled_csv(m: DataFrame, labels: DataFrame, n_cols: int, path: str, rows: DataFrame | None = None) -> None:
    _write_rows(labelled_lines(m, labels, n_cols, rows=rows), path)


def ranking_file_lines(wide: DataFrame, n_topics: int) -> DataFrame:
    """`(row, line)` of the wide ranking: a header `Topic 0,Topic 1,...,`, then the words of each rank."""
    columns = [F.coalesce(F.col(f"topic_{k}"), F.lit("")) for k in range(n_topics)]
    body = wide.select(F.col("rank").cast("long").alias("row"), F.concat(F.concat_ws(",", *columns), F.lit(",")).alias("line"))
    header = wide.sparkSession.createDataFrame([(0, "".join(f"Topic {k}," for k in range(n_topics)))],
                                               "row long, line string")
    return header.unionByName(body)


def write_ranking_file(wide: DataFrame, n_topics: int, path: str) -> None:
    _write_rows(ranking_file_lines(wide, n_topics), path)


def topic_row_lines(rows: DataFrame) -> DataFrame:
    """`(row, line)`: `k,w1,w2,...` per topic."""
    return rows.select(F.col("topic").cast("long").alias("row"),
                       F.concat_ws(",", F.col("topic").cast("string"), "words").alias("line"))


def write_topic_rows(rows: DataFrame, path: str) -> None:
    _write_rows(topic_row_lines(rows), path)


def write_doc_topics(docs: DataFrame, path: str) -> None:
    """One line of K numbers per document, in document order."""
    _write_rows(docs.select(F.col("doc_id").alias("row"), array_to_line(F.col("theta")).alias("line")), path)


def write_hyper_parameters(spark, alpha: list[float], beta: float, path: str) -> None:
    """Two lines: alpha and beta."""
    lines = spark.createDataFrame([(0, ",".join(map(str, alpha))), (1, str(beta))], "row long, line string")
    lines.coalesce(1).sortWithinPartitions("row").select("line").write.mode("overwrite").text(path)
