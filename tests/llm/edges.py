"""Rows that every operator must take: missing and empty texts, a very long one, repeated rows, clashing column names."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, id string, h string, key string, row string, "
          "registers string, spans string, path string, blob string, _stats string, text_hash string, anchor string, unit string")
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(20_000))
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, LONG), (6, "a same line of text\n" * 40), (6, "a same line of text\n" * 40),
    (7, "password = 'abcdef0123456789abcdef' and more"), (8, "ünïcödé " * 30), (9, "x" * 500), (None, "no id " * 20), (None, None),
    (10, "MIT License\nApache License\nthe CC BY"), (11, "a b c d e"), (12, "a b c d e"), (13, "日本語 😀 text"),
]


def edge_docs(spark: SparkSession, texts=TEXTS) -> DataFrame:
    return spark.createDataFrame([(i, t, "en", "s", None, *["x"] * 12) for i, t in texts], SCHEMA)


def rows_by(df: DataFrame, *names: str) -> list[tuple]:
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
