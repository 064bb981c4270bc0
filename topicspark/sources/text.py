"""Readers of vocabulary, bag-of-words, matrix and vector text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from topicspark.functions.scalars import parse_pairs
from topicspark.operators.corpus import keep_non_blank
from topicspark.operators.indexing import line_index
from topicspark.session import Scratch


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with the file and the split they come from."""
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"))


def read_vocabulary(spark: SparkSession, path: str, scratch: Scratch | None = None) -> DataFrame:
    """`(word_id, term)`: one term per line, the 0-based line number is its word number.  Repeated terms are kept."""
    scratch = scratch or Scratch(spark, "vocabulary")
    return (line_index(_lines(spark, path), "word_id", scratch, "vocabulary_lines")
            .select(F.col("word_id").cast("int").alias("word_id"), F.regexp_replace("value", "\r$", "").alias("term")))


def parse_documents(lines: DataFrame) -> DataFrame:
    """`(..., doc_name, pairs)` from lines `name n_terms id:freq id:freq ...`; the second token is not used."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    return (lines.withColumn("_parts", parts)
            .withColumn("doc_name", F.element_at("_parts", 1))
            .withColumn("pairs", parse_pairs(F.filter(F.slice("_parts", 3, F.greatest(F.size("_parts"), F.lit(3))),
                                                      lambda t: t.contains(":"))))
            .drop("_parts", "value"))


def read_documents(spark: SparkSession, path: str, scratch: Scratch | None = None,
                   drop_blank: bool = True) -> DataFrame:
    """`(doc_id, doc_name, pairs)`; numbers are given after blank lines are dropped."""
    scratch = scratch or Scratch(spark, "documents")
    lines = _lines(spark, path)
    if drop_blank:
        lines = keep_non_blank(lines)
    return (line_index(parse_documents(lines), "doc_id", scratch, "document_lines")
            .select("doc_id", "doc_name", "pairs"))


def bag_of_words(documents: DataFrame, on_duplicate: str = "sum") -> DataFrame:
    """`(doc_id, word_id, freq)` from parsed documents.

    A word number repeated within a document: "sum" adds the frequencies, "last" keeps the last one, "presence" gives
    every distinct word the frequency 1.  Whole documents are shuffled, so a later join on `doc_id` finds the rows in place.
    """
    freq = {"sum": F.sum("freq"), "last": F.max_by("freq", "pos"), "presence": F.lit(1)}[on_duplicate]
    parts = ["word_id", *{"sum": ["freq"], "last": ["freq", "pos"], "presence": []}[on_duplicate]]
    lists = documents.select("doc_id", *[F.col(f"pairs.{c}").alias(c) for c in parts]).repartition("doc_id")
    return (lists.select("doc_id", F.inline(F.arrays_zip(*parts)))
            .groupBy("doc_id", "word_id").agg(freq.cast("int").alias("freq")))


def token_length(documents: DataFrame) -> DataFrame:
    """Document lengths that count every pair, whatever is done about repeated words."""
    total = F.aggregate("pairs", F.lit(0).cast("long"), lambda acc, p: acc + p["freq"])
    return documents.select("doc_id", total.alias("n_tokens"))


def read_matrix(spark: SparkSession, path: str, scratch: Scratch | None = None) -> DataFrame:
    """`(row, col, value)` from lines of space-separated numbers."""
    scratch = scratch or Scratch(spark, "matrix")
    rows = line_index(_lines(spark, path), "row", scratch, "matrix_lines")
    return (rows.select("row", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("col", "value"))
            .withColumn("value", F.col("value").cast("double")))


def read_vector(spark: SparkSession, path: str, scratch: Scratch | None = None) -> DataFrame:
    """`(idx, value)` from a file of one number per line."""
    scratch = scratch or Scratch(spark, "vector")
    return (line_index(_lines(spark, path), "idx", scratch, "vector_lines")
            .select("idx", F.trim("value").cast("double").alias("value")))


def file_row_count(spark: SparkSession, path: str) -> int:
    """Documents in a file; a last line without a line end counts."""
    return spark.read.text(path).count()
