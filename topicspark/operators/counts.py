"""Count tables of a topic assignment and the joins that bring parameters to words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from topicspark.functions.random import uniform_topic
from topicspark.functions.vectors import sum_vectors
from topicspark.operators.corpus import expand_tokens


def assign_uniform(bow: DataFrame, n_topics: int, seed: int, portable: bool = True) -> DataFrame:
    """`(doc_id, word_id, occ, topic)`: a uniform topic for every token."""
    topic = uniform_topic(seed, n_topics, "doc_id", "word_id", "occ", portable=portable)
    return expand_tokens(bow).withColumn("topic", topic)


def doc_topic_counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("doc_id", "topic").agg(F.count(F.lit(1)).alias("n"))


def topic_word_counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("topic", "word_id").agg(F.count(F.lit(1)).alias("n"))


def topic_totals(topic_word: DataFrame) -> DataFrame:
    return topic_word.groupBy("topic").agg(F.sum("n").alias("n"))


def topic_count_in_docs(assigned: DataFrame, topic: int) -> DataFrame:
    """Occurrences of one topic in each document, 0 included."""
    return assigned.groupBy("doc_id").agg(F.count_if(F.col("topic") == topic).alias("n"))


def merge_sparse_rows(*parts: DataFrame) -> DataFrame:
    """Add up sparse `(topic, word_id, value)` rows; the partial aggregate is the map-side combiner."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("topic", "word_id").agg(F.sum("value").alias("value"))


def merge_scores(scores: DataFrame) -> DataFrame:
    """Add up `(score, n_tokens)` rows."""
    return scores.agg(F.sum("score").alias("score"), F.sum("n_tokens").alias("n_tokens"))


def block_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """`(topic, word_id, value)`: local minus global counts, from each token's old and new topic."""
    gone = before.select("topic", "word_id", F.lit(-1).alias("value"))
    come = after.select("topic", "word_id", F.lit(1).alias("value"))
    return merge_sparse_rows(gone, come).where(F.col("value") != 0)


def apply_deltas(topic_word: DataFrame, deltas: DataFrame) -> DataFrame:
    """Global counts plus the summed block deltas."""
    current = topic_word.select("topic", "word_id", F.col("n").alias("value"))
    return (merge_sparse_rows(current, deltas.select("topic", "word_id", "value"))
            .where(F.col("value") != 0)
            .select("topic", "word_id", F.col("value").alias("n")))


def join_words(bow: DataFrame, params: DataFrame) -> DataFrame:
    """Bring the parameter row of each word to the documents that use it.  Never hinted: parameters grow with V."""
    return bow.join(params, "word_id")


def left_statistics(model: DataFrame, stats: DataFrame) -> DataFrame:
    """Model rows with their sufficient statistics; null where the batch did not touch the word."""
    return model.join(stats, "word_id", "left")


def sum_by_word(rows: DataFrame, col: str, n_topics: int) -> DataFrame:
    """`(word_id, col)`: element-wise sums of topic arrays."""
    return rows.groupBy("word_id").agg(sum_vectors(col, n_topics).alias(col))


def long_form(model: DataFrame, col: str) -> DataFrame:
    """`(topic, word_id, value)` from a topic array per word."""
    return model.select("word_id", F.posexplode(col).alias("topic", "value")).select("topic", "word_id", "value")


def array_form(cells: DataFrame, n_topics: int, value: str = "value") -> DataFrame:
    """`(word_id, values)` from long cells: a pivot with one conditional sum per topic."""
    sums = [F.sum(F.when(F.col("topic") == k, F.col(value).cast("double")).otherwise(F.lit(0.0)))
            for k in range(n_topics)]
    return cells.groupBy("word_id").agg(F.array(*sums).alias("values"))
