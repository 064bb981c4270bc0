"""Top words of each topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

_TWO_STAGE_FROM = 1000  # up to this n Spark itself limits each group before the shuffle
_SALTS = 64
MAX_BROADCAST_ROWS = 1_000_000


def top_n(cells: DataFrame, n: int, group: str = "topic", item: str = "word_id", value: str = "value") -> DataFrame:
    """The `n` largest values of each group, ties by lower item; fewer when the group has fewer.  Adds `rank` (1..n).

    There are few topics and many words, so a group must not travel whole: for usual n Spark limits each group inside
    the map tasks; for large n the groups are first limited within salted parts.
    """
    order = [F.desc(value), F.asc(item)]
    if n > _TWO_STAGE_FROM:
        part = Window.partitionBy(group, "_salt").orderBy(*order)
        cells = (cells.withColumn("_salt", F.pmod(F.xxhash64(item), F.lit(_SALTS)))
                 .withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= n).drop("_r", "_salt"))
    ranked = cells.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def top_terms(cells: DataFrame, vocab: DataFrame, n: int, n_topics: int | None = None) -> DataFrame:
    """`(topic, rank, word_id, term, value)`.

    The ranked list has at most topics x n rows whatever the data.  Where `n_topics` proves that to be few it is broadcast;
    otherwise the kind of join is the optimizer's choice.  The vocabulary is never broadcast by a hint.
    """
    top = top_n(cells, n).select("topic", "rank", "word_id", "value")
    if n_topics is not None and n_topics * n <= MAX_BROADCAST_ROWS:
        top = F.broadcast(top)
    return (vocab.select("word_id", "term").join(top, "word_id")
            .select("topic", "rank", "word_id", "term", "value"))


def topic_rows(terms: DataFrame) -> DataFrame:
    """`(topic, words)`: the ranked terms of a topic in one comma-separated string."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "term")))
    return (terms.groupBy("topic").agg(ordered.alias("_t"))
            .select("topic", F.array_join(F.col("_t.term"), ",").alias("words")))


def topic_columns(terms: DataFrame, n_topics: int) -> DataFrame:
    """`(rank, topic_0, topic_1, ...)`: one row per rank."""
    wide = terms.groupBy("rank").pivot("topic", list(range(n_topics))).agg(F.first("term"))
    return wide.select("rank", *[F.col(str(k)).alias(f"topic_{k}") for k in range(n_topics)])
