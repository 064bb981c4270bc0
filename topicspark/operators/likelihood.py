"""Log-likelihood of a topic assignment and the fixed-point steps of its Dirichlet parameters.

Count tables hold only non-zero cells.  Zero cells are handled in closed form: each sum below is written as a
difference that is 0 for a zero count, so no dense topic x word or document x topic grid is ever made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from topicspark.functions.special import digamma, lgamma
from topicspark.session import Scratch


def topic_loglik(topic_word: DataFrame, n_words: int, beta: float) -> DataFrame:
    """`(topic, loglik)` for topics that have tokens (an empty topic contributes exactly 0)."""
    b, vb = F.lit(float(beta)), F.lit(float(n_words * beta))
    per_topic = topic_word.groupBy("topic").agg(
        F.sum(lgamma(F.col("n") + b) - lgamma(b)).alias("_cells"), F.sum("n").alias("_n"))
    return per_topic.select("topic", (lgamma(vb) - lgamma(F.col("_n") + vb) + F.col("_cells")).alias("loglik"))


def doc_loglik(doc_topic: DataFrame, alpha: list[float]) -> DataFrame:
    """`(doc_id, loglik)`; `alpha` has one number per topic."""
    a = _alpha_of_topic(alpha)
    total = F.lit(float(sum(alpha)))
    per_doc = doc_topic.groupBy("doc_id").agg(
        F.sum(lgamma(F.col("n") + a) - lgamma(a)).alias("_cells"), F.sum("n").alias("_n"))
    return per_doc.select("doc_id", (lgamma(total) - lgamma(F.col("_n") + total) + F.col("_cells")).alias("loglik"))


def _alpha_of_topic(alpha):
    if len(set(alpha)) == 1:
        return F.lit(float(alpha[0]))
    return F.element_at(F.array(*[F.lit(float(a)) for a in alpha]), (F.col("topic") + 1).cast("int"))


def total_loglik(topic_word: DataFrame, doc_topic: DataFrame, n_words: int, alpha: list[float], beta: float) -> DataFrame:
    """One row `(loglik)`: topic part plus document part."""
    parts = topic_loglik(topic_word, n_words, beta).select("loglik").unionByName(
        doc_loglik(doc_topic, alpha).select("loglik"))
    return parts.agg(F.sum("loglik").alias("loglik"))


def counts_of_counts(cells: DataFrame, scratch: Scratch, name: str, whole: str) -> tuple[DataFrame, DataFrame]:
    """What the steps need of a count table: `(topic, n, times)`, how many cells of a topic hold n, and `(n, times)`, how many
    of the `whole`s (documents, topics) hold n in all.  A corpus of N tokens has at most about sqrt(2 N) different counts for a
    topic, so any number of steps reads two small tables."""
    of_cells = cells.groupBy("topic", "n").agg(F.count(F.lit(1)).alias("times"))
    of_sums = cells.groupBy(whole).agg(F.sum("n").alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("times"))
    return scratch.save(of_cells, f"{name}_cells"), scratch.save(of_sums, f"{name}_sums")


def _fixed_point(step, start, n_steps: int, tol: float):
    """Steps until the largest relative change is below `tol`, at most `n_steps`."""
    now = start
    for _ in range(n_steps):
        before, now = now, step(now)
        if min(now) <= 0:
            raise ValueError("a Dirichlet parameter is no longer positive")
        if max(abs(a - b) / b for a, b in zip(now, before)) < tol:
            break
    return now


def alpha_steps(doc_topic: DataFrame, alpha: list[float], n_steps: int, scratch: Scratch, tol: float = 0.0) -> list[float]:
    """Alpha after up to `n_steps` fixed-point steps, from one pass over the document-topic counts.

    A topic without tokens has a parameter of 0 after one step, which is no longer positive.
    """
    cells, sums = counts_of_counts(doc_topic, scratch, "alpha", "doc_id")

    def step(now):
        a, total = _alpha_of_topic(now), F.lit(float(sum(now)))
        num = cells.groupBy("topic").agg(F.sum(F.col("times") * (digamma(F.col("n") + a) - digamma(a))).alias("num")).collect()
        den = sums.agg(F.sum(F.col("times") * (digamma(F.col("n") + total) - digamma(total)))).first()[0]
        found = {r["topic"]: r["num"] for r in num}                                     # one row per topic
        return [x * found.get(k, 0.0) / den for k, x in enumerate(now)]

    return _fixed_point(step, [float(a) for a in alpha], n_steps, tol)


def beta_steps(topic_word: DataFrame, n_words: int, beta: float, n_steps: int, scratch: Scratch, tol: float = 0.0) -> float:
    """Beta after up to `n_steps` fixed-point steps, from one pass over the topic-word counts."""
    cells, sums = counts_of_counts(topic_word, scratch, "beta", "topic")

    def step(now):
        b, vb = F.lit(now[0]), F.lit(n_words * now[0])
        num = cells.agg(F.sum(F.col("times") * (digamma(F.col("n") + b) - digamma(b)))).first()[0]
        den = sums.agg(F.sum(F.col("times") * (digamma(F.col("n") + vb) - digamma(vb)))).first()[0]
        return [now[0] * num / (n_words * den)]

    return _fixed_point(step, [float(beta)], n_steps, tol)[0]


def alpha_step(doc_topic: DataFrame, alpha: list[float]) -> DataFrame:
    """`(topic, alpha)` after one fixed-point step, the sum of alpha held at its old value during the step."""
    n_topics, total = len(alpha), F.lit(float(sum(alpha)))
    a = _alpha_of_topic(alpha)
    num = doc_topic.groupBy("topic").agg(F.sum(digamma(F.col("n") + a) - digamma(a)).alias("_num"))
    den = (doc_topic.groupBy("doc_id").agg(F.sum("n").alias("_n"))
           .agg(F.sum(digamma(F.col("_n") + total) - digamma(total)).alias("_den"))).first()["_den"]    # one number
    topics = doc_topic.sparkSession.range(n_topics).select(F.col("id").cast("int").alias("topic"))
    return (topics.join(num, "topic", "left")
            .select("topic", (a * F.coalesce("_num", F.lit(0.0)) / F.lit(den)).alias("alpha")))


def beta_step(topic_word: DataFrame, n_words: int, beta: float) -> DataFrame:
    """One row `(beta)` after one fixed-point step."""
    b, vb = F.lit(float(beta)), F.lit(float(n_words * beta))
    per_topic = topic_word.groupBy("topic").agg(
        F.sum(digamma(F.col("n") + b) - digamma(b)).alias("_num"), F.sum("n").alias("_n"))
    return per_topic.agg(
        (b * F.sum("_num") / (F.lit(float(n_words)) * F.sum(digamma(F.col("_n") + vb) - digamma(vb)))).alias("beta"))
