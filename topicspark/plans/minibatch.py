"""Corpus prepared for one-pass training, and the frame shared by the minibatch trainers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from topicspark.functions.random import near_one_array
from topicspark.functions.vectors import elementwise, sum_vectors
from topicspark.operators import blocks
from topicspark.operators.corpus import minibatches, with_position
from topicspark.operators.counts import left_statistics, long_form
from topicspark.operators.kernels import SUMMARY, gamma_rows
from topicspark.session import Scratch

_ROWS_PER_FILE = 1_000_000


@dataclass
class Batches:
    """`docs(doc_id, doc_pos, n_tokens, n_terms, batch_id)` and `bow(doc_id, word_id, freq, batch_id)`, both partitioned by
    `batch_id` so that a training step scans its own files only."""

    docs: DataFrame
    bow: DataFrame
    n_docs: int
    n_tokens: int
    n_batches: int
    n_words: int
    scratch: Scratch


def prepare_batches(bow: DataFrame, n_words: int, batch_size: int, scratch: Scratch,
                    docs: DataFrame | None = None) -> Batches:
    """Place documents in key order and cut them to ceil(D / batch_size) non-empty minibatches.

    `docs(doc_id)` may list documents without any word; by default the documents of `bow`.
    """
    lengths = bow.groupBy("doc_id").agg(F.sum("freq").cast("long").alias("n_tokens"),
                                        F.count(F.lit(1)).alias("n_terms"))
    if docs is not None:
        lengths = (docs.select("doc_id").join(lengths, "doc_id", "left")
                   .select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
                           F.coalesce("n_terms", F.lit(0)).alias("n_terms")))
    placed = scratch.save(minibatches(with_position(lengths, scratch), batch_size), "docs", ["batch_id"])
    size = placed.agg(F.count(F.lit(1)).alias("d"), F.sum("n_tokens").alias("c"), F.sum("n_terms").alias("rows"),
                      F.max("batch_id").alias("b")).first()
    tagged = bow.select("doc_id", "word_id", "freq").join(placed.select("doc_id", "batch_id"), "doc_id")
    files = max(1, (size["rows"] or 0) // (((size["b"] or 0) + 1) * _ROWS_PER_FILE))
    spread = tagged.repartition(F.col("batch_id"), F.pmod(F.xxhash64("doc_id"), F.lit(files)))
    stored = scratch.save(spread, "bow_by_batch", ["batch_id"])
    return Batches(placed, stored, size["d"], size["c"] or 0, (size["b"] or 0) + 1, n_words, scratch)


def alpha_vector(alpha: float | list[float], n_topics: int) -> list[float]:
    """A Dirichlet parameter per topic, from one number or from as many as there are topics."""
    values = [float(alpha)] * n_topics if isinstance(alpha, (int, float)) else [float(a) for a in alpha]
    if len(values) != n_topics:
        raise ValueError(f"{len(values)} values of alpha for {n_topics} topics")
    return values


def start_rows(keys: DataFrame, key: str, n_topics: int, seed: int, init: str) -> DataFrame:
    """`(key, params)`: starting values near 1, by a seeded Gamma sampler or by hash."""
    if init == "hash":
        return keys.select(key, near_one_array(seed, n_topics, key).alias("params"))
    kind = keys.schema[key].dataType.simpleString()
    return keys.select(key).mapInArrow(gamma_rows(n_topics, seed), f"{key} {kind}, params array<double>")


def start_model(words: DataFrame, n_topics: int, seed: int, init: str) -> DataFrame:
    return start_rows(words, "word_id", n_topics, seed, init)


def parameter_totals(model: DataFrame, n_topics: int) -> list[float]:
    """Column sums of the model: one number per topic, the only part of the model that reaches the driver."""
    row = model.agg(sum_vectors("params", n_topics).alias("t")).first()
    return [float(x) for x in row["t"]]


def add_statistics(parts: DataFrame, n_topics: int) -> DataFrame:
    """`(word_id, ss, score, n_tokens)`: block statistics added up per word; the summary row keeps score and size."""
    return parts.groupBy("word_id").agg(sum_vectors("ss", n_topics).alias("ss"), F.sum("score").alias("score"),
                                        F.sum("n_tokens").alias("n_tokens"))


def only_words(stats: DataFrame) -> DataFrame:
    """`(word_id, ss)` without the summary row."""
    return stats.where(F.col("word_id") != SUMMARY).select("word_id", "ss")


def summary(stats: DataFrame):
    """`score` and `n_tokens` of the whole minibatch."""
    return stats.where(F.col("word_id") == SUMMARY).select("score", "n_tokens").first()


def blend_model(model: DataFrame, stats: DataFrame, n_topics: int, rho: float, scale: float,
                prior: float = 0.0) -> DataFrame:
    """params <- (1 - rho) * params + rho * (prior + scale * statistics); untouched words still decay."""
    keep, new, start = F.lit(1.0 - rho), F.lit(rho), F.lit(prior)

    def blended(k):
        found = F.coalesce(F.col("ss")[k], F.lit(0.0))
        return keep * F.col("params")[k] + new * (start + F.lit(scale) * found)

    return left_statistics(model, stats).select("word_id", elementwise(n_topics, blended).alias("params"))


def run_on_blocks(bow: DataFrame, model: DataFrame, kernel, n_blocks: int, schema: str) -> DataFrame:
    """Spread documents over blocks, pull the parameter rows in use and run the kernel."""
    rows = blocks.assign_blocks(bow, n_blocks)
    return blocks.run_blocks(rows, blocks.pull(blocks.block_words(rows), model), n_blocks, kernel, schema)


def metrics_frame(spark, run: str, rows: list[tuple[int, str, float]]) -> DataFrame:
    """`(run, t, kind, value)`: a few rows per training step."""
    return spark.createDataFrame([(run, int(t), kind, float(v)) for t, kind, v in rows],
                                 "run string, t int, kind string, value double")


def check_run(scratch: Scratch, *settings) -> None:
    """Stores the settings of a run with its first step; a run that is continued must have the same ones."""
    text = repr(settings)
    if not scratch.exists("settings"):
        scratch.save(scratch.spark.createDataFrame([(text,)], "settings string"), "settings")
    elif (was := scratch.load("settings").first()["settings"]) != text:
        raise ValueError(f"{scratch.base} was begun with {was}, not with {text}")


class Metrics:
    """Metric rows of a run, one small table per step, so that a run that is continued still has those of earlier steps."""

    def __init__(self, scratch: Scratch):
        self.scratch = scratch

    def save(self, t: int, rows: list[tuple[int, str, float]]) -> None:
        if rows:
            self.scratch.save(metrics_frame(self.scratch.spark, self.scratch.base, rows).coalesce(1), f"metrics/t={t:06d}")

    def all(self, before: int) -> list[tuple[int, str, float]]:
        """Rows of the steps before `before`: a handful per step."""
        found = []
        for name in self.scratch.children("metrics"):
            if int(name.split("=")[1]) < before:
                found += [(r["t"], r["kind"], r["value"]) for r in self.scratch.load(f"metrics/{name}").collect()]
        return sorted(found)


class Versions:
    """Model versions `model/t=<n>` of one run.

    A version is usable once its write has committed.  Keeping two of them is enough to continue after a failure; all
    are kept when the run is asked for its snapshots.
    """

    def __init__(self, scratch: Scratch, keep_all: bool):
        self.scratch, self.keep_all = scratch, keep_all

    @staticmethod
    def _name(t: int) -> str:
        return f"model/t={t:06d}"

    def latest(self) -> int | None:
        done = [c for c in self.scratch.children("model") if self.scratch.exists(f"model/{c}/_SUCCESS")]
        return int(done[-1].split("=")[1]) if done else None

    def load(self, t: int) -> DataFrame:
        return self.scratch.load(self._name(t), "word_id int, params array<double>")

    def save(self, model: DataFrame, t: int) -> DataFrame:
        saved = self.scratch.save(model, self._name(t))
        if not self.keep_all and t >= 2:
            self.scratch.drop(self._name(t - 2))
        return saved


def topic_words(model: DataFrame) -> DataFrame:
    """`(topic, word_id, value)` for ranking and export."""
    return long_form(model, "params")

