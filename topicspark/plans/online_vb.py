"""Online variational Bayes: E-step on a minibatch, bound, blend of the parameters, repeat."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from topicspark.functions.scalars import learning_rate
from topicspark.functions.special import digamma, lgamma, np_digamma
from topicspark.functions.vectors import (TINY, literal_vector, sum_vectors, vec_dirichlet_expectation, vec_l1,
                                          vec_logsumexp, vec_mul, vec_sum, vec_lgamma)
from topicspark.operators import blocks
from topicspark.operators.counts import long_form, sum_by_word
from topicspark.operators.kernels import DOC_SCHEMA, SUMMARY, WORD_SCHEMA, expectation_rows, vb_kernel
from topicspark.plans.minibatch import (Batches, Metrics, Versions, add_statistics, alpha_vector, blend_model, check_run, metrics_frame, only_words,
                                        parameter_totals, run_on_blocks, start_model, start_rows, summary)
from topicspark.session import Scratch


@dataclass
class OnlineVB:
    """Settings; the defaults are those of the published single-process trainer."""

    n_topics: int
    alpha: float | list[float] = 0.01    # one number, or one per topic
    eta: float = 0.01
    tau0: float = 1025.0
    kappa: float = 0.7
    max_iter: int = 100
    tol: float = 1e-3
    seed: int = 1
    init: str = "gamma"
    tokens_per_block: int | None = None
    max_doc_terms: int = 200_000     # documents with more distinct words take the same E-step written as joins
    bound: bool = True               # perplexity needs a pass over all parameters per step

    @property
    def alpha_vec(self) -> list[float]:
        return alpha_vector(self.alpha, self.n_topics)


@dataclass
class Fit:
    model: DataFrame
    metrics: DataFrame
    n_steps: int
    base: str
    history: list = field(default_factory=list)


def log_expectation(model: DataFrame, totals: list[float]) -> DataFrame:
    """`(word_id, elog)`: psi(lambda) - psi(topic total).

    One generated expression per topic would outgrow a Java method at some fifty topics.
    """
    return model.select("word_id", "params").mapInArrow(expectation_rows(totals), "word_id int, elog array<double>")


def joined_e_step(bow: DataFrame, elog: DataFrame, start: DataFrame, alpha: list[float], max_iter: int, tol: float,
                  scratch: Scratch, label: str) -> tuple[DataFrame, DataFrame]:
    """The E-step as joins and aggregates: any document, however long, is spread over all tasks.

    `start(doc_id, gamma)`.  Gives `(word_id, ss)` and `(doc_id, vec, score, n_tokens)`.  Used for documents too long
    for one kernel call, and as the plain definition that the kernel is tested against.
    """
    k = len(alpha)
    alpha_col = literal_vector(alpha)
    # the largest value of a word is taken out before exp, as in the kernel
    joined = bow.select("doc_id", "word_id", "freq").join(elog, "word_id").withColumn("top", F.array_max("elog"))
    words = scratch.save(joined, f"{label}/words")

    def weighted(gammas):
        """(doc_id, word_id, freq, elog, theta, nphi)"""
        mean = gammas.select("doc_id", vec_dirichlet_expectation(F.col("gamma")).alias("theta"))
        raw = words.join(mean, "doc_id").withColumn(
            "raw", F.zip_with("elog", "theta", lambda a, b: F.exp(a - F.col("top") + b)))
        norm = F.col("freq") / (vec_sum(F.col("raw")) + F.lit(TINY))
        return raw.withColumn("_norm", norm).withColumn("nphi", F.transform("raw", lambda x: x * F.col("_norm")))

    state = scratch.save(start.select("doc_id", "gamma", F.col("gamma").alias("before"), F.lit(True).alias("active")),
                         f"{label}/state-0")
    for step in range(max_iter):
        moving = state.where("active").select("doc_id", "gamma")
        sums = weighted(moving).groupBy("doc_id").agg(sum_vectors("nphi", k).alias("_s"))
        fresh = (moving.join(sums, "doc_id", "left")
                 .withColumn("_new", F.when(F.col("_s").isNull(), alpha_col)
                             .otherwise(F.zip_with("_s", alpha_col, lambda a, b: a + b)))
                 .select("doc_id", F.col("_new").alias("gamma"), F.col("gamma").alias("before"),
                         (vec_l1(F.col("_new"), F.col("gamma")) / k >= tol).alias("active")))
        state = scratch.save(fresh.unionByName(state.where(~F.col("active"))), f"{label}/state-{step + 1}")
        if step >= 2:
            scratch.drop(f"{label}/state-{step - 2}")
        if step + 1 < max_iter and state.where("active").limit(1).count() == 0:
            break

    ss = sum_by_word(weighted(state.select("doc_id", F.col("before").alias("gamma"))).select(
        "word_id", F.col("nphi").alias("ss")), "ss", k)
    final = state.select("doc_id", "gamma")
    likelihood = (words.join(final.select("doc_id", vec_dirichlet_expectation(F.col("gamma")).alias("theta")), "doc_id")
                  .select("doc_id", "freq", vec_logsumexp(
                      F.zip_with("elog", "theta", lambda a, b: a + b)).alias("lse"))
                  .groupBy("doc_id").agg(F.sum(F.col("freq") * F.col("lse")).alias("_w"),
                                         F.sum("freq").cast("long").alias("n_tokens")))
    theta = vec_dirichlet_expectation(F.col("gamma"))
    prior = (vec_sum(vec_mul(F.zip_with(alpha_col, F.col("gamma"), lambda a, g: a - g), theta))
             + vec_sum(F.zip_with(vec_lgamma(F.col("gamma")), vec_lgamma(alpha_col), lambda a, b: a - b))
             + lgamma(F.lit(float(sum(alpha)))) - lgamma(vec_sum(F.col("gamma"))))
    docs = (final.withColumn("_prior", prior).join(likelihood, "doc_id", "left")
            .select("doc_id", F.col("gamma").alias("vec"),
                    (F.col("_prior") + F.coalesce("_w", F.lit(0.0))).alias("score"),
                    F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")))
    return ss, docs


def _e_step(bow: DataFrame, model: DataFrame, totals: list[float], cfg: OnlineVB, scratch: Scratch, label: str,
            lengths: DataFrame | None, n_tokens: int | None, per_document: bool):
    """Kernel rows of the ordinary documents, and the joined E-step of the huge ones (None if there are none)."""
    if lengths is None:
        lengths = bow.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("freq").alias("n_tokens"))
    if n_tokens is None:
        n_tokens = lengths.agg(F.sum("n_tokens")).first()[0] or 0
    k = cfg.n_topics
    huge = lengths.where(F.col("n_terms") > cfg.max_doc_terms).select("doc_id")
    has_huge = len(huge.take(1)) > 0
    usual = bow.join(huge, "doc_id", "left_anti") if has_huge else bow
    kernel = vb_kernel(k, cfg.alpha_vec, totals, cfg.seed, cfg.init, cfg.max_iter, cfg.tol, per_document)
    n_blocks = blocks.block_count(n_tokens, k, cfg.tokens_per_block)
    rows = run_on_blocks(usual, model, kernel, n_blocks, DOC_SCHEMA if per_document else WORD_SCHEMA)
    if not has_huge:
        return rows, None
    start = start_rows(huge, "doc_id", k, cfg.seed, cfg.init).withColumnRenamed("params", "gamma")
    return rows, joined_e_step(bow.join(huge, "doc_id"), log_expectation(model, totals), start, cfg.alpha_vec,
                               cfg.max_iter, cfg.tol, scratch, f"{label}/joined")


def word_statistics(bow: DataFrame, model: DataFrame, totals: list[float], cfg: OnlineVB, scratch: Scratch, label: str,
                    lengths: DataFrame | None = None, n_tokens: int | None = None) -> DataFrame:
    """E-step of `bow(doc_id, word_id, freq)` as `(word_id, ss, score, n_tokens)` with a summary row.

    Ordinary documents go to the block kernel; documents with more than `max_doc_terms` words to the joined form.
    """
    rows, joined = _e_step(bow, model, totals, cfg, scratch, label, lengths, n_tokens, per_document=False)
    if joined is not None:
        ss, docs = joined
        rows = (rows.unionByName(ss.withColumn("score", F.lit(0.0)).withColumn("n_tokens", F.lit(0).cast("long")))
                .unionByName(docs.agg(F.sum("score").alias("score"), F.sum("n_tokens").alias("n_tokens"))
                             .withColumn("word_id", F.lit(SUMMARY)).withColumn("ss", literal_vector([0.0] * cfg.n_topics))))
    return scratch.save(add_statistics(rows, cfg.n_topics), f"{label}/statistics")


def document_posteriors(bow: DataFrame, model: DataFrame, totals: list[float], cfg: OnlineVB, scratch: Scratch,
                        label: str, lengths: DataFrame | None = None, n_tokens: int | None = None) -> DataFrame:
    """The same E-step as `(doc_id, vec, score, n_tokens)`: gamma, share of the bound and size of every document."""
    rows, joined = _e_step(bow, model, totals, cfg, scratch, label, lengths, n_tokens, per_document=True)
    return rows if joined is None else rows.unionByName(joined[1])


def bound_cells(model: DataFrame, eta: float) -> DataFrame:
    """`(topic, total, cells)`: the parameter part of the bound, apart from terms in the topic totals.

    sum (eta - l) * (psi(l) - psi(T)) = sum (eta - l) * psi(l) - psi(T) * (eta * V - T), so one pass gives everything.
    """
    e = F.lit(float(eta))
    cell = (e - F.col("value")) * digamma(F.col("value")) + lgamma(F.col("value")) - lgamma(e)
    return (long_form(model, "params").groupBy("topic")
            .agg(F.sum("value").alias("total"), F.sum(cell).alias("cells")))


def perplexity(score: float, n_tokens: float, batch_docs: int, n_docs: int, cells: list, n_words: int,
               eta: float) -> float:
    """exp(-bound per word) of a minibatch; `cells` are the rows of `bound_cells` for the model before the update."""
    bound = score * n_docs / batch_docs
    for row in cells:
        bound += row["cells"] - float(np_digamma(row["total"])) * (eta * n_words - row["total"])
        bound += math.lgamma(eta * n_words) - math.lgamma(row["total"])
    return math.exp(-bound * batch_docs / (n_docs * n_tokens))


def update(batch_bow: DataFrame, lengths: DataFrame, model: DataFrame, t: int, n_docs: int, n_words: int,
           cfg: OnlineVB, scratch: Scratch) -> tuple[DataFrame, list]:
    """One training step: the (lazy) next model and metric rows.  `lengths(doc_id, n_tokens, n_terms)` lists all
    documents of the minibatch, also empty ones."""
    size = lengths.agg(F.count(F.lit(1)).alias("d"), F.sum("n_tokens").alias("c")).first()
    cells = bound_cells(model, cfg.eta).collect() if cfg.bound else None     # one row per topic
    totals = ([r["total"] for r in sorted(cells, key=lambda r: r["topic"])] if cells
              else parameter_totals(model, cfg.n_topics))
    stats = word_statistics(batch_bow, model, totals, cfg, scratch, f"estep-{t:06d}", lengths, size["c"] or 0)
    rows = []
    if cells:
        got = summary(stats)
        if got and got["n_tokens"]:
            rows.append((t, "perplexity", perplexity(got["score"], got["n_tokens"], size["d"], n_docs, cells, n_words,
                                                     cfg.eta)))
    rho = learning_rate(t, 1.0, cfg.tau0, cfg.kappa)
    return blend_model(model, only_words(stats), cfg.n_topics, rho, n_docs / size["d"], cfg.eta), rows


def fit(batches: Batches, words: DataFrame, cfg: OnlineVB, snapshots: str | None = None) -> Fit:
    """One pass over the minibatches in order.

    With `snapshots` every model version is kept below that folder and a later call continues after the last one that
    was completely written; without it only the two newest versions exist at any time.
    """
    scratch = Scratch(batches.bow.sparkSession, "online-vb", base=snapshots)
    versions = Versions(scratch, keep_all=snapshots is not None)
    if snapshots is not None:
        check_run(scratch, cfg, batches.n_docs, batches.n_words)
    done = versions.latest()
    if done is None:
        done = 0
        versions.save(start_model(words, cfg.n_topics, cfg.seed, cfg.init), 0)
    metrics = Metrics(scratch)
    model, history = versions.load(done), metrics.all(done)
    for t in range(done, batches.n_batches):
        here = F.col("batch_id") == t
        nxt, rows = update(batches.bow.where(here).drop("batch_id"), batches.docs.where(here), model, t,
                           batches.n_docs, batches.n_words, cfg, scratch)
        metrics.save(t, rows)
        model = versions.save(nxt, t + 1)
        scratch.drop(f"estep-{t:06d}")
        history += rows
    return Fit(model, metrics_frame(batches.bow.sparkSession, scratch.base, history), batches.n_batches, scratch.base, history)
