"""Stochastic collapsed variational Bayes (zero-order) on minibatches."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from topicspark.functions.scalars import learning_rate
from topicspark.operators import blocks
from topicspark.operators.kernels import DOC_SCHEMA, WORD_SCHEMA, scvb0_kernel
from topicspark.plans.minibatch import (Batches, Metrics, Versions, add_statistics, alpha_vector, blend_model, check_run, metrics_frame,
                                        only_words, parameter_totals, run_on_blocks, start_model, summary)
from topicspark.plans.online_vb import Fit
from topicspark.session import Scratch


@dataclass
class SCVB0:
    n_topics: int
    alpha: float | list[float] = 0.01                    # one number, or one per topic
    beta: float = 0.01
    max_iter: int = 5                                    # burn-in passes before the counted pass
    theta_rate: tuple = (10.0, 1000.0, 0.9)              # scale, tau0, kappa
    global_rate: tuple = (1.0, 10.0, 0.9)
    seed: int = 1
    init: str = "gamma"
    tokens_per_block: int | None = None

    @property
    def alpha_vec(self) -> list[float]:
        return alpha_vector(self.alpha, self.n_topics)


def document_pass(bow: DataFrame, model: DataFrame, totals: list[float], n_words: int, cfg: SCVB0,
                  n_tokens: int, per_document: bool = False) -> DataFrame:
    """Pass over `bow(doc_id, word_id, freq)`: `(word_id, ss, score, n_tokens)` with a summary row, or with
    `per_document` the N_theta of each document as `(doc_id, vec, score, n_tokens)`.

    The tokens of a document are visited in ascending word order, however many there are; a kernel holds a document's
    distinct words, not its tokens.
    """
    rows = bow.where(F.col("freq") > 0)
    kernel = scvb0_kernel(cfg.n_topics, cfg.alpha_vec, cfg.beta, n_words, totals, cfg.seed, cfg.init, cfg.max_iter,
                          cfg.theta_rate, per_document)
    n_blocks = blocks.block_count(n_tokens, cfg.n_topics, cfg.tokens_per_block)
    if not per_document:
        return add_statistics(run_on_blocks(rows, model, kernel, n_blocks, WORD_SCHEMA), cfg.n_topics)
    return run_on_blocks(rows, model, kernel, n_blocks, DOC_SCHEMA)


def update(batch_bow: DataFrame, lengths: DataFrame, model: DataFrame, t: int, corpus_tokens: int, n_words: int,
           cfg: SCVB0, scratch: Scratch) -> tuple[DataFrame, list]:
    """One training step: the (lazy) next model, N <- (1 - rho) N + rho * (C / C_batch) * statistics, and metric rows.

    Topic totals are the model's column sums.  `loglik` is that of the minibatch's tokens under the documents' N_theta and the
    model before the step, so a minibatch is judged by a model that has not seen it; `perplexity` is exp(-loglik per token).
    """
    n_tokens = lengths.agg(F.sum("n_tokens")).first()[0] or 0
    rho = learning_rate(t, *cfg.global_rate)
    totals = parameter_totals(model, cfg.n_topics)
    stats = scratch.save(document_pass(batch_bow, model, totals, n_words, cfg, n_tokens), f"pass-{t:06d}")
    rows, got = [(t, "rho", rho)], summary(stats)
    if got and got["n_tokens"]:
        rows = [(t, "loglik", got["score"]), (t, "perplexity", math.exp(-got["score"] / got["n_tokens"])), *rows]
    return blend_model(model, only_words(stats), cfg.n_topics, rho, corpus_tokens / n_tokens if n_tokens else 0.0), rows


def fit(batches: Batches, words: DataFrame, cfg: SCVB0, snapshots: str | None = None,
        corpus_tokens: int | None = None) -> Fit:
    """One pass over the minibatches; `corpus_tokens` may be an estimate, by default the exact count."""
    scratch = Scratch(batches.bow.sparkSession, "scvb0", base=snapshots)
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
                           corpus_tokens or batches.n_tokens, batches.n_words, cfg, scratch)
        metrics.save(t, rows)
        model = versions.save(nxt, t + 1)
        scratch.drop(f"pass-{t:06d}")
        history += rows
    return Fit(model, metrics_frame(batches.bow.sparkSession, scratch.base, history), batches.n_batches, scratch.base,
               history)


def document_topics(bow: DataFrame, model: DataFrame, n_words: int, cfg: SCVB0, scratch: Scratch) -> DataFrame:
    """`(doc_id, vec)`: N_theta of each document under a fixed model."""
    lengths = scratch.save(bow.groupBy("doc_id").agg(F.sum("freq").alias("n_tokens")), "lengths")
    n_tokens = lengths.agg(F.sum("n_tokens")).first()[0] or 0
    return document_pass(bow, model, parameter_totals(model, cfg.n_topics), n_words, cfg, n_tokens,
                         per_document=True).select("doc_id", "vec")
