"""Collapsed Gibbs sampling, serial (one block) or approximate-distributed (many blocks and a merge after each sweep)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from topicspark.operators import blocks, corpus, counts, likelihood
from topicspark.operators.kernels import gibbs_kernel, hash_topics
from topicspark.plans.minibatch import alpha_vector, metrics_frame
from topicspark.session import Scratch

_TOL = 1e-6
PIECE_TOKENS = 2_000_000     # of a block that is cut because few were asked for; a kernel holds some 60 bytes for each
STATE_SCHEMA = "block int, doc_id long, words array<int>, topics array<int>"


@dataclass
class Gibbs:
    n_topics: int
    alpha: float | list[float] = 0.1     # one number, or one per topic
    beta: float = 0.01
    n_sweeps: int = 10
    seed: int = 1
    init: str = "random"                 # "hash": first topics by md5, reproducible in other engines
    n_blocks: int | None = None          # None: as many as the corpus size asks for; with "serial": 1 is the exact chain; otherwise
                                         # the least number, as blocks too large for a task are cut to pieces
    schedule: str = "lockstep"           # inside a block: "serial", token by token, or "lockstep", document-parallel; or
                                         # "frozen": word counts stay as they were before the sweep, whatever the blocks
    sweeps_per_merge: int = 1
    optimise_from: int = 100             # hyper-parameter steps from this sweep on ...
    optimise_every: int = 10             # ... at multiples of this
    optimise_steps: int = 1              # fixed-point steps when due, fewer once alpha and beta move by less than a millionth
    metrics_every: int = 1
    tokens_per_block: int | None = None


@dataclass
class GibbsFit:
    state: DataFrame          # tokens with topics, one row per document
    topic_word: DataFrame     # (topic, word_id, n), non-zero cells
    doc_topic: DataFrame      # (doc_id, topic, n), non-zero cells
    alpha: list
    beta: float
    metrics: DataFrame
    history: list


def assignments(state: DataFrame) -> DataFrame:
    """`(doc_id, word_id, topic)`, one row per token."""
    return (state.select("doc_id", F.explode(F.arrays_zip("words", "topics")).alias("t"))
            .select("doc_id", F.col("t.words").alias("word_id"), F.col("t.topics").alias("topic")))


def start_state(bow: DataFrame, cfg: Gibbs, scratch: Scratch, lengths: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Uniform topics for all tokens, packed to one row per document, and the number of blocks."""
    if lengths is None:
        lengths = scratch.save(corpus.document_lengths(bow), "lengths")
    n_tokens = lengths.agg(F.sum("n_tokens")).first()[0] or 0
    n_blocks = cfg.n_blocks or blocks.block_count(n_tokens, cfg.n_topics, cfg.tokens_per_block)
    if cfg.schedule == "frozen":                  # the result does not depend on the blocks, so large ones are cut to pieces
        n_blocks *= math.ceil(blocks.block_count(n_tokens, cfg.n_topics, cfg.tokens_per_block) / n_blocks)
    elif cfg.schedule == "lockstep" and cfg.n_blocks:     # no task takes a larger part of a larger corpus because few blocks were asked for
        size = cfg.tokens_per_block or max(1, min(PIECE_TOKENS, blocks.CELLS_PER_BLOCK // cfg.n_topics))
        n_blocks *= math.ceil(blocks.block_count(n_tokens, cfg.n_topics, size) / n_blocks)
    kinds = dict(bow.dtypes)
    if cfg.init == "hash" or [kinds[c] for c in ("doc_id", "word_id", "freq")] == ["bigint", "int", "int"]:
        packed = corpus.document_vectors(bow.where(F.col("freq") > 0)).mapInArrow(
            hash_topics(cfg.n_topics, cfg.seed, cfg.init == "hash"), f"doc_id {kinds['doc_id']}, words array<int>, topics array<int>")
    else:
        tokens = counts.assign_uniform(bow, cfg.n_topics, cfg.seed, portable=False)
        ordered = F.sort_array(F.collect_list(F.struct("word_id", "occ", "topic")))
        packed = (tokens.groupBy("doc_id").agg(ordered.alias("t"))
                  .select("doc_id", F.col("t.word_id").alias("words"), F.col("t.topic").alias("topics")))
    state = blocks.assign_blocks(packed, n_blocks).select("block", "doc_id", "words", "topics")
    return scratch.save(state, "state/0"), n_blocks


def _sparse_rows(topic_word: DataFrame) -> DataFrame:
    """`(word_id, topics, ns)`: the non-zero topics of a word, at most one entry per topic."""
    packed = topic_word.groupBy("word_id").agg(F.collect_list(F.struct("topic", "n")).alias("t"))
    return packed.select("word_id", F.col("t.topic").alias("topics"), F.col("t.n").alias("ns"))


def sweep(state: DataFrame, topic_word: DataFrame, words_of_blocks: DataFrame, totals: list[float], n_words: int,
          alpha: list, beta: float, t: int, n_blocks: int, cfg: Gibbs) -> DataFrame:
    """One merge period: every block samples its tokens on its own copy of the counts."""
    kernel = gibbs_kernel(cfg.n_topics, alpha, beta, n_words, totals, cfg.seed, t, cfg.schedule, cfg.sweeps_per_merge,
                          portable=cfg.schedule == "frozen" and cfg.init == "hash")
    params = blocks.pull(words_of_blocks, _sparse_rows(topic_word))
    return blocks.run_blocks(state, params, n_blocks, kernel, STATE_SCHEMA)


def fit(bow: DataFrame, n_words: int, cfg: Gibbs, scratch: Scratch | None = None) -> GibbsFit:
    """Sweep, merge by recounting from the tokens, score, and step the hyper-parameters when due.

    The recount equals global counts plus the sum of the blocks' deltas; it needs no previous counts, so it cannot drift.
    """
    scratch = scratch or Scratch(bow.sparkSession, "gibbs")
    state, n_blocks = start_state(bow, cfg, scratch)
    words_of_blocks = scratch.save(
        state.select("block", F.explode(F.array_distinct("words")).alias("word_id")).distinct(), "block_words")
    alpha, beta, history = alpha_vector(cfg.alpha, cfg.n_topics), cfg.beta, []
    topic_word = scratch.save(counts.topic_word_counts(assignments(state)), "topic_word/0")
    for t in range(1, cfg.n_sweeps + 1):
        totals = _totals(topic_word, cfg.n_topics)
        state = scratch.save(sweep(state, topic_word, words_of_blocks, totals, n_words, alpha, beta, t, n_blocks,
                                   cfg), f"state/{t}")
        topic_word = scratch.save(counts.topic_word_counts(assignments(state)), f"topic_word/{t}")
        if t >= 2:                                   # the version before the last stays for a re-run of this sweep
            scratch.drop(f"state/{t - 2}")
            scratch.drop(f"topic_word/{t - 2}")
        due = t >= cfg.optimise_from and t % cfg.optimise_every == 0
        scored = t % cfg.metrics_every == 0 or t == cfg.n_sweeps
        if due or scored:
            doc_topic = scratch.save(counts.doc_topic_counts(assignments(state)), "doc_topic_metric")
        if scored:
            value = likelihood.total_loglik(topic_word, doc_topic, n_words, alpha, beta).first()["loglik"]
            history.append((t, "loglik", value))
        if due:
            alpha = likelihood.alpha_steps(doc_topic, alpha, cfg.optimise_steps, scratch, _TOL)
            beta = likelihood.beta_steps(topic_word, n_words, beta, cfg.optimise_steps, scratch, _TOL)
    if cfg.n_sweeps:
        scratch.drop(f"state/{cfg.n_sweeps - 1}")
        scratch.drop(f"topic_word/{cfg.n_sweeps - 1}")
    doc_topic = counts.doc_topic_counts(assignments(state))
    return GibbsFit(state, topic_word, doc_topic, alpha, beta,
                    metrics_frame(bow.sparkSession, scratch.base, history), history)


def _totals(topic_word: DataFrame, n_topics: int) -> list[float]:
    found = {r["topic"]: float(r["n"]) for r in counts.topic_totals(topic_word).collect()}   # one row per topic
    return [found.get(k, 0.0) for k in range(n_topics)]
