"""Collapsed variational Bayes (zero-order) with one responsibility vector per (document, word).

The responsibilities would be the large table: a vector per pair.  The pairs are packed once, by document, into a table that stays
clustered by block; every sweep reads a block where it lies, takes document sums inside the block, and writes the block's word
sums.  Only word sums travel: (block, word) rows to words, and parameters back to the blocks that use them.

A sweep follows from the responsibilities before it and from sums, so synchronous ones store these every `STORE_EVERY` sweeps only; in
between a block goes through the sweeps since then again, from the word sums of each, and first draws are drawn again.  In-place sweeps
take longer and store the responsibilities every time but the last; what the last one gives is made when it is read.

In-place sweeps have blocks of their own, each on its own copy of the sums, whose number shapes the result.  Several of them lie in one
block of the table as its parts: a word's sums travel once for all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from topicspark.functions.random import uniform
from topicspark.functions.special import lgamma
from topicspark.functions.vectors import literal_vector, share_of_sum, sum_vectors
from topicspark.operators import blocks
from topicspark.operators.kernels import PHI_ROWS, cvb0_kernel, cvb0_sync_kernel, pack_drawn, pack_phi, unpack_phi, word_rows
from topicspark.plans.minibatch import alpha_vector, metrics_frame, parameter_totals
from topicspark.session import Scratch

STORE_EVERY = 4                   # sweeps
SYNC_PAIRS = 3_000_000            # (document, word) pairs in a block of the table; the fewer blocks, the fewer (block, word) rows
SYNC_CELLS = 12_000_000           # pairs times topics in one
SYNC_BLOCKS = 32                  # blocks that a small corpus is dealt to, as far as they are no smaller than those of other kernels


@dataclass
class CVB0:
    n_topics: int
    alpha: float | list[float] = 0.01    # one number, or one per topic
    beta: float = 0.01
    n_sweeps: int = 10
    seed: int = 1
    init: str = "random"                 # "hash": first responsibilities by md5, reproducible in other engines
    weight: str = "presence"             # "presence": each distinct word of a document counts once; "freq": as often
    schedule: str = "sync"               # "sync": all from the previous sums; "block": in place inside a block
    order: str = "lockstep"              # inside a block: "serial", or "lockstep", the j-th words of all documents at once
    n_blocks: int | None = None          # with "block": 1 and "serial" is the strictly sequential order
    tokens_per_block: int | None = None

    @property
    def alpha_vec(self) -> list[float]:
        return alpha_vector(self.alpha, self.n_topics)


@dataclass
class CVB0Fit:
    phi: DataFrame            # (doc_id, word_id, weight, phi)
    word_topic: DataFrame     # (word_id, params)
    doc_topic: DataFrame      # (doc_id, n_dk)
    metrics: DataFrame
    history: list


def start_phi(bow: DataFrame, n_topics: int, seed: int, weight: str = "presence", portable: bool = True,
              also: list[str] = []) -> DataFrame:
    """`(doc_id, word_id, weight, phi)` with a random point on the simplex for every (document, word); `also` names columns
    that stay."""
    w = F.lit(1.0) if weight == "presence" else F.col("freq").cast("double")
    rows = bow.select(*also, F.col("doc_id").cast("long").alias("doc_id"), "word_id", w.alias("weight"))
    draw = uniform(portable)
    return share_of_sum(rows, [*also, "doc_id", "word_id", "weight"], n_topics, lambda k: draw(seed, "doc_id", "word_id", k), "phi")


def _few_blocks(n_pairs: int, some: int, cfg: CVB0) -> int:
    fewest = blocks.block_count(n_pairs, 1, max(1, min(SYNC_PAIRS, SYNC_CELLS // cfg.n_topics)))
    return max(fewest, min(some, SYNC_BLOCKS))


def n_blocks(n_pairs: int, cfg: CVB0) -> int:
    """Blocks of a corpus; they follow from its size, the topics and the settings alone."""
    if cfg.n_blocks:
        return cfg.n_blocks
    some = blocks.block_count(n_pairs, cfg.n_topics, cfg.tokens_per_block)
    return some if cfg.schedule != "sync" or cfg.tokens_per_block else _few_blocks(n_pairs, some, cfg)


def n_table_blocks(n_pairs: int, cfg: CVB0) -> int:
    """Blocks of the tables, which hold whole blocks of in-place sweeps, several where they are small."""
    some = n_blocks(n_pairs, cfg)
    return some if cfg.schedule == "sync" else min(some, _few_blocks(n_pairs, some, cfg))


def start_state(bow: DataFrame, cfg: CVB0, tables: blocks.BlockTables, name: str = "phi/0", n_parts: int = 1, keep_phi: bool = False) -> DataFrame:
    """The packed start.  Documents move to their blocks as plain counts, and `n_parts` blocks of in-place sweeps to those of the table;
    responsibilities are drawn where they will lie, for the sums, and stored if asked for."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(n_parts)).cast("int")
    rows = tables.place(bow.select("doc_id", "word_id", "freq"), None if cfg.schedule == "sync" else F.pmod(part, F.lit(tables.n_blocks)))
    if keep_phi:
        phi = start_phi(rows, cfg.n_topics, cfg.seed, cfg.weight, cfg.init == "hash", ["block"])
        return tables.save(phi.groupBy("block").applyInArrow(pack_phi(cfg.n_topics), PHI_ROWS), name)
    w = F.lit(1) if cfg.weight == "presence" else F.col("freq").cast("double")
    pairs = rows.select("block", part.alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "word_id", w.alias("weight"))
    return tables.save(pairs.groupBy("block").applyInArrow(pack_drawn(cfg.n_topics, cfg.seed, cfg.init == "hash"), PHI_ROWS), name)


def pair_rows(state: DataFrame, n_topics: int) -> DataFrame:
    """`(doc_id, word_id, weight, phi)` of a packed table."""
    return state.select("doc_id", "words", "weights", "phi").mapInArrow(
        unpack_phi(n_topics), "doc_id long, word_id int, weight double, phi array<double>")


def words_of_blocks(state: DataFrame) -> DataFrame:
    return state.where(F.size("sum_words") > 0).select("block", F.explode("sum_words").alias("word_id"))


def word_sums(state: DataFrame, n_topics: int) -> DataFrame:
    """`(word_id, params)`: sum over documents, from the sums of the blocks; the responsibilities are not read."""
    parts = state.where(F.size("sum_words") > 0).select("sum_words", "sums").mapInArrow(
        word_rows(n_topics), "word_id int, params array<double>")
    return parts.groupBy("word_id").agg(sum_vectors("params", n_topics).alias("params"))


def doc_sums(state: DataFrame) -> DataFrame:
    """`(doc_id, n_dk)`: sum over words, as the blocks wrote it."""
    return state.where(F.size("n_dk") > 0).select("doc_id", "n_dk")


def _in_turn(versions: list[tuple[DataFrame, list[float]]]) -> DataFrame:
    """`(word_id, params)`: the word sums of all versions one after the other."""
    rows = versions[0][0]
    for later, _ in versions[1:]:
        rows = rows.join(later.select("word_id", F.col("params").alias("_later")), "word_id").select(
            "word_id", F.concat("params", "_later").alias("params"))
    return rows


def sweep(state: DataFrame, in_blocks: DataFrame, by_word: DataFrame, totals: list[float], n_words: int, cfg: CVB0,
          tables: blocks.BlockTables, earlier: list[tuple[DataFrame, list[float]]] = [], keep_phi: bool = False) -> DataFrame:
    """All responsibilities from the previous sums, or in place inside each block, on the block's own copy of the sums.

    Sweeps begin from an older state if `earlier` gives the word sums and topic totals of the versions before `by_word`, that of `state`
    first; without `keep_phi` the result has the sums alone.
    """
    return _run(state, in_blocks, [*earlier, (by_word, totals)], n_words, cfg, tables, "phi" if keep_phi else "sums", PHI_ROWS)


def responsibilities(state: DataFrame, in_blocks: DataFrame, versions: list[tuple[DataFrame, list[float]]], n_words: int, cfg: CVB0,
                     tables: blocks.BlockTables) -> DataFrame:
    """`(doc_id, word_id, weight, phi)` after a sweep from each of `versions`, made when it is read."""
    return _run(state, in_blocks, versions, n_words, cfg, tables, "pairs", "doc_id long, word_id int, weight double, phi array<double>")


def _run(state, in_blocks, versions, n_words, cfg, tables, give: str, schema: str) -> DataFrame:
    totals, portable = [t for _, t in versions], cfg.init == "hash"
    if cfg.schedule == "sync":
        kernel = cvb0_sync_kernel(cfg.n_topics, cfg.alpha_vec, cfg.beta, n_words, totals, cfg.seed, give, portable)
    else:
        kernel = cvb0_kernel(cfg.n_topics, cfg.alpha_vec, cfg.beta, n_words, totals, cfg.order, cfg.seed, give, portable)
    return tables.run(state, blocks.pull(in_blocks, _in_turn(versions)), kernel, schema)


def loglik(by_word: DataFrame, by_doc: DataFrame, n_words: int, alpha: list, beta: float) -> float:
    """The collapsed log-likelihood of the expected counts.  Words absent from `by_word` contribute 0."""
    k, vb = len(alpha), F.lit(float(n_words * beta))
    b, a_sum = F.lit(float(beta)), F.lit(float(sum(alpha)))
    words = (by_word.select(F.posexplode("params").alias("topic", "n")).groupBy("topic")
             .agg(F.sum(lgamma(F.col("n") + b) - lgamma(b)).alias("cells"), F.sum("n").alias("total"))
             .agg(F.sum(F.col("cells") + lgamma(vb) - lgamma(F.col("total") + vb)).alias("x"))).first()
    a = literal_vector(alpha)[F.col("topic")]
    cells = lgamma(F.col("n") + a) - lgamma(a)
    docs = (by_doc.select("doc_id", F.posexplode("n_dk").alias("topic", "n")).groupBy("doc_id")
            .agg(F.sum(cells).alias("cells"), F.sum("n").alias("total"))
            .agg(F.sum(lgamma(a_sum) - lgamma(F.col("total") + a_sum) + F.col("cells")).alias("x"))).first()
    return words["x"] + docs["x"]


def fit(bow: DataFrame, n_words: int, cfg: CVB0, scratch: Scratch | None = None) -> CVB0Fit:
    """Sweeps with the likelihood after each; the sums are recomputed from the responsibilities every time."""
    scratch = scratch or Scratch(bow.sparkSession, "cvb0")
    k, history, n_pairs = cfg.n_topics, [], bow.count()
    tables = blocks.BlockTables(scratch, n_table_blocks(n_pairs, cfg))
    state = start_state(bow, cfg, tables, n_parts=n_blocks(n_pairs, cfg), keep_phi=not cfg.n_sweeps)
    in_blocks = scratch.save(words_of_blocks(state), "block_words")
    by_word = scratch.save(word_sums(state, k), "by_word/0")
    base, start, earlier = state, 0, []              # the last version with responsibilities, and the sums from it on
    for t in range(1, cfg.n_sweeps + 1):
        totals, kept = parameter_totals(by_word, k), t < cfg.n_sweeps and (cfg.schedule != "sync" or t % STORE_EVERY == 0)
        state = tables.save(sweep(base, in_blocks, by_word, totals, n_words, cfg, tables, earlier, kept), f"phi/{t}")
        earlier = [*earlier, (by_word, totals)]
        by_word = scratch.save(word_sums(state, k), f"by_word/{t}")
        history.append((t, "loglik", loglik(by_word, doc_sums(state), n_words, cfg.alpha_vec, cfg.beta)))
        if t - 1 > start:                            # sums that no later sweep reads
            tables.drop(f"phi/{t - 1}")
        if kept:
            tables.drop(f"phi/{start}")
            for old in range(start, t):
                scratch.drop(f"by_word/{old}")
            base, start, earlier = state, t, []
    if not cfg.n_sweeps:
        state = tables.release("phi/0")
        phi = pair_rows(state, k)
    else:
        state = tables.release(f"phi/{cfg.n_sweeps}")
        phi = responsibilities(tables.release(f"phi/{start}"), in_blocks, earlier, n_words, cfg, tables)
    return CVB0Fit(phi, by_word, doc_sums(state), metrics_frame(bow.sparkSession, scratch.base, history), history)
