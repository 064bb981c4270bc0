"""Vocabulary and bag-of-words tables from raw text.

Terms are counted inside the row of their document and stay there: a packed row holds a document's distinct terms and their
counts, and rows lie in blocks of bounded size, numbered by the task that counted them.  What is shuffled is distinct terms only:
once per map task for the vocabulary, and once per block to fetch their numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from topicspark.operators.blocks import BlockTables
from topicspark.operators.indexing import dense_index
from topicspark.session import Scratch, arrow_batches, local_parallelism

WORD_PATTERN = r"(\p{L}+)"
TERMS_PER_BLOCK = 1_000_000    # (document, term) pairs; a document is never cut.  A term travels once per block that has it
WORDS_AT_ONCE = 200_000        # words that a task counts at a time, whatever the number of documents that Spark hands it
BYTES_AT_ONCE = 8 << 20        # of words that Spark hands a task at a time; without a bound in bytes a batch is 10,000 documents
BYTES_PER_BUCKET = 16 << 20    # of input files: a task that encodes a bucket sorts its rows, which take many times as much memory
_TASK_BITS = 32


def term_array(text: Column) -> Column:
    """The lower-cased letter runs of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(1))


def n_words_of(text: Column) -> Column:
    """Number of words of a text."""
    return F.size(F.coalesce(term_array(text), F.array().cast("array<string>")))


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of (doc_id, words) in pieces of at most `WORDS_AT_ONCE` words, or of one row."""
    offsets = batch.column(1).offsets.to_numpy()
    row = 0
    while row < batch.num_rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + WORDS_AT_ONCE, "right")) - 1)
        yield batch.slice(row, to - row)
        row = to


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, doc_id, terms, freqs) from (doc_id, all words); documents without words are left out."""
    block, held = TaskContext.get().partitionId() << _TASK_BITS, 0
    for batch in (piece for whole in batches for piece in _pieces(whole)):
        words = batch.column(1)
        owner = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
        coded = pc.dictionary_encode(words.flatten())
        pairs, freqs = np.unique(owner * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        owner, code = np.divmod(pairs, max(1, len(coded.dictionary)))
        docs, sizes = np.unique(owner, return_counts=True)
        if not len(docs):
            continue
        offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        before = held + np.cumsum(sizes) - sizes
        held += int(sizes.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(block + before // TERMS_PER_BLOCK), batch.column(0).take(pa.array(docs)),
             pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(code))),
             pa.ListArray.from_arrays(offsets, pa.array(freqs.astype(np.int32)))], ["block", "doc_id", "terms", "freqs"])


def packed_terms(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(block, doc_id, terms, freqs)`, a row per document with words; nothing is shuffled."""
    kind = docs.schema[doc_col].dataType.simpleString()
    words = docs.select(F.col(doc_col).alias("doc_id"), term_array(F.col(text_col)).alias("words"))
    return words.mapInArrow(_count_rows, f"block long, doc_id {kind}, terms array<string>, freqs array<int>")


def build_vocabulary(packed: DataFrame, scratch: Scratch, min_df: int = 1) -> DataFrame:
    """`(word_id, term, df)`: term numbers in term order, for terms found in at least `min_df` documents."""
    terms = packed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if min_df > 1:
        terms = terms.where(F.col("df") >= min_df)
    terms = scratch.save(terms, "vocabulary_df")          # the range partitioning below reads it twice
    return (dense_index(terms, ["term"], "word_id", scratch, "vocabulary_terms")
            .select(F.col("word_id").cast("int").alias("word_id"), "term", "df"))


def _number_terms(left: pa.Table, right: pa.Table) -> pa.Table:
    """Rows (doc_id, word_id, freq) of a block; terms that have no number are left out."""
    terms = left.column("terms").combine_chunks()
    owner = np.repeat(np.arange(left.num_rows), np.diff(terms.offsets.to_numpy()))
    at = pc.index_in(terms.flatten(), value_set=right.column("term").combine_chunks())
    known = np.flatnonzero(pc.is_valid(at).to_numpy(zero_copy_only=False))
    word = right.column("word_id").combine_chunks().take(at.take(pa.array(known))).to_numpy(zero_copy_only=False)
    order = np.lexsort((word, owner[known]))
    freqs = left.column("freqs").combine_chunks().flatten().take(pa.array(known[order]))
    return pa.table({"doc_id": left.column("doc_id").take(pa.array(owner[known[order]])), "word_id": pa.array(word[order], pa.int32()),
                     "freq": freqs})


def encode(packed: DataFrame, vocab: DataFrame, tables: BlockTables) -> DataFrame:
    """`(doc_id, word_id, freq)`; terms outside the vocabulary are left out.

    `packed` is a table clustered by block: a term travels once per block that has it, to the vocabulary and back, so a word of
    nearly all documents is a key of at most one row per block, which the adaptive skew join splits.
    """
    kind = packed.schema["doc_id"].dataType.simpleString()
    in_blocks = packed.select("block", F.explode("terms").alias("term")).distinct()
    numbers = in_blocks.join(vocab.select("term", "word_id"), "term").select("block", "term", "word_id")
    return tables.run(packed, numbers, _number_terms, f"doc_id {kind}, word_id int, freq int")


def _rank_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, ranks, n_terms) from (doc_id, all words): for every word its rank, in byte order, among the distinct words of its row."""
    for batch in (piece for whole in batches for piece in _pieces(whole)):
        words = batch.column(1)
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(batch.num_rows), sizes)
        coded = pc.dictionary_encode(words.flatten())
        if not len(owner):
            continue
        rank = np.empty(len(coded.dictionary), np.int64)
        rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
        pairs, at = np.unique(owner * len(rank) + rank[coded.indices.to_numpy(zero_copy_only=False)], return_inverse=True)
        n_terms = np.bincount(pairs // len(rank), minlength=batch.num_rows)
        ranks = at - np.repeat(np.cumsum(n_terms) - n_terms, sizes)
        filled = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(filled)),
             pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes[filled])).astype(np.int32)), pa.array(ranks.astype(np.int32))),
             pa.array(n_terms[filled].astype(np.int32))], ["doc_id", "ranks", "n_terms"])


def words_in_place(docs: DataFrame, corpus: Corpus, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, words, places)`: the word numbers of a document in the order of its text, for a corpus that keeps every term; `places`
    is null where they are 0, 1, 2, ...  Documents without words are left out.

    Terms are numbered in their order, so the n-th distinct term of a document has the n-th of its word numbers: ranks and numbers
    meet by document, and no term is shuffled.  Rows of a repeated id are one document, with a place for each row's n-th word; only
    their terms are looked up in the vocabulary.
    """
    rows = spread_small_scan(docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    repeated = corpus.scratch.save(docs.groupBy(F.col(doc_col).alias("_id")).count().where("count > 1").select("_id"), "ids_of_many_rows")
    once = rows.join(repeated, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
    kind = once.schema["doc_id"].dataType.simpleString()
    ranked = (once.select("doc_id", term_array(F.col("text")).alias("words"))
              .mapInArrow(_rank_rows, f"doc_id {kind}, ranks array<int>, n_terms int"))
    numbers = (corpus.bow.groupBy(F.col("doc_id").alias("_doc")).agg(F.sort_array(F.collect_list("word_id")).alias("_numbers")))
    known = F.when(F.size("_numbers") == F.col("n_terms"), F.col("_numbers")).otherwise(
        F.raise_error("the corpus does not hold every term of its documents").cast("array<int>"))
    placed = (ranked.join(numbers, F.col("doc_id").eqNullSafe(F.col("_doc"))).select("doc_id", "ranks", known.alias("_numbers"))
              .select("doc_id", F.transform("ranks", lambda r: F.get("_numbers", r)).alias("words"), F.lit(None).cast("array<int>").alias("places")))
    if repeated.isEmpty():
        return placed
    tokens = (rows.join(repeated, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
              .select("doc_id", F.posexplode(term_array(F.col("text"))).alias("p", "term")))
    merged = (tokens.join(corpus.vocab.select("term", "word_id"), "term")
              .groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("p", "word_id"))).alias("t")))
    return placed.unionByName(merged.select("doc_id", F.col("t.word_id").alias("words"), F.col("t.p").alias("places")))


def spread_small_scan(docs: DataFrame, key: str) -> DataFrame:
    """Documents over all cores when the scan has fewer splits than that, as with one file of one row group.

    Large inputs have more splits than cores and are left as they are; raw text is not worth a shuffle there.
    """
    cores = local_parallelism(docs.sparkSession)
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores, key)


def counted(docs: DataFrame, scratch: Scratch, doc_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, BlockTables]:
    """The packed rows of raw documents as a table clustered by block, with a bucket for every `BYTES_PER_BUCKET` of a full split."""
    rows = docs.select(doc_col, text_col)
    spread = spread_small_scan(rows, doc_col)
    parts = max(1, spread.rdd.getNumPartitions())
    split = docs.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes() if spread is rows else 0
    tables = BlockTables(scratch, parts * max(1, split // BYTES_PER_BUCKET))
    with arrow_batches(docs.sparkSession, BYTES_AT_ONCE):
        packed = tables.save(packed_terms(spread, doc_col, text_col), "term_counts")
    return merge_repeated(packed, tables), tables


def merge_repeated(packed: DataFrame, tables: BlockTables) -> DataFrame:
    """Rows of one id become one document.  Only ids are shuffled to find them, and only the rows of repeated ids to merge them."""
    scratch = tables.scratch
    repeated = scratch.save(packed.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id")), "repeated_ids")
    if repeated.isEmpty():
        return packed
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    cells = (packed.join(repeated, same, "left_semi").select("doc_id", F.explode(F.arrays_zip("terms", "freqs")).alias("t"))
             .groupBy("doc_id", F.col("t.terms").alias("term")).agg(F.sum("t.freqs").cast("int").alias("freq")))
    whole = cells.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("term", "freq"))).alias("t"))
    block = -1 - F.pmod(F.xxhash64("doc_id"), F.lit(tables.n_buckets))
    merged = whole.select(block.alias("block"), "doc_id", F.col("t.term").alias("terms"), F.col("t.freq").alias("freqs"))
    return tables.save(packed.join(repeated, same, "left_anti").unionByName(merged), "merged_counts")


class Corpus:
    """A prepared corpus: `vocab(word_id, term, df)`, `bow(doc_id, word_id, freq)`, written once to scratch."""

    def __init__(self, vocab: DataFrame, bow: DataFrame, scratch: Scratch):
        self.vocab, self.bow, self.scratch = vocab, bow, scratch

    @property
    def spark(self):
        return self.bow.sparkSession

    def vocabulary_size(self) -> int:
        return self.vocab.count()

    def documents(self) -> DataFrame:
        return self.bow.groupBy("doc_id").agg(F.sum("freq").alias("n_tokens"))


def corpus_from_text(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", min_df: int = 1,
                     scratch: Scratch | None = None) -> Corpus:
    """Count, number and encode the terms of raw documents."""
    scratch = scratch or Scratch(docs.sparkSession, "corpus")
    packed, tables = counted(docs, scratch, doc_col, text_col)
    vocab = scratch.save(build_vocabulary(packed, scratch, min_df), "vocab")
    bow = scratch.save(encode(packed, vocab, tables), "bow")
    tables.drop_all()
    return Corpus(vocab, bow, scratch)
