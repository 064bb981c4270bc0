"""Documents, bags of words, tokens, minibatches and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from topicspark.operators.indexing import dense_index
from topicspark.session import Scratch

_RUN = 10_000  # tokens made from one row at a time when a frequency is expanded


def keep_non_blank(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lines of more than one character."""
    return lines.where(F.length(col) > 1)


def with_position(docs: DataFrame, scratch: Scratch, order_by: str = "doc_id") -> DataFrame:
    """Add `doc_pos`, the 0-based place of a document in key order."""
    return dense_index(docs, [order_by], "doc_pos", scratch, f"positions_{order_by}")


def for_every_document(rows: DataFrame, docs: DataFrame | None, **empty) -> DataFrame:
    """`rows`, one per document with words, completed by those of `docs(doc_id)` without any; `empty` holds their values."""
    if docs is None:
        return rows
    filled = [F.coalesce(c, empty[c] if isinstance(empty[c], Column) else F.lit(empty[c])).alias(c)
              for c in rows.columns if c != "doc_id"]
    return docs.select("doc_id").join(rows, "doc_id", "left").select("doc_id", *filled)


def document_lengths(bow: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """`docs(doc_id)` lists the documents; without it those that have words."""
    rows = bow.groupBy("doc_id").agg(F.sum("freq").cast("long").alias("n_tokens"))
    return for_every_document(rows, docs, n_tokens=0)


def distinct_terms(bow: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Rows of a bag of words are unique per (document, word), so counting rows counts words."""
    return for_every_document(bow.groupBy("doc_id").agg(F.count("word_id").alias("n_terms")), docs, n_terms=0)


def corpus_tokens(bow: DataFrame) -> DataFrame:
    return bow.agg(F.sum("freq").cast("long").alias("n_tokens"))


def corpus_tokens_estimate(lengths: DataFrame, first: int = 100) -> DataFrame:
    """Corpus size from the mean length of the first `first` documents (fewer if there are fewer).

    `lengths(doc_pos, n_tokens)` is aggregated once; the sample is a condition inside the aggregate.
    """
    sampled = F.when(F.col("doc_pos") < first, F.col("n_tokens"))
    return lengths.agg((F.avg(sampled) * F.count(F.lit(1))).alias("n_tokens"))


def tokens_estimate_from_text(docs: DataFrame, n_words, first: int = 100, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same estimate from raw documents of unique ids: the first ones are found by their ids, and only their texts are split;
    the filter on the id is pushed to the scan.  `n_words` gives the number of words of a text column."""
    ids = docs.select(doc_col).orderBy(doc_col).limit(first)
    last = ids.agg(F.max(doc_col).alias("last")).first()["last"]          # one id
    sample = docs.where(F.col(doc_col) <= F.lit(last)).select(n_words(F.col(text_col)).alias("n"))
    return sample.agg((F.avg("n") * F.lit(docs.count())).alias("n_tokens"))


def minibatch_of(doc_pos: Column, batch_size: int) -> Column:
    return F.floor(doc_pos / F.lit(batch_size)).cast("int")


def minibatches(docs: DataFrame, batch_size: int) -> DataFrame:
    return docs.withColumn("batch_id", minibatch_of(F.col("doc_pos"), batch_size))


def minibatch_tokens(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("batch_id").agg(F.sum("n_tokens").alias("n_tokens"))


def block_of(doc_pos: Column, n_docs: int, n_blocks: int) -> Column:
    """Contiguous blocks: with q = n_docs / n_blocks (whole), block b holds positions b*q+1 .. (b+1)*q; block 0 also
    position 0 and the last block the rest."""
    q = max(1, n_docs // n_blocks)
    raw = F.ceil(doc_pos / F.lit(q)) - F.lit(1)
    return F.least(F.greatest(raw, F.lit(0)), F.lit(n_blocks - 1)).cast("int")


def expand_tokens(bow: DataFrame) -> DataFrame:
    """`(doc_id, word_id, occ)`: one row per occurrence.

    A frequency is cut to runs first, so one hot (document, word) pair is spread over many rows before it is expanded
    and no row ever holds an array longer than a run.
    """
    runs = bow.where(F.col("freq") > 0).select(
        "doc_id", "word_id", "freq", F.explode(F.sequence(F.lit(0), F.col("freq") - 1, F.lit(_RUN))).alias("_start"))
    last = F.least(F.col("_start") + F.lit(_RUN), F.col("freq")) - 1
    return runs.select("doc_id", "word_id", F.explode(F.sequence(F.col("_start"), last)).alias("occ"))


def document_vectors(bow: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """`(doc_id, words, freqs)`: word numbers in ascending order and their frequencies in the same order."""
    ordered = F.sort_array(F.collect_list(F.struct("word_id", "freq")))
    rows = (bow.groupBy("doc_id").agg(ordered.alias("_t"))
            .select("doc_id", F.col("_t.word_id").alias("words"), F.col("_t.freq").alias("freqs")))
    none = F.array().cast("array<int>")
    return for_every_document(rows, docs, words=none, freqs=none)


def freq_of_word(word_id: Column) -> Column:
    """Frequency of a word number in a document row of `document_vectors`, 0 if absent."""
    at = F.array_position(F.col("words"), word_id)
    return F.when(at > 0, F.get(F.col("freqs"), (at - 1).cast("int"))).otherwise(F.lit(0))


def freq_at(position: Column) -> Column:
    """Frequency of the word at a place (0-based) of the sorted word list; null beyond its end."""
    return F.get(F.col("freqs"), position)


def reject_unknown_words(bow: DataFrame, vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a bag of words to rows whose word is in the vocabulary and rows whose word is not."""
    known = vocab.select("word_id")
    return bow.join(known, "word_id", "left_semi"), bow.join(known, "word_id", "left_anti")
