"""Vocabulary, bag of words, documents, minibatches, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicspark.functions import scalars
from topicspark.functions.vectors import array_to_line
from topicspark.operators import corpus as ops
from topicspark.queries.base import (ASSIGNED, BOW, COUNTS, K, POSITIONS, SEED, TOKENS, VOCAB, corpus, query, r_sql,
                                     rounded, table)
from topicspark.functions.random import uniform_topic
from topicspark.session import Scratch, arrow_batches
from topicspark.sources import text
from topicspark.sources.raw import BYTES_AT_ONCE, build_vocabulary, counted, encode, n_words_of, words_in_place


@query("bow", f"WITH {BOW} SELECT doc_id, word_id, freq FROM bow")
def bow(spark, d):
    scratch = Scratch(spark, "bow")
    packed, tables = counted(table(spark, d, "documents"), scratch)
    return encode(packed, scratch.save(build_vocabulary(packed, scratch), "vocab"), tables)


@query("vocab", f"WITH {VOCAB} SELECT word_id, term, df FROM vocab")
def vocab(spark, d):
    scratch = Scratch(spark, "vocab")
    return build_vocabulary(counted(table(spark, d, "documents"), scratch)[0], scratch)


@query("vocab_min_df", f"WITH {COUNTS}, t AS (SELECT term, count(*) AS df FROM cnt GROUP BY term HAVING count(*) >= 5) "
                       "SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS word_id, term, df FROM t")
def vocab_min_df(spark, d):
    scratch = Scratch(spark, "vocab")
    return build_vocabulary(counted(table(spark, d, "documents"), scratch)[0], scratch, min_df=5)


@query("doc_lengths", f"WITH {TOKENS} SELECT doc_id, count(term) AS n_tokens FROM documents LEFT JOIN tok USING (doc_id) GROUP BY doc_id")
def doc_lengths(spark, d):
    return ops.document_lengths(corpus(spark, d).bow, table(spark, d, "documents"))


@query("distinct_terms", f"WITH {TOKENS} SELECT doc_id, count(DISTINCT term) AS n_terms FROM documents LEFT JOIN tok USING (doc_id) GROUP BY doc_id")
def distinct_terms(spark, d):
    return ops.distinct_terms(corpus(spark, d).bow, table(spark, d, "documents"))


@query("corpus_words_exact", f"WITH {TOKENS} SELECT count(*) AS n_tokens FROM tok")
def corpus_words_exact(spark, d):
    return ops.corpus_tokens(corpus(spark, d).bow)


def _positions(spark, d):
    return ops.with_position(table(spark, d, "documents").select("doc_id"), Scratch(spark, "positions"))


def _placed_lengths(spark, d):
    lengths = ops.document_lengths(corpus(spark, d).bow)
    return (_positions(spark, d).join(lengths, "doc_id", "left")
            .withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0))))


_LENGTHS = (f"{TOKENS}, {POSITIONS}, len AS (SELECT p.doc_pos, p.doc_id, coalesce(n, 0) AS n_tokens FROM pos p LEFT JOIN "
            "(SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id) USING (doc_id))")


@query("corpus_words_est",
       f"WITH {_LENGTHS} SELECT {r_sql('avg(CASE WHEN doc_pos < 100 THEN n_tokens END) * count(*)', 4)} AS n_tokens FROM len")
def corpus_words_est(spark, d):
    """The sample of the first documents is the operator itself; D is counted over all."""
    return ops.tokens_estimate_from_text(table(spark, d, "documents"), n_words_of).select(rounded("n_tokens", 4).alias("n_tokens"))


@query("doc_count", "SELECT count(*) AS n_docs FROM documents")
def doc_count(spark, d):
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n_docs"))


@query("minibatches", f"WITH {POSITIONS} SELECT doc_id, doc_pos, CAST(doc_pos // 64 AS INTEGER) AS batch_id FROM pos")
def minibatches(spark, d):
    return ops.minibatches(_positions(spark, d), 64)


@query("minibatch_slices",
       f"WITH {POSITIONS} SELECT CAST(doc_pos // 64 AS INTEGER) AS batch_id, min(doc_pos) AS first_pos, "
       "max(doc_pos) + 1 AS last_pos, count(*) AS n_docs FROM pos GROUP BY 1")
def minibatch_slices(spark, d):
    return (ops.minibatches(_positions(spark, d), 64).groupBy("batch_id")
            .agg(F.min("doc_pos").alias("first_pos"), (F.max("doc_pos") + 1).alias("last_pos"),
                 F.count(F.lit(1)).alias("n_docs")))


@query("doc_blocks",
       f"WITH {POSITIONS}, s AS (SELECT greatest(1, count(*) // 8) AS q FROM documents) SELECT doc_id, "
       "CAST(least(greatest(ceil(doc_pos / q) - 1, 0), 7) AS INTEGER) AS block FROM pos, s")
def doc_blocks(spark, d):
    docs = _positions(spark, d)
    return docs.select("doc_id", ops.block_of(F.col("doc_pos"), docs.count(), 8).alias("block"))


@query("minibatch_words", f"WITH {_LENGTHS} SELECT CAST(doc_pos // 64 AS INTEGER) AS batch_id, "
                          "CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM len GROUP BY 1")
def minibatch_words(spark, d):
    return ops.minibatch_tokens(ops.minibatches(_placed_lengths(spark, d), 64))


@query("learning_rate",
       f"WITH {POSITIONS}, b AS (SELECT DISTINCT doc_pos // 64 AS t FROM pos) SELECT CAST(t AS INTEGER) AS batch_id, "
       f"{r_sql('greatest(0e0, pow(1025e0 + t, -0.7e0))', 9)} AS rho_vb, "
       f"{r_sql('greatest(0e0, 10e0 * pow(1000e0 + t, -0.9e0))', 9)} AS rho_theta, "
       f"{r_sql('greatest(0e0, pow(10e0 + t, -0.9e0))', 9)} AS rho_global FROM b")
def learning_rates(spark, d):
    """The step sizes of every minibatch of the corpus."""
    t = F.col("batch_id")
    steps = ops.minibatches(_positions(spark, d), 64).select("batch_id").distinct()
    return steps.select("batch_id", rounded(scalars.learning_rate(t), 9).alias("rho_vb"),
                        rounded(scalars.learning_rate(t, 10.0, 1000.0, 0.9), 9).alias("rho_theta"),
                        rounded(scalars.learning_rate(t, 1.0, 10.0, 0.9), 9).alias("rho_global"))


_DIRTY_SQL = "{col} || chr(1) || chr(128512) || 'x' || chr(65534)"
_PATTERN_SQL = "'[^\\x{9}\\x{A}\\x{D}\\x{20}-\\x{D7FF}\\x{E000}-\\x{FFFD}]'"


def _strip_sql(source, key, col):
    dirty = _DIRTY_SQL.format(col=f"coalesce({col}, '')")
    return f"SELECT {key}, regexp_replace({dirty}, {_PATTERN_SQL}, '', 'g') AS clean FROM {source}"


def _strip(df, key, col):
    """The given texts are clean, so forbidden characters are appended to every one of them first."""
    dirty = F.concat(F.coalesce(col, F.lit("")), F.lit("\x01\U0001F600x￾"))
    return df.select(key, scalars.strip_xml(dirty).alias("clean"))


@query("strip_xml", _strip_sql("documents", "doc_id", "text"))
def strip_xml(spark, d):
    return _strip(table(spark, d, "documents"), "doc_id", "text")


@query("strip_xml_pages", _strip_sql("pages", "page_id", "html"))
def strip_xml_pages(spark, d):
    return _strip(table(spark, d, "pages"), "page_id", "html")


@query("non_blank_lines",
       "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents) "
       "SELECT doc_id, count(*) AS n_lines FROM l WHERE length(value) > 1 GROUP BY doc_id")
def non_blank_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    return ops.keep_non_blank(lines).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query("doc_vectors",
       f"WITH {BOW} SELECT doc_id, coalesce(string_agg(word_id, ',' ORDER BY word_id), '') AS words, "
       "coalesce(string_agg(freq, ',' ORDER BY word_id), '') AS freqs FROM documents LEFT JOIN bow USING (doc_id) GROUP BY doc_id")
def doc_vectors(spark, d):
    """One row per document; its word list is no longer than the document."""
    return ops.document_vectors(corpus(spark, d).bow, table(spark, d, "documents")).select(
        "doc_id", array_to_line(F.col("words")).alias("words"), array_to_line(F.col("freqs")).alias("freqs"))


@query("freq_lookup",
       f"WITH {BOW}, hot AS (SELECT word_id FROM bow GROUP BY word_id ORDER BY sum(freq) DESC, word_id LIMIT 1), "
       "o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY word_id) - 1 AS p FROM bow) "
       "SELECT doc_id, CAST(coalesce(max(CASE WHEN word_id = (SELECT word_id FROM hot) THEN freq END), 0) AS INTEGER) "
       "AS of_word, max(CASE WHEN p = 2 THEN freq END) AS at_place FROM o GROUP BY doc_id")
def freq_lookup(spark, d):
    """Frequency of the corpus's most frequent word in every document, and of the third word of every document."""
    b = corpus(spark, d).bow
    hot = (b.groupBy("word_id").agg(F.sum("freq").alias("n")).orderBy(F.desc("n"), "word_id").first())["word_id"]
    return ops.document_vectors(b).select("doc_id", ops.freq_of_word(F.lit(hot)).alias("of_word"),
                                          ops.freq_at(F.lit(2)).alias("at_place"))


@query("tokens", f"WITH {BOW} SELECT doc_id, word_id, CAST(unnest(range(freq)) AS INTEGER) AS occ FROM bow")
def tokens(spark, d):
    return ops.expand_tokens(corpus(spark, d).bow)


@query("token_topics", f"WITH {ASSIGNED} SELECT doc_id, word_id, CAST(occ AS INTEGER) AS occ, topic FROM assigned")
def token_topics(spark, d):
    return ops.expand_tokens(corpus(spark, d).bow).withColumn(
        "topic", uniform_topic(SEED, K, "doc_id", "word_id", "occ"))


@query("unknown_words",
       f"WITH {BOW}, kept AS (SELECT term FROM cnt GROUP BY term HAVING count(*) >= 5) "
       "SELECT c.doc_id, count(k.term) AS known, count(*) - count(k.term) AS rejected "
       "FROM cnt c LEFT JOIN kept k USING (term) GROUP BY c.doc_id")
def unknown_words(spark, d):
    """Every (document, word) row checked against a vocabulary cut at five documents."""
    c = corpus(spark, d)
    good, bad = ops.reject_unknown_words(c.bow, c.vocab.where("df >= 5"))
    both = good.select("doc_id", F.lit(1).alias("k")).unionByName(bad.select("doc_id", F.lit(0).alias("k")))
    return both.groupBy("doc_id").agg(F.sum("k").alias("known"), F.sum(1 - F.col("k")).alias("rejected"))


# -- files -------------------------------------------------------------------------------------------------------------

_TOKEN_PLACES = (f"{VOCAB}, placed AS (SELECT doc_id, term, p FROM (SELECT doc_id, "
                 "unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term, "
                 "unnest(range(1, len(regexp_extract_all(lower(text), '\\p{L}+')) + 1)) AS p FROM documents)), "
                 f"tp AS (SELECT dense_rank() OVER (ORDER BY doc_id) - 1 AS doc_id, 'doc' || doc_id AS doc_name, word_id, p "
                 "FROM placed JOIN vocab USING (term))")


def _corpus_file(spark, d):
    """The documents as a bag-of-words file with one `word:place` pair per token, so that word numbers repeat.

    Written by range-partitioned document order; lines are as long as their document.  The files are compressed: a text file takes
    three times as much.
    """
    scratch = Scratch(spark, "corpus-file")
    pair = F.transform("words", lambda w, i: F.concat(w, F.lit(":"), F.coalesce(F.get("places", i), i) + 1))
    line = F.concat_ws(" ", F.concat(F.lit("doc"), "doc_id"), F.size("words").cast("string"), F.array_join(pair, " "))
    with arrow_batches(spark, BYTES_AT_ONCE):
        (words_in_place(table(spark, d, "documents"), corpus(spark, d)).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
         .select(line.alias("value")).write.mode("overwrite").option("compression", "gzip").text(scratch.path("corpus")))
    return text.read_documents(spark, scratch.path("corpus"), scratch)


@query("corpus_file_sum", f"WITH {_TOKEN_PLACES} SELECT doc_id, doc_name, word_id, CAST(sum(p) AS INTEGER) AS freq "
                          "FROM tp GROUP BY doc_id, doc_name, word_id")
def corpus_file_sum(spark, d):
    docs = _corpus_file(spark, d)
    return docs.select("doc_id", "doc_name").join(text.bag_of_words(docs, "sum"), "doc_id").select(
        "doc_id", "doc_name", "word_id", "freq")


@query("corpus_file_last", f"WITH {_TOKEN_PLACES} SELECT doc_id, word_id, CAST(max(p) AS INTEGER) AS freq "
                           "FROM tp GROUP BY doc_id, word_id")
def corpus_file_last(spark, d):
    return text.bag_of_words(_corpus_file(spark, d), "last")


@query("corpus_file_presence", f"WITH {_TOKEN_PLACES} SELECT DISTINCT doc_id, word_id, CAST(1 AS INTEGER) AS freq FROM tp")
def corpus_file_presence(spark, d):
    return text.bag_of_words(_corpus_file(spark, d), "presence")


@query("corpus_file_lengths", f"WITH {_TOKEN_PLACES} SELECT doc_id, CAST(sum(p) AS BIGINT) AS n_tokens FROM tp GROUP BY doc_id")
def corpus_file_lengths(spark, d):
    return text.token_length(_corpus_file(spark, d))


@query("vocab_file", f"WITH {VOCAB} SELECT word_id, term FROM vocab")
def vocab_file(spark, d):
    scratch = Scratch(spark, "vocab-file")
    (corpus(spark, d).vocab.repartitionByRange("word_id").sortWithinPartitions("word_id").select("term")
     .write.mode("overwrite").text(scratch.path("vocab")))
    return text.read_vocabulary(spark, scratch.path("vocab"), scratch)


@query("matrix_file",
       "WITH m AS (SELECT dense_rank() OVER (ORDER BY vec_id) - 1 AS row, unnest(range(len(embedding))) AS i, embedding "
       f"FROM embeddings) SELECT row, CAST(i AS INTEGER) AS col, {r_sql('CAST(embedding[i + 1] AS DOUBLE)', 5)} AS value FROM m")
def matrix_file(spark, d):
    scratch = Scratch(spark, "matrix-file")
    values = F.col("embedding").cast("array<double>").cast("array<string>")
    (table(spark, d, "embeddings").select("vec_id", F.array_join(values, " ").alias("value"))
     .repartitionByRange("vec_id").sortWithinPartitions("vec_id").select("value")
     .write.mode("overwrite").text(scratch.path("matrix")))
    return text.read_matrix(spark, scratch.path("matrix"), scratch).withColumn("value", rounded("value", 5))


@query("vector_file",
       "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx, "
       "l_extendedprice AS value FROM lineitem")
def vector_file(spark, d):
    scratch = Scratch(spark, "vector-file")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    (table(spark, d, "lineitem").select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
     .select(F.col("l_extendedprice").cast("string")).write.mode("overwrite").text(scratch.path("vector")))
    return text.read_vector(spark, scratch.path("vector"), scratch)


@query("sparse_json", f"WITH {BOW} SELECT doc_id, word_id, CAST(freq AS DOUBLE) AS value FROM bow")
def sparse_json(spark, d):
    """Every document's sparse row to a json object and back."""
    v = ops.document_vectors(corpus(spark, d).bow)
    packed = v.select("doc_id", scalars.sparse_to_json(F.col("words"), F.col("freqs").cast("array<double>")).alias("j"))
    return (packed.select("doc_id", F.explode(scalars.sparse_from_json(F.col("j"))).alias("word_id", "value")))
