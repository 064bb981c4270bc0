"""Registry of queries with their SQL twins, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from topicspark.functions.special import digamma_sql
from topicspark.plans.minibatch import Batches, prepare_batches
from topicspark.session import Scratch
from topicspark.sources.raw import Corpus, corpus_from_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

K = 4            # topics in the registered queries
SEED = 7


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is what another engine must get from the same tables."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Prepared inputs, written once per session and input folder: most queries start from the same encoded corpus.
_prepared: dict[tuple, object] = {}


def _once(spark: SparkSession, key: tuple, make):
    full = (spark.sparkContext.applicationId, *key)
    if full not in _prepared:
        _prepared[full] = make()
    return _prepared[full]


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Vocabulary and bag of words of the whole `documents` table, every term kept."""
    return _once(spark, ("corpus", sf_dir), lambda: corpus_from_text(table(spark, sf_dir, "documents")))


def vocabulary_size(spark: SparkSession, sf_dir: str) -> int:
    return _once(spark, ("V", sf_dir), lambda: corpus(spark, sf_dir).vocabulary_size())


def batches(spark: SparkSession, sf_dir: str, parts: int) -> Batches:
    """The corpus in `parts` minibatches (the last one may be shorter)."""

    def make():
        docs = table(spark, sf_dir, "documents").select("doc_id")
        c = corpus(spark, sf_dir)
        return prepare_batches(c.bow, vocabulary_size(spark, sf_dir), -(-docs.count() // parts),
                               Scratch(spark, "batches"), docs)

    return _once(spark, ("batches", sf_dir, parts), make)


def rounded(c, digits: int = 6) -> Column:
    """Rounded, with minus zero made zero."""
    return F.round(c, digits) + F.lit(0.0)


def r_sql(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0e0)"


def u_sql(seed: int, *keys: str) -> str:
    parts = ", ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"(('0x' || substr(md5(concat_ws(':', {parts})), 1, 8))::BIGINT / 4294967296e0)"


def near_one_sql(seed: int, *keys: str) -> str:
    return f"(1e0 + 1.7320508075688773e-1 * (2e0 * {u_sql(seed, *keys)} - 1e0))"


dig = digamma_sql

# Common table expressions over the raw text.
TOKENS = ("tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM documents)")
COUNTS = TOKENS + ", cnt AS MATERIALIZED (SELECT doc_id, term, CAST(count(*) AS INTEGER) AS freq FROM tok GROUP BY doc_id, term)"
VOCAB = COUNTS + (", vocab AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS word_id, term, df "
                  "FROM (SELECT term, count(*) AS df FROM cnt GROUP BY term))")
BOW = VOCAB + ", bow AS (SELECT c.doc_id, v.word_id, c.freq FROM cnt c JOIN vocab v USING (term))"
# one row per token with its uniform topic
ASSIGNED = BOW + (
    ", assigned AS (SELECT doc_id, word_id, occ, CAST(floor(" + u_sql(SEED, "doc_id", "word_id", "occ") +
    f" * {K}) AS INTEGER) AS topic FROM (SELECT doc_id, word_id, unnest(range(freq)) AS occ FROM bow))")
TW = ASSIGNED + ", tw AS (SELECT topic, word_id, count(*) AS n FROM assigned GROUP BY topic, word_id)"
DT = ASSIGNED + ", dt AS (SELECT doc_id, topic, count(*) AS n FROM assigned GROUP BY doc_id, topic)"
POSITIONS = "pos AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_pos FROM documents)"
MATRIX = ("m AS (SELECT vec_id AS row, CAST(i AS INTEGER) AS col, CAST(embedding[i + 1] AS DOUBLE) AS value "
          "FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings))")
