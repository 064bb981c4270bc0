"""From raw documents to packed training sequences.

Stages, in order: quality rules reject documents; of each group of near duplicates one document stays; byte strings of 200
that repeat are cut out of all texts; secrets are replaced by a mark; the texts are tokenized and packed into sequences.
Every stage but the last returns the columns of `documents`; `n_chars` follows the text.

Cases: as in the operators' own descriptions.  A document whose text was cut out wholly goes on with an empty text.  An empty
table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from topicspark.llm import neardup, packing, quality_rules, repeats, secrets
from topicspark.llm.stages import Steps

END_ID = 1


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a rule learned from `labels` rejects go."""
    rules = quality_rules.learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality_rules.keeps(rules))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return neardup.one_of_each(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start more than once in the corpus are cut out."""
    out = repeats.without_repeats(docs, as_text=True)
    return _with_text(docs, out, F.col("kept"), F.col("row"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    out = secrets.without_secrets(docs)
    return _with_text(docs, out, F.col("text"), None)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)


def _with_text(docs: DataFrame, out: DataFrame, text, row) -> DataFrame:
    """The columns of `docs` with a new text and its number of characters."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[(new[c] if c in new else row[c] if row is not None else F.col(f"`{c}`")).alias(c) for c in docs.columns])


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_array_dedup", repeats_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]

# Learned rules, sketches and a tokenizer are not SQL: the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table `documents`, each written as Parquet and read again."""
    steps = Steps(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = steps.save(stage(spark, docs, sf_dir), f"{i}-{name}")
        steps.keep_only(f"{i}-{name}")
    return docs
