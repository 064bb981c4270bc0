"""Blocks of whole documents with a bounded number of tokens, and the parameter rows each block needs.

A block is the unit a kernel works on.  Documents are spread over blocks by hash and never cut.  The number of blocks follows
from the size of the corpus and the number of topics alone, so a job gives the same result on any cluster.  Parameter rows
travel once per (block, word) pair, not once per (document, word) pair, and only the rows in use travel.
"""

from __future__ import annotations

import math
import uuid
import weakref
from contextlib import suppress

from pyspark.sql import Column, DataFrame, functions as F

from topicspark.session import Scratch

TOKENS_PER_BLOCK = 250_000
CELLS_PER_BLOCK = 20_000_000      # tokens times topics: what a kernel holds in one matrix (160 MB)
MAX_BUCKETS = 100_000             # Spark's own limit for one table; beyond it several blocks share a bucket


def block_count(n_tokens: int, n_topics: int = 1, tokens_per_block: int | None = None) -> int:
    """Enough blocks to bound the tokens, and the tokens times topics, of each."""
    size = tokens_per_block or max(1, min(TOKENS_PER_BLOCK, CELLS_PER_BLOCK // max(1, n_topics)))
    return math.ceil(max(1, n_tokens) / size)


def assign_blocks(rows: DataFrame, n_blocks: int) -> DataFrame:
    """Add `block`, by hash of the document."""
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int"))


def block_words(rows: DataFrame) -> DataFrame:
    return rows.select("block", "word_id").distinct()


def pull(words_of_blocks: DataFrame, params: DataFrame) -> DataFrame:
    """Parameter rows of each block's words.  A word used by nearly all blocks is a skewed key of at most one row per
    block; the adaptive skew join splits it."""
    return words_of_blocks.join(params, "word_id")


def _place(rows: DataFrame, n_blocks: int) -> DataFrame:
    """One partition per block; adaptive execution does not merge them, as a block is small in bytes but heavy in work."""
    return rows.repartitionById(n_blocks, F.col("block"))


def run_blocks(rows: DataFrame, params: DataFrame, n_blocks: int, kernel, schema: str) -> DataFrame:
    """Run a kernel on each block with its parameter rows."""
    # fresh column identities: the parameter side was derived from the same rows
    right = params.select(*[F.col(c).alias(c) for c in params.columns])
    return (_place(rows, n_blocks).groupBy("block").cogroup(_place(right, n_blocks).groupBy("block"))
            .applyInArrow(kernel, schema))


def _drop_entries(spark, names: dict[str, str]) -> None:
    if spark.sparkContext._jsc is not None:              # not after the session has ended
        for table in names.values():
            with suppress(Exception):
                spark.sql(f"DROP TABLE IF EXISTS {table}")


class BlockTables:
    """Tables that stay clustered by block from one iteration to the next.

    They are written as `n_buckets` buckets of `block`, so a kernel reads its block where it lies and only the parameter
    rows of the other side are shuffled.  `place` chooses block numbers that hash to buckets of their own, as far as there
    are that many; the list of numbers is no longer than `MAX_BUCKETS`.

    The catalog entries go with this object; the files stay, and frames made on the tables still read them.
    """

    def __init__(self, scratch: Scratch, n_blocks: int):
        self.scratch, self.n_blocks = scratch, n_blocks
        self.n_buckets = min(n_blocks, MAX_BUCKETS)
        self._names: dict[str, str] = {}
        weakref.finalize(self, _drop_entries, scratch.spark, self._names).atexit = False
        self._numbers: DataFrame | None = None

    def _block_numbers(self) -> DataFrame:
        """`(_bucket, _number)`: a number that hashes to each bucket."""
        if self._numbers is None:
            number = F.col("id").cast("int")
            bucket = F.pmod(F.hash(number), F.lit(self.n_buckets)).cast("int")
            spread = self.scratch.spark.range(32 * self.n_buckets).groupBy(bucket.alias("_bucket")).agg(F.min(number).alias("_number"))
            self._numbers = self.scratch.save(spread.coalesce(1), "block_numbers")
        return self._numbers

    def place(self, rows: DataFrame, near: Column | None = None) -> DataFrame:
        """`rows(doc_id, ...)` with `block`, whole blocks in the partitions that their buckets will have; `near` deals the documents to
        the blocks from 0 on, by hash if left out."""
        near = F.pmod(F.xxhash64("doc_id"), F.lit(self.n_blocks)) if near is None else near
        if self.n_blocks > self.n_buckets:
            numbered = rows.withColumn("block", near.cast("int"))
        else:
            numbered = (rows.withColumn("_bucket", near.cast("int")).join(F.broadcast(self._block_numbers()), "_bucket", "left")
                        .withColumn("block", F.coalesce("_number", -1 - F.col("_bucket"))).drop("_bucket", "_number"))
        return numbered.repartition(self.n_buckets, "block")

    def save(self, df: DataFrame, name: str) -> DataFrame:
        table = f"topicspark_{uuid.uuid4().hex}"
        (df.write.mode("overwrite").format("parquet").bucketBy(self.n_buckets, "block")
         .option("parquet.enable.dictionary", "false").option("path", self.scratch.path(name)).saveAsTable(table))
        self._names[name] = table
        return self.scratch.spark.table(table)

    def drop(self, name: str) -> None:
        self.scratch.spark.sql(f"DROP TABLE IF EXISTS {self._names.pop(name)}")
        self.scratch.drop(name)

    def drop_all(self) -> None:
        for name in list(self._names):
            self.drop(name)

    def release(self, name: str) -> DataFrame:
        """The table as plain files, without an entry in the catalog."""
        schema = self.scratch.spark.table(self._names[name]).schema
        self.scratch.spark.sql(f"DROP TABLE IF EXISTS {self._names.pop(name)}")
        return self.scratch.load(name, schema)

    def run(self, rows: DataFrame, params: DataFrame, kernel, schema: str) -> DataFrame:
        """Run a kernel on each block of a table of this class with its parameter rows."""
        right = params.select(*[F.col(c).alias(c) for c in params.columns])
        return rows.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(kernel, schema)
