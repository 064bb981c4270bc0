"""Online variational Bayes fed by a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from topicspark.plans import online_vb
from topicspark.plans.minibatch import Versions, start_model
from topicspark.session import Scratch

STREAM_SCHEMA = "doc_id long, words array<int>, freqs array<int>"


def document_stream(spark, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Documents `(doc_id, words, freqs)` as they arrive in a folder; one trigger takes the next files."""
    return (spark.readStream.schema(STREAM_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(path))


def train_stream(stream: DataFrame, words: DataFrame, n_words: int, n_docs: int, cfg: online_vb.OnlineVB, base: str,
                 checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Update the model once per micro-batch; `n_docs` is the corpus size given up front.

    `trigger` holds the arguments of Spark's trigger, as `{"processingTime": "1 minute"}` for a stream that goes on; by
    default all that has arrived is taken and the query ends.  A model folder belongs to the checkpoint folder it was begun
    with: batch numbers start again in another one and would overwrite its versions.

    Micro-batch b reads version b and writes version b + 1, so a batch that is replayed after a failure overwrites its own
    result and leaves the same model.
    """
    scratch = Scratch(stream.sparkSession, "stream", base=base)
    versions = Versions(scratch, keep_all=True)
    if scratch.exists("owner"):
        owner = scratch.load("owner").first()["checkpoint"]
        if owner != checkpoint:
            raise ValueError(f"{base} is trained from the checkpoint {owner}, not {checkpoint}")
    else:
        scratch.save(stream.sparkSession.createDataFrame([(checkpoint,)], "checkpoint string"), "owner")
    if versions.latest() is None:
        versions.save(start_model(words, cfg.n_topics, cfg.seed, cfg.init), 0)

    def step(batch: DataFrame, batch_id: int) -> None:
        docs = batch.select("doc_id", F.explode(F.arrays_zip("words", "freqs")).alias("t"))
        bow = scratch.save(docs.select("doc_id", F.col("t.words").alias("word_id"), F.col("t.freqs").alias("freq")),
                           f"batch-{batch_id:06d}/bow")
        lengths = scratch.save(batch.select(
            "doc_id", F.size("words").cast("long").alias("n_terms"),
            F.aggregate("freqs", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("n_tokens")),
            f"batch-{batch_id:06d}/docs")
        if lengths.isEmpty():
            versions.save(versions.load(batch_id), batch_id + 1)
            scratch.drop(f"batch-{batch_id:06d}")
            return
        nxt, rows = online_vb.update(bow, lengths, versions.load(batch_id), batch_id, n_docs, n_words, cfg, scratch)
        versions.save(nxt, batch_id + 1)
        for t, kind, value in rows:
            scratch.save(stream.sparkSession.createDataFrame([(t, kind, float(value))], "t int, kind string, value double"),
                         f"metrics/t={t:06d}")
        scratch.drop(f"batch-{batch_id:06d}")
        scratch.drop(f"estep-{batch_id:06d}")

    return (stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def fitted_model(spark, base: str) -> DataFrame:
    """The newest completely written model of a streaming run."""
    versions = Versions(Scratch(spark, "stream", base=base), keep_all=True)
    return versions.load(versions.latest())
