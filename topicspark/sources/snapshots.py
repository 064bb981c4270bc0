"""Model snapshots, hyper-parameters and keyed outputs.

Parquet is the working form.  The text form has lines `k<TAB>first word<TAB>json array` for runs of RUN consecutive words, in
order of topic and word over the part files, at every size of the vocabulary; a line has about 1.3 MB.  The export for programs
that want one line per topic, `k<TAB>json array`, takes at most LINE_WORDS words, about 200 MB a line, and refuses more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from topicspark.functions.scalars import vector_from_json, vector_to_json
from topicspark.operators.counts import long_form

MODEL_SCHEMA = "word_id int, params array<double>"
RUN = 65_536
LINE_WORDS = 10_000_000


def write_model(model: DataFrame, path: str, t: int) -> str:
    """Write `(word_id, params)` below `path/t=<n>`, replacing what is there."""
    target = f"{path}/t={t:06d}"
    model.select("word_id", "params").write.mode("overwrite").parquet(target)
    return target


def read_model(spark: SparkSession, path: str, t: int) -> DataFrame:
    return spark.read.schema(MODEL_SCHEMA).parquet(f"{path}/t={t:06d}")


def read_all_versions(spark: SparkSession, path: str) -> DataFrame:
    """All snapshots with their step number `t`; a condition on `t` reads only that version's files."""
    return spark.read.schema(MODEL_SCHEMA + ", t int").parquet(path)


def _ordered_json(rows: DataFrame, *keys: str) -> DataFrame:
    """`(keys, first, value)`: the parameters of each group in word order, as json text, and the first word."""
    ordered = F.sort_array(F.collect_list(F.struct("word_id", "value")))
    grouped = rows.groupBy(*keys).agg(ordered.alias("t"))
    return grouped.select(*keys, F.get("t.word_id", F.lit(0)).alias("first"), vector_to_json(F.col("t.value")).alias("value"))


def topic_runs(model: DataFrame) -> DataFrame:
    """`(topic, first, value)`: a row per topic and run of RUN words; `first` is the first word of the run.

    Word numbers must be dense, as those of a vocabulary are.
    """
    rows = long_form(model, "params").withColumn("run", F.floor(F.col("word_id") / RUN))
    return _ordered_json(rows, "topic", "run").drop("run")


def write_topic_runs(model: DataFrame, path: str) -> None:
    runs = topic_runs(model).repartitionByRange("topic", "first").sortWithinPartitions("topic", "first")
    runs.select(F.concat_ws("\t", F.col("topic").cast("string"), F.col("first").cast("string"), "value")).write.mode("overwrite").text(path)


def read_topic_runs(spark: SparkSession, path: str) -> DataFrame:
    """`(topic, word_id, value)` from every part file of a snapshot in runs."""
    parts = F.split("value", "\t")
    # a line is taken apart before it is exploded; beside the explode this would be done again for every word
    lines = spark.read.text(path).select(F.get(parts, F.lit(0)).cast("int").alias("topic"), F.get(parts, F.lit(1)).cast("int").alias("first"),
                                         vector_from_json(F.get(parts, F.lit(2))).alias("_values"))
    return (lines.select("topic", "first", F.posexplode("_values").alias("k", "value"))
            .select("topic", (F.col("first") + F.col("k")).alias("word_id"), "value"))


def topic_lines(model: DataFrame) -> DataFrame:
    """`(topic, value)`: the parameters of a topic in word order, as json text; a topic is one row of one task.

    Word numbers must be dense, as those of a vocabulary are.
    """
    return _ordered_json(long_form(model, "params"), "topic").drop("first")


def write_topic_text(model: DataFrame, path: str) -> None:
    """The export of one line per topic; a vocabulary of over LINE_WORDS words is refused."""
    n = model.count()
    if n > LINE_WORDS:
        raise ValueError(f"{n} words do not go into one line (at most {LINE_WORDS}); use write_topic_runs")
    topic_lines(model).select(F.concat_ws("\t", F.col("topic").cast("string"), "value")).write.mode("overwrite").text(path)


def read_topic_text(spark: SparkSession, path: str) -> DataFrame:
    """`(topic, word_id, value)` from every part file of an export of one line per topic."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).select(F.get(parts, F.lit(0)).cast("int").alias("topic"),
                                         vector_from_json(F.get(parts, F.lit(1))).alias("_values"))
    return lines.select("topic", F.posexplode("_values").alias("word_id", "value"))


def write_vector_text(vector: DataFrame, path: str) -> None:
    """`topic<TAB>value` lines."""
    vector.select(F.concat_ws("\t", F.col("topic").cast("string"), F.col("value").cast("string"))) \
        .write.mode("overwrite").text(path)


def read_vector_text(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", "\t")
    return spark.read.text(path).select(parts[0].cast("int").alias("topic"), parts[1].cast("double").alias("value"))


def write_params(spark: SparkSession, path: str, alpha: list[float], **scalars: float) -> None:
    """One row: alpha as an array and any further hyper-parameters by name."""
    names = ", ".join(["alpha array<double>"] + [f"{n} double" for n in scalars])
    spark.createDataFrame([(list(map(float, alpha)), *map(float, scalars.values()))], names) \
        .coalesce(1).write.mode("overwrite").parquet(path)


def read_alpha(spark: SparkSession, path: str, n_topics: int, default: float | None = None) -> list[float]:
    """The stored alpha; if nothing is stored and a default is given, that for every topic."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if not found and default is not None:
        return [default] * n_topics
    return list(spark.read.parquet(path).first()["alpha"])


def write_alpha_json(spark: SparkSession, path: str, alpha: list[float]) -> None:
    """Alpha alone, as one line of json text."""
    spark.createDataFrame([(list(map(float, alpha)),)], "alpha array<double>") \
        .select(vector_to_json(F.col("alpha"))).coalesce(1).write.mode("overwrite").text(path)


def read_alpha_json(spark: SparkSession, path: str) -> list[float]:
    return list(spark.read.text(path).select(vector_from_json(F.col("value")).alias("a")).first()["a"])


def write_by_kind(rows: DataFrame, path: str) -> None:
    """One folder per value of `kind`."""
    rows.write.mode("overwrite").partitionBy("kind").parquet(path)


def read_kind(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Only the files of one kind are read."""
    return spark.read.parquet(path).where(F.col("kind") == kind).drop("kind")


def read_named_files(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Text files below a folder whose name contains `name`."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{name}*").text(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").parquet(path)
