"""Session settings and the shared scratch area used to cut lineage between iterations."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs in this package are written for.  All are runtime settings a cluster may override.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join whose output feeds an aggregate on the same key is still worth splitting.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A generated method above 8000 bytes of code is never compiled by the JVM; Spark then splits it instead.  Arithmetic
    # on one column per topic reaches that size soon.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app: str = "topicspark", master: str | None = None, shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """A session with the recommended settings; `master` and `shuffle_partitions` are for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(RECOMMENDED_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def arrow_batches(spark: SparkSession, n_bytes: int):
    """While this holds, plans that are run hand Python batches of about `n_bytes` at most, or of one row."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(n_bytes))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    Only a local-mode session without that setting gets a temporary folder; on a cluster a missing setting is
    an error, because a machine-local path would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    app_id = spark.sparkContext.applicationId
    if app_id not in _local_roots:
        _local_roots[app_id] = tempfile.mkdtemp(prefix="topicspark-")
    return _local_roots[app_id]


class Scratch:
    """Tables written once and read back, so that a plan after them starts from files and not from its history.

    Written tables survive the loss of executors, and their file sizes give the optimizer the statistics it needs to
    choose between a broadcast and a shuffled join.
    """

    def __init__(self, spark: SparkSession, name: str = "run", base: str | None = None):
        self.spark = spark
        self.base = base.rstrip("/") if base else f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))
        return self.load(name, df.schema)

    def load(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read
        if schema is not None:
            reader = reader.schema(schema)
        return reader.parquet(self.path(name))

    def _file(self, path: str):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def exists(self, name: str) -> bool:
        fs, target = self._file(self.path(name))
        return fs.exists(target)

    def drop(self, name: str) -> None:
        """Delete a superseded table of this run; an iteration keeps only the versions it can still need."""
        fs, target = self._file(self.path(name))
        fs.delete(target, True)

    def children(self, name: str) -> list[str]:
        """Names directly below a folder of this run (one entry per snapshot, not per row)."""
        fs, target = self._file(self.path(name))
        if not fs.exists(target):
            return []
        return sorted(status.getPath().getName() for status in fs.listStatus(target))


def local_parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)
