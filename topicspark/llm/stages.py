"""Tables between the steps of a multi-step operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from topicspark.session import Scratch, arrow_batches

BYTES_AT_ONCE = 4 << 20        # of rows that Spark hands a Python step at a time: it holds several copies of them outside its heap
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Steps(Scratch):
    """Scratch tables in the shared folder; the shuffle files behind a written table are released at once, and Python
    steps before it get rows of a bounded size at a time, however many of them are short or long."""

    def __init__(self, spark: SparkSession, name: str):
        super().__init__(spark, name)

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            with arrow_batches(self.spark, BYTES_AT_ONCE):
                return super().save(df, name, partition_by)
        finally:
            self.spark.conf.set(_CLEANUP, before)

    def keep_only(self, *names: str) -> None:
        """Deletes the tables of this run that nothing reads any more."""
        for name in self.children(""):
            if name not in names:
                self.drop(name)
