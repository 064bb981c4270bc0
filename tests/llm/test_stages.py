import pyarrow as pa
from pyspark.sql import functions as F

from topicspark.llm import stages


def test_python_steps_before_a_saved_table_get_rows_of_a_bounded_size(spark):
    """2,000 rows of 20 kB in one partition came as one batch of 40 MB."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    steps = stages.Steps(spark, "sizes")
    rows = spark.range(0, 2_000, 1, 1).select(F.repeat(F.lit("0123456789"), 2_000).alias("text"))
    seen = steps.save(rows.mapInArrow(sizes, "n bigint, bytes bigint"), "sizes").collect()
    assert sum(r["n"] for r in seen) == 2_000
    assert max(r["bytes"] for r in seen) < 2 * stages.BYTES_AT_ONCE
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
