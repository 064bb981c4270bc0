"""Dense 0-based row numbers without sending all rows through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from topicspark.session import Scratch

_MAX_BROADCAST_PARTS = 1_000_000
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number inside a partition in its low 33 bits


def _add_offsets(staged: DataFrame, part_cols: list[str], local_pos: Column, name: str, scratch: Scratch,
                 label: str) -> DataFrame:
    """Position = rows in all earlier parts + position inside the part.

    The unpartitioned window runs over one row per part (a shuffle partition or a file split), never over data rows.  The
    offsets are broadcast when there are at most a million parts, which is counted; a join on the part would otherwise
    move every row of a part together.
    """
    before = Window.orderBy(*part_cols).rowsBetween(Window.unboundedPreceding, -1)
    parts = (staged.groupBy(*part_cols)
             .agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"))
             .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
             .drop("_n"))
    parts = scratch.save(parts, f"{label}_parts")
    if parts.count() <= _MAX_BROADCAST_PARTS:
        parts = F.broadcast(parts)
    return (staged.join(parts, part_cols)
            .withColumn(name, (F.col("_before") + local_pos).cast("long"))
            .drop("_before", "_first", "_mono", *part_cols))


def dense_index(df: DataFrame, order_by: list[str], name: str, scratch: Scratch, label: str = "indexed") -> DataFrame:
    """Number rows 0..n-1 in the order of a unique key: range partition, sort, count per partition, add offsets."""
    ranged = (df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
              .withColumn("_mono", F.monotonically_increasing_id()))
    staged = scratch.save(ranged, label)
    staged = staged.withColumn("_part", F.shiftright("_mono", _LOCAL_BITS))
    return _add_offsets(staged, ["_part"], F.col("_mono").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)), name, scratch,
                        label)


def line_index(lines: DataFrame, name: str, scratch: Scratch, label: str = "lines") -> DataFrame:
    """Number the lines of text files in (file, position in file) order, with no shuffle of the lines themselves.

    `lines` must carry `_file` and `_split` from the scan's `_metadata`; a line's number is the count of lines in
    earlier splits plus its place in its own split.
    """
    staged = scratch.save(lines.withColumn("_mono", F.monotonically_increasing_id()), label)
    return _add_offsets(staged, ["_file", "_split"], F.col("_mono") - F.col("_first"), name, scratch, label)
