"""Row numbers and running sums over groups that may hold a third of all rows.

A group is cut into ranges of a random key. Totals of the ranges are summed up first, then each
range by itself from its offset, so that no task holds a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, on average.
RANGE_ROWS = 50_000


def ranges_for(rows: int) -> int:
    """Number of ranges of a group of so many rows, a power of two."""
    return 1 << max(0, (rows // RANGE_ROWS).bit_length())


def running(df: DataFrame, group: list[str], key: str, value: str, ranges: int, tie: list[str]) -> DataFrame:
    """Add ``before``, the sum of ``value`` over the rows of the group with a smaller key.

    ``key`` is a bigint spread over its whole range, as a hash is; rows of equal key are ordered by
    ``tie``. The names ``before``, ``_range`` and ``_offset`` must be free.
    """
    bits = ranges.bit_length() - 1
    part = F.shiftrightunsigned(F.col(key), 64 - bits).cast("int") if bits else F.lit(0)
    # Unsigned ranges of a signed key: those from the middle on are the negative, smaller keys.
    placed = df.withColumn("_range", (part + (ranges >> 1)) % ranges if bits else part)
    order = Window.partitionBy(*group).orderBy("_range")
    totals = placed.groupBy(*group, "_range").agg(F.sum(value).alias("_t"))
    offsets = totals.select(*group, "_range", (F.sum("_t").over(order) - F.col("_t")).alias("_offset"))
    inner = Window.partitionBy(*group, "_range").orderBy(key, *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumn("before", F.sum(value).over(inner) - F.col(value))
    return summed.join(offsets, [*group, "_range"]).withColumn("before", F.col("before") + F.col("_offset")).drop("_range", "_offset")
