"""Joins with keys that one side may hold in masses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut

#: Rows up to which a side of a few narrow columns is broadcast; some 20 MB.
BROADCAST_ROWS = 200_000
#: Parts that the rows of one key are spread over otherwise.
SALTS = 32


def join_small(df: DataFrame, small: DataFrame, on: str, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``df`` with a frame that has each value of ``on`` once, without gathering a hot key.

    ``small`` is written and counted first. Up to ``limit`` rows it is broadcast; beyond, its rows
    are repeated for each of :data:`SALTS` parts and ``df`` is joined by key and part. ``how`` is
    ``inner``, ``left``, ``left_semi`` or ``left_anti``; null keys match nothing.
    """
    small = cut(small)
    if small.count() <= limit:
        return df.join(F.broadcast(small), on, how)
    parts = small.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = df.withColumn("_part", (F.monotonically_increasing_id() % SALTS).cast("int"))
    return salted.join(parts, [on, "_part"], how).drop("_part")
