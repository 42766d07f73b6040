"""Running values over the rows of a document, without a task that holds a document.

A document is cut into blocks of pages. A window runs over each block; the last values and totals of
the blocks, one small row each, are carried on in a second window and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_PAGES = 64


def with_block(df: DataFrame) -> DataFrame:
    """Add ``_block``, the number of the row's block of pages, if it is not there."""
    return df if "_block" in df.columns else df.withColumn("_block", F.floor(F.coalesce("page_number", F.lit(0)) / BLOCK_PAGES))


def page_keys(df: DataFrame) -> list[str]:
    """Columns that name a page; with its block where known, so that rows spread by block are not moved again."""
    return ["doc", "_block", "page_number"] if "_block" in df.columns else ["doc", "page_number"]


def position() -> Column:
    """Place of a row in its document, as one number."""
    return F.shiftleft(F.coalesce("page_number", F.lit(0)).cast("bigint"), 32) + F.coalesce("seq", F.lit(0))


def scan(df: DataFrame, before: dict[str, Column] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """Add running columns in the order of page, place and ``element_id``.

    ``before``: the last value that is not null among the rows strictly before. ``sums``: the sum
    up to and including the row. Names that start with ``_`` must be free.
    """
    before, sums = before or {}, sums or {}
    values = {f"_v{i}": c for i, c in enumerate([*before.values(), *sums.values()])}
    last = dict(zip(before, values))
    total = dict(zip(sums, list(values)[len(before) :]))
    rows = with_block(df.withColumns(values))
    order = [position(), F.col("element_id")]
    inner = Window.partitionBy("doc", "_block").orderBy(*order)
    past = inner.rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(position().alias("p"), F.col("element_id").alias("e"))
    ends = rows.groupBy("doc", "_block").agg(
        *[F.max_by(F.when(F.col(v).isNotNull(), F.struct(F.col(v).alias("v"))), F.when(F.col(v).isNotNull(), at)).alias(f"_e{v}") for v in last.values()],
        *[F.sum(v).alias(f"_e{v}") for v in total.values()],
        F.lit(1).alias("_one"),
    )
    blocks = Window.partitionBy("doc").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("doc", "_block", *[F.last(f"_e{v}", ignorenulls=True).over(blocks).alias(f"_c{v}") for v in last.values()], *[F.sum(f"_e{v}").over(blocks).alias(f"_c{v}") for v in total.values()])
    out = rows.withColumns({f"_w{v}": F.last(F.when(F.col(v).isNotNull(), F.struct(F.col(v).alias("v"))), ignorenulls=True).over(past) for v in last.values()})
    out = out.withColumns({f"_w{v}": F.sum(v).over(inner) for v in total.values()}).join(carried, ["doc", "_block"], "left")
    out = out.withColumns({n: F.coalesce(f"_w{v}", f"_c{v}")["v"] for n, v in last.items()})
    out = out.withColumns({n: F.coalesce(f"_w{v}", F.lit(0)) + F.coalesce(f"_c{v}", F.lit(0)) for n, v in total.items()})
    return out.drop(*([] if "_block" in df.columns else ["_block"]), *values, *[f"_w{v}" for v in values], *[f"_c{v}" for v in values])
