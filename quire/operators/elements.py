"""The stream of elements of each document: current rows, reading order and structure.

Every stack of the kind "pop while the top is as deep, then push" is a window: the last row of each
level before the current one is open if no shallower one came after it. Levels run from 1 to
:data:`LEVELS`. Null documents are left out; null levels count as 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.scan import page_keys, position, scan, with_block

LEVELS = 6
#: Tiers from the best.
TIERS = ("vision", "ocr", "text")


def latest(elements: DataFrame, spread: bool = False) -> DataFrame:
    """Of each place (doc, page, seq) the row extracted last; of equal times the greatest id.

    With ``spread`` the rows come spread by document and block of pages, named in ``_block``: what
    runs over pages, blocks or documents then moves them no more.
    """
    known = with_block(elements.filter(F.col("doc").isNotNull()))
    if spread:
        known = known.repartition("doc", "_block")
    order = Window.partitionBy(*page_keys(known), "seq").orderBy(F.col("extracted_at").desc_nulls_last(), F.col("element_id").desc())
    out = known.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return out if spread else out.drop("_block")


def best_tier(elements: DataFrame) -> DataFrame:
    """Of each page the body elements of its best tier, and its images whatever their tier."""
    return elements.withColumn("_kept", _is_best(elements)).filter("_kept").drop("_kept")


def _is_best(elements: DataFrame) -> Column:
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier")), F.lit(9))
    rank = F.when(rank == 0, 9).otherwise(rank)
    body = F.coalesce(F.col("type") != "image", F.lit(True))
    return ~body | (rank == F.min(F.when(body, rank)).over(Window.partitionBy(*page_keys(elements))))


def mark_best(elements: DataFrame) -> DataFrame:
    """Add ``best``: whether :func:`best_tier` keeps the row."""
    return elements.withColumn("best", _is_best(elements))


def _level() -> Column:
    return F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(LEVELS))


def _open(prefix: str, limit: Column) -> list[Column]:
    """Of the last rows by level those still open: deeper than none that came later, and above ``limit``."""
    out = []
    for k in range(1, LEVELS + 1):
        h = F.col(f"{prefix}{k}")
        above = [F.coalesce(F.col(f"{prefix}{j}.pos"), F.lit(-1)) for j in range(1, k)]
        still = h.isNotNull() & (h["pos"] > (F.greatest(F.lit(-1), *above) if above else F.lit(-1)))
        out.append(F.when(still & (limit > k), h))
    return out


def open_headings(elements: DataFrame) -> DataFrame:
    """Add ``path``, the headings above each element from the outermost, and ``parent_id``, the nearest one."""
    heading = F.col("type") == "heading"
    at = F.struct(position().alias("pos"), F.col("text").alias("text"), F.col("element_id").alias("id"))
    names = [f"_h{k}" for k in range(1, LEVELS + 1)]
    df = scan(elements, {n: F.when(heading & (_level() == k), at) for k, n in enumerate(names, 1)})
    stack = F.array_compact(F.array(*_open("_h", F.when(heading, _level()).otherwise(LEVELS + 1))))
    return df.withColumn("path", F.transform(stack, lambda h: h["text"])).withColumn("parent_id", F.get(stack, F.size(stack) - 1)["id"]).drop(*names)


def list_depths(elements: DataFrame) -> DataFrame:
    """Add ``depth``, the number of open shallower items in the run of list items; null for others."""
    item = F.col("type") == "list_item"
    names = [f"_l{k}" for k in range(1, LEVELS + 1)]
    at = F.struct(position().alias("pos"))
    df = scan(elements, {n: F.when(item & (_level() == k), at) for k, n in enumerate(names, 1)} | {"_stop": F.when(~item, position())})
    inside = {n: F.when(F.col(n)["pos"] > F.coalesce("_stop", F.lit(-1)), F.col(n)) for n in names}
    depth = sum((F.when(h.isNotNull(), 1).otherwise(0) for h in _open("_l", _level())), F.lit(0))
    return df.withColumns(inside).withColumn("depth", F.when(item, depth)).drop("_stop", *names)


def sections(elements: DataFrame, depth: int = 1) -> DataFrame:
    """Add ``section``, the number of headings down to ``depth`` so far: 0 before the first."""
    starts = (F.col("type") == "heading") & (F.col("level") <= depth)
    return scan(elements, sums={"section": F.when(starts, 1).otherwise(0)})


def section_titles(elements: DataFrame) -> DataFrame:
    """Level-1 sections: ``doc``, ``section``, ``title``, ``elements``, ``pages``, ``previous`` and ``next`` titles."""
    is_title = (F.col("type") == "heading") & (F.col("level") == 1)
    body = ~F.coalesce(is_title, F.lit(False))
    found = sections(elements).groupBy("doc", "section").agg(F.coalesce(F.max(F.when(is_title, F.col("text"))), F.lit("Front Matter")).alias("title"), F.count_if(body).alias("elements"), F.countDistinct(F.when(body, F.col("page_number"))).alias("pages"))
    order = Window.partitionBy("doc").orderBy("section")
    return found.withColumn("previous", F.lag("title").over(order)).withColumn("next", F.lead("title").over(order))


def sub_heading_levels(elements: DataFrame) -> DataFrame:
    """Level of sub-headings without one: one below the nearest heading above, at most :data:`LEVELS`."""
    heading = F.col("type") == "heading"
    df = scan(elements, {"_above": F.when(heading, F.col("level"))})
    given = F.least(F.coalesce("_above", F.lit(0)) + 1, F.lit(LEVELS))
    return df.withColumn("level", F.when(heading & F.col("level").isNull(), given).otherwise(F.col("level"))).drop("_above")
