"""Checks of an output against a source of the same kind of elements, by page.

``source`` and ``output`` have the columns of elements; ``source`` is what was read from the native
format. Tables of a page are compared in their order: the first with the first, and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry

# Captions that say nothing, and how full a grid of a chart is at most.
GENERIC_CAPTIONS = ("image", "figure", "picture")
GRID_FILLED, CORNER_ARC, AXIS = 0.10, 12.0, 0.5
PAGE = ["doc", "page_number"]


def printed_caption() -> Column:
    """The caption unless ``caption_source`` says that it was written later; null counts as empty."""
    return F.coalesce("caption", F.lit(""))


def _shape(df: DataFrame, side: str) -> DataFrame:
    """Tables of each page with their place, number of rows, and widest and narrowest row."""
    rows = F.coalesce("rows", F.array().cast("array<array<string>>"))
    sizes = F.transform(rows, lambda r: F.coalesce(F.size(r), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy("seq", "element_id"))
    widths = (F.coalesce(F.array_max(sizes), F.lit(0)), F.coalesce(F.array_min(sizes), F.lit(0)))
    return df.filter("type = 'table'").select(*PAGE, place.alias("place"), F.struct(F.size(rows).alias("rows"), widths[0].alias("widest"), widths[1].alias("narrowest")).alias(side))


def table_corruption(source: DataFrame, output: DataFrame, exact: bool = False) -> DataFrame:
    """Pages whose tables differ from their source's: ``doc``, ``page_number``, ``tables`` (how many differ).

    Tables differ if one side lacks them, or by their number of rows or their widest row. With ``exact``,
    for sheets, every row of the output must be as wide as the source's widest one.
    """
    a, z = F.col("a"), F.col("z")
    met = _shape(source, "a").join(_shape(output, "z"), [*PAGE, "place"], "full")
    differs = a.isNull() | z.isNull() | (a["rows"] != z["rows"]) | (a["widest"] != z["widest"])
    if exact:
        differs |= z["narrowest"] != a["widest"]
    return met.filter(differs).groupBy(*PAGE).agg(F.count(F.lit(1)).alias("tables"))


def lost_images(source: DataFrame, output: DataFrame) -> DataFrame:
    """Pages with fewer images than their source: ``doc``, ``page_number``, ``lost``."""
    one = F.when(F.col("type") == "image", 1).otherwise(0)
    both = source.select(*PAGE, one.alias("n")).unionAll(output.select(*PAGE, -one))
    return both.groupBy(*PAGE).agg(F.sum("n").alias("lost")).filter("lost > 0")


def generic_captions(output: DataFrame) -> DataFrame:
    """Images whose caption is a mere word for image."""
    plain = F.lower(F.trim(printed_caption()))
    return output.filter((F.col("type") == "image") & plain.isin(*GENERIC_CAPTIONS)).select("element_id", *PAGE, "caption")


def page_issues(dropped: DataFrame, tables: DataFrame, images: DataFrame, captions: DataFrame, headings: DataFrame) -> DataFrame:
    """Issues of each page by name, sorted: ``doc``, ``page_number``, ``issues``; pages without any are left out."""
    named = {"dropped_text": dropped, "table_corruption": tables, "missing_image": images, "bad_caption": captions, "wrong_heading_level": headings}
    parts = [df.select(*PAGE, F.lit(name).alias("issue")) for name, df in named.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return every.groupBy(*PAGE).agg(F.array_sort(F.collect_set("issue")).alias("issues"))


def grid_tables(tables: DataFrame, items: DataFrame, tolerance: float = geometry.MATCH) -> DataFrame:
    """Tables that are the grid of a chart: ``doc``, ``page_number``, ``table_id``, ``why``.

    ``tables`` has ``table_id``, ``bbox``, ``cells`` (boxes) and ``filled`` (share of cells with text); ``items``
    has ``drawing_id``, ``op`` (``line``, ``rect``, ``curve`` or another) and ``bbox``. Hardly filled tables are
    grids; so are those that a drawing crosses: its items off the cells' borders, each cut to the table,
    together reach into the table and stay in no single cell.
    """
    box, item = F.col("bbox"), F.col("_item")
    edges = lambda f, g: F.array_distinct(F.concat(F.transform("cells", f), F.transform("cells", g)))
    with_edges = tables.withColumns({"_xs": edges(geometry.x0, geometry.x1), "_ys": edges(geometry.y0, geometry.y1)})
    near = lambda v, name: F.exists(F.col(name), lambda e: F.abs(e - v) <= tolerance)
    met = with_edges.filter(F.size("cells") > 0).join(items.select(*PAGE, "drawing_id", "op", F.col("bbox").alias("_item")), PAGE)
    cut = F.array(F.greatest(geometry.x0(item), geometry.x0(box)), F.greatest(geometry.y0(item), geometry.y0(box)), F.least(geometry.x1(item), geometry.x1(box)), F.least(geometry.y1(item), geometry.y1(box)))
    met = met.withColumn("_cut", cut).filter((geometry.x0(F.col("_cut")) <= geometry.x1(F.col("_cut"))) & (geometry.y0(F.col("_cut")) <= geometry.y1(F.col("_cut"))))
    flat, upright = geometry.y1(item) - geometry.y0(item) <= AXIS, geometry.x1(item) - geometry.x0(item) <= AXIS
    c = F.col("_cut")
    on_line = (flat & near(geometry.y0(item), "_ys")) | (upright & near(geometry.x0(item), "_xs"))
    on_rect = near(geometry.x0(c), "_xs") & near(geometry.x1(c), "_xs") & near(geometry.y0(c), "_ys") & near(geometry.y1(c), "_ys")
    within = lambda a, b, t: (geometry.x0(a) >= geometry.x0(b) - t) & (geometry.y0(a) >= geometry.y0(b) - t) & (geometry.x1(a) <= geometry.x1(b) + t) & (geometry.y1(a) <= geometry.y1(b) + t)
    small = (geometry.x1(item) - geometry.x0(item) <= CORNER_ARC) & (geometry.y1(item) - geometry.y0(item) <= CORNER_ARC)
    corner = F.lit(False)
    for x in (geometry.x0(box), geometry.x1(box)):
        for y in (geometry.y0(box), geometry.y1(box)):
            corner |= within(item, F.array(x - CORNER_ARC, y - CORNER_ARC, x + CORNER_ARC, y + CORNER_ARC), tolerance)
    on = F.when(F.col("op") == "line", on_line).when(F.col("op") == "rect", on_rect).when(F.col("op") == "curve", small & corner).otherwise(False)
    off = met.filter(~on).groupBy(*PAGE, "table_id", "drawing_id").agg(
        F.array(F.min(geometry.x0(c)), F.min(geometry.y0(c)), F.max(geometry.x1(c)), F.max(geometry.y1(c))).alias("_union"), F.first("bbox").alias("bbox"), F.first("cells").alias("cells")
    )
    u = F.col("_union")
    crossing = off.filter((geometry.overlap_ratio(u, box) > 0) & ~F.exists("cells", lambda cell: within(u, cell, tolerance))).select(*PAGE, "table_id", F.lit("series").alias("why"))
    empty = tables.filter(F.col("filled") <= GRID_FILLED).select(*PAGE, "table_id", F.lit("empty").alias("why"))
    return empty.unionAll(crossing).groupBy(*PAGE, "table_id").agg(F.min("why").alias("why"))
