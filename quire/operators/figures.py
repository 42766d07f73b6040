"""Figures of a page from its drawings: regions, what is left out and why, panels, labels, captions, frames.

``drawings``: ``doc``, ``page_number``, ``drawing_id``, ``kind``, ``bbox``, ``fill`` (channels from 0 to 1, or
null) and ``stroked``. Pages are small; regions of a page are a grouped stage, the rest are joins on
(doc, page) and expressions. Nothing is dropped without a row that says why.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.operators.layout import components
from quire.session import shipped

FRAME, TINY, BAND_SHARE, TABLE_OVERLAP, PADDING, WHITE = 0.6, 0.01, 0.5, 0.3, 10.0, 0.98
LABEL_CHARS, LABEL_WORDS, LABEL_GAP = 16, 2, 6.0
PANEL_SHARE, PANEL_BITMAPS, PANEL_TOLERANCE = 0.3, 2, 1.0
CAPTION_GAP, TEXT_BOX_DRAWINGS = 72.0, 4


def invisible() -> Column:
    """Drawings filled white without a stroke."""
    return F.col("fill").isNotNull() & F.forall("fill", lambda c: c >= WHITE) & ~F.coalesce("stroked", F.lit(False))


def _clusters(drawings: DataFrame, gap: float) -> DataFrame:
    """``doc``, ``page_number``, ``drawing_id``, ``region``: drawings that touch, directly or through others."""
    return components(drawings, "drawing_id", gap).select("doc", "page_number", "drawing_id", F.col("component").alias("region"))


def regions(drawings: DataFrame, tables: DataFrame, lines: DataFrame, repeated: DataFrame, width: float, height: float, gap: float = 0.0) -> DataFrame:
    """Regions of drawings: ``doc``, ``page_number``, ``region``, ``bbox`` (padded), ``drawings`` and ``reason``.

    ``reason`` is null for a figure, else why it is none: ``invisible_drawing``, ``frame_drawing``,
    ``repeated_drawing`` (``repeated``: ``doc``, ``bbox``), ``tiny``, ``text_box``, ``furniture_band`` or
    ``table_overlap`` (``tables``: ``doc``, ``page_number``, ``bbox``). The first that holds counts.
    """
    area = width * height
    box = F.col("bbox")
    known = repeated.select("doc", F.col("bbox").alias("_r")).groupBy("doc").agg(F.collect_list("_r").alias("_repeated"))
    single = drawings.join(known, "doc", "left")
    again = F.exists(F.coalesce("_repeated", F.array().cast("array<array<double>>")), lambda r: g.matches(box, r))
    lone = F.when(invisible(), "invisible_drawing").when(g.area(box) > FRAME * area, "frame_drawing").when(again, "repeated_drawing")
    single = single.withColumn("reason", lone).drop("_repeated")
    out = single.filter("reason is not null").select("doc", "page_number", F.col("drawing_id").alias("region"), "bbox", F.lit(1).cast("bigint").alias("drawings"), "reason")
    rest = single.filter("reason is null").drop("reason")
    joined = rest.join(_clusters(rest.select("doc", "page_number", "drawing_id", "bbox"), gap), ["doc", "page_number", "drawing_id"])
    r = joined.groupBy("doc", "page_number", "region").agg(F.array(F.min(g.x0(box)), F.min(g.y0(box)), F.max(g.x1(box)), F.max(g.y1(box))).alias("bbox"), F.count(F.lit(1)).alias("drawings"), F.bool_and(F.col("kind") == "rect").alias("_rects"))
    band = F.lit(g.BAND * height)
    y0, y1 = g.y0(box), g.y1(box)
    in_bands = (F.greatest(F.lit(0.0), F.least(y1, band) - y0) + F.greatest(F.lit(0.0), y1 - F.greatest(y0, height - band))) / F.greatest(y1 - y0, F.lit(1e-9))
    t = tables.select("doc", "page_number", F.col("bbox").alias("_t"))
    met = r.select("doc", "page_number", "region", "bbox").join(t, ["doc", "page_number"]).filter((g.overlap_ratio(box, F.col("_t")) > TABLE_OVERLAP) | (g.overlap_ratio(F.col("_t"), box) > TABLE_OVERLAP))
    met = met.select("doc", "page_number", "region").distinct().withColumn("_table", F.lit(True))
    text = lines.select("doc", "page_number", F.col("bbox").alias("_l"))
    boxed = r.select("doc", "page_number", "region", "bbox").join(text, ["doc", "page_number"]).filter(g.overlap_ratio(F.col("_l"), box) > 0.5).select("doc", "page_number", "region").distinct().withColumn("_text", F.lit(True))
    r = r.join(met, ["doc", "page_number", "region"], "left").join(boxed, ["doc", "page_number", "region"], "left")
    yes = lambda n: F.coalesce(n, F.lit(False))
    why = F.when(g.area(box) < TINY * area, "tiny").when(yes("_text") & F.col("_rects") & (F.col("drawings") <= TEXT_BOX_DRAWINGS), "text_box").when(in_bands > BAND_SHARE, "furniture_band").when(yes("_table"), "table_overlap")
    padded = F.array(F.greatest(g.x0(box) - PADDING, F.lit(0.0)), F.greatest(y0 - PADDING, F.lit(0.0)), F.least(g.x1(box) + PADDING, F.lit(width)), F.least(y1 + PADDING, F.lit(height)))
    return r.select("doc", "page_number", "region", F.when(why.isNull(), padded).otherwise(box).alias("bbox"), "drawings", why.alias("reason")).unionByName(out)


def absorb_labels(figures: DataFrame, lines: DataFrame) -> DataFrame:
    """Figures (``doc``, ``page_number``, ``region``, ``bbox``) grown by short labels close to their edge.

    Each label goes to the nearest figure; a figure's box is the union with all of its labels.
    """
    l, b = F.col("_l"), F.col("bbox")
    short = (F.length(F.trim("text")) <= LABEL_CHARS) & (F.size(F.split(F.trim("text"), r"\s+")) <= LABEL_WORDS) & (F.trim("text") != "")
    labels = lines.filter(short).select("doc", "page_number", F.monotonically_increasing_id().alias("_id"), F.col("bbox").alias("_l"))
    dx = F.greatest(g.x0(l) - g.x1(b), g.x0(b) - g.x1(l), F.lit(0.0))
    dy = F.greatest(g.y0(l) - g.y1(b), g.y0(b) - g.y1(l), F.lit(0.0))
    near = labels.join(figures.select("doc", "page_number", "region", "bbox"), ["doc", "page_number"]).withColumn("_d", F.greatest(dx, dy)).filter(F.col("_d") <= LABEL_GAP)
    own = near.groupBy("doc", "page_number", "_id").agg(F.min_by(F.struct("region", "_l"), F.struct("_d", "region")).alias("m")).select("doc", "page_number", "m.*")
    grown = own.groupBy("doc", "page_number", "region").agg(F.min(g.x0(l)).alias("a"), F.min(g.y0(l)).alias("b"), F.max(g.x1(l)).alias("c"), F.max(g.y1(l)).alias("d"))
    out = figures.join(grown, ["doc", "page_number", "region"], "left")
    union = F.array(F.least(g.x0(b), "a"), F.least(g.y0(b), "b"), F.greatest(g.x1(b), "c"), F.greatest(g.y1(b), "d"))
    return out.withColumn("bbox", union).drop("a", "b", "c", "d")


def bitmap_panels(bitmaps: DataFrame, panels: DataFrame, page_area: float) -> DataFrame:
    """Panels that hold at least two bitmaps: each bitmap counts for the smallest panel around it."""
    p, b = F.col("_p"), F.col("bbox")
    small = panels.filter(g.area(F.col("bbox")) <= PANEL_SHARE * page_area).select("doc", "page_number", F.col("drawing_id").alias("panel"), F.col("bbox").alias("_p"))
    inside = (g.x0(b) >= g.x0(p) - PANEL_TOLERANCE) & (g.y0(b) >= g.y0(p) - PANEL_TOLERANCE) & (g.x1(b) <= g.x1(p) + PANEL_TOLERANCE) & (g.y1(b) <= g.y1(p) + PANEL_TOLERANCE)
    met = bitmaps.select("doc", "page_number", "bitmap_id", "bbox").join(small, ["doc", "page_number"]).filter(inside)
    own = met.groupBy("doc", "page_number", "bitmap_id").agg(F.min_by(F.struct("panel", "_p"), F.struct(g.area(p), "panel")).alias("m")).select("doc", "page_number", "bitmap_id", "m.*")
    return own.groupBy("doc", "page_number", "panel").agg(F.first("_p").alias("bbox"), F.count(F.lit(1)).alias("bitmaps")).filter(F.col("bitmaps") >= PANEL_BITMAPS)


def split_captions(lines: DataFrame) -> DataFrame:
    """Captions whose number and title are two lines at one height: ``line_id``, ``title_id``, ``text``."""
    number = lines.filter(F.trim("text").rlike(r"(?i)^(figure|fig\.?|table)\s+\d+\.?:?$")).select("doc", "page_number", "line_id", F.col("text").alias("_n"), F.col("bbox").alias("_b"))
    t, n = F.col("bbox"), F.col("_b")
    gap = g.x0(t) - g.x1(n)
    met = number.join(lines.select("doc", "page_number", F.col("line_id").alias("title_id"), "text", "bbox"), ["doc", "page_number"]).filter((F.abs(g.y0(t) - g.y0(n)) <= g.MATCH) & gap.between(0, CAPTION_GAP) & (F.trim("text") != ""))
    best = met.groupBy("line_id").agg(F.min_by(F.struct("title_id", F.concat_ws(" ", F.trim("_n"), F.trim("text")).alias("text")), F.struct(gap, "title_id")).alias("m")).select("line_id", "m.*")
    # A title answers one number only, the first.
    return best.withColumn("_k", F.row_number().over(Window.partitionBy("title_id").orderBy("line_id"))).filter("_k = 1").drop("_k")


def content_rects(frames: DataFrame, lines: DataFrame, pages: DataFrame, page_area: float, min_fraction: float = 0.8) -> DataFrame:
    """The frame that holds each document's content: ``doc``, ``bbox``.

    ``frames``: repeated boxes with ``pages``; ``pages``: ``doc``, ``page_count``. The smallest frame of
    more than 60 % of the page, on most pages, with text inside and outside on more than half of them.
    """
    f, l = F.col("_f"), F.col("bbox")
    able = frames.join(pages, "doc").filter((g.area(F.col("bbox")) > FRAME * page_area) & (F.col("pages") >= min_fraction * F.col("page_count"))).select("doc", F.col("bbox").alias("_f"), "page_count")
    cx, cy = (g.x0(l) + g.x1(l)) / 2, (g.y0(l) + g.y1(l)) / 2
    inside = cx.between(g.x0(f), g.x1(f)) & cy.between(g.y0(f), g.y1(f))
    each = lines.select("doc", "page_number", "bbox").join(able, "doc").groupBy("doc", "_f", "page_count", "page_number").agg(F.bool_or(inside).alias("i"), F.bool_or(~inside).alias("o"))
    good = each.groupBy("doc", "_f", "page_count").agg(F.count_if(F.col("i") & F.col("o")).alias("n")).filter(F.col("n") > 0.5 * F.col("page_count"))
    return good.groupBy("doc").agg(F.min_by("_f", F.struct(g.area(F.col("_f")), "_f")).alias("bbox"))


def band_limits(page_height: Column, rect: Column, top: Column, bottom: Column) -> tuple[Column, Column]:
    """Where header and footer end: the content frame's edges, else the drawn limits, else the fixed bands."""
    return F.coalesce(g.y0(rect), top, g.BAND * page_height), F.coalesce(g.y1(rect), bottom, (1 - g.BAND) * page_height)


def header_limits(parts: DataFrame, width: float, height: float, gap: float = 20.0, min_width: float = 0.5, max_depth: float = 0.3) -> DataFrame:
    """Lower end of the drawn header and upper end of the drawn footer: ``doc``, ``top``, ``bottom``.

    From the repeated boxes (``doc``, ``bbox``) in the edge bands a box grows by parts no farther away
    than ``gap`` until none is left. It counts if wide enough, not too deep, and beyond the band.
    """

    def grow(boxes: list[list[float]], seeds: list[list[float]]) -> list[float] | None:
        if not seeds:
            return None
        box, left = list(seeds[0]), [b for b in boxes if b is not seeds[0]]
        while True:
            near = [b for b in left if max(b[0], box[0]) - min(b[2], box[2]) <= gap and max(b[1], box[1]) - min(b[3], box[3]) <= gap]
            if not near:
                return box
            for b in near:
                box = [min(box[0], b[0]), min(box[1], b[1]), max(box[2], b[2]), max(box[3], b[3])]
            left = [b for b in left if not any(b is x for x in near)]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        boxes = sorted([list(map(float, b)) for b in part["bbox"]])
        band = g.BAND * height
        small = [b for b in boxes if b[3] - b[1] <= max_depth * height]
        head = grow(small, [b for b in small if b[3] <= band])
        foot = grow(small, [b for b in small if b[1] >= height - band])
        wide = lambda b: b is not None and b[2] - b[0] >= min_width * width
        top = head[3] if wide(head) and band < head[3] <= max_depth * height else None
        bottom = foot[1] if wide(foot) and height - band > foot[1] >= (1 - max_depth) * height else None
        return pd.DataFrame({"doc": [part["doc"].iloc[0]], "top": [top], "bottom": [bottom]}).astype({"top": "float64", "bottom": "float64"})

    return shipped(parts).filter(F.size("bbox") == 4).select("doc", "bbox").distinct().groupBy("doc").applyInPandas(run, "doc string, top double, bottom double")
