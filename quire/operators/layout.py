"""Sizes, positions and boxes on a page."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry
from quire.functions.text import is_caption
from quire.session import shipped

CAPTION_DISTANCE, X_TOLERANCE, BOX_GAP = 60.0, 3.0, 24.0


def body_size(lines: DataFrame, size: str, weight: str) -> DataFrame:
    """Median size of a document's lines, each weighted, as with one row per unit of weight."""
    return lines.filter(F.col(weight) > 0).groupBy("doc").agg(F.expr(f"percentile({size}, 0.5, {weight})").alias("body_size"))


def size_ranks(headings: DataFrame, size: str, levels: int = 6) -> DataFrame:
    """Level of each different heading size of a document: the largest is 1, at most ``levels``."""
    sizes = headings.select("doc", F.col(size).alias("size")).filter("size is not null").distinct()
    return sizes.withColumn("level", F.least(F.dense_rank().over(Window.partitionBy("doc").orderBy(F.col("size").desc())), F.lit(levels)))


def x_levels(markers: DataFrame) -> DataFrame:
    """Indent levels of a document's markers: each x with the nearest cluster's rank.

    Clusters take x in rising order and compare with their first one, so that runs of near values
    split by distance; the different x of a document are few and are grouped in Python.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        firsts: list[float] = []
        for x in sorted(part["x"]):
            if not firsts or x - firsts[-1] > X_TOLERANCE:
                firsts.append(x)
        level = [min(range(len(firsts)), key=lambda i: (abs(firsts[i] - x), i)) + 1 for x in part["x"]]
        return pd.DataFrame({"doc": part["doc"], "x": part["x"], "level": level})

    return shipped(markers).select("doc", "x").filter("x is not null").distinct().groupBy("doc").applyInPandas(run, "doc string, x double, level int")


def inside_regions(lines: DataFrame, regions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Lines with more than ``threshold`` of their area in a region of the same page; each line and region once.

    An equi join on (doc, page): the pairs of a page are bounded by what fits on a page.
    """
    r = regions.select("doc", "page_number", F.col("element_id").alias("region_id"), F.col("bbox").alias("_r"))
    met = lines.select("doc", "page_number", "element_id", "bbox").join(r, ["doc", "page_number"])
    return met.withColumn("ratio", geometry.overlap_ratio(F.col("bbox"), F.col("_r"))).filter((F.col("ratio") > threshold) & (F.col("element_id") != F.col("region_id"))).select("element_id", "region_id", "ratio")


def nearest_text(images: DataFrame, lines: DataFrame, captions_only: bool = False) -> DataFrame:
    """For each image the nearest text below, else above, within reach and overlapping in x.

    Columns: ``image_id``, ``element_id``, ``side``, ``distance``. With ``captions_only`` the text must
    read like a caption.
    """
    texts = lines.filter(is_caption(F.col("text"))) if captions_only else lines
    i, b = F.col("_i"), F.col("_b")
    met = images.select("doc", "page_number", F.col("element_id").alias("image_id"), F.col("bbox").alias("_i")).join(texts.select("doc", "page_number", "element_id", F.col("bbox").alias("_b")), ["doc", "page_number"])
    below, above = geometry.y0(b) - geometry.y1(i), geometry.y0(i) - geometry.y1(b)
    near = met.withColumn("side", F.when((below >= 0) & (below <= CAPTION_DISTANCE), "below").when((above >= 0) & (above <= CAPTION_DISTANCE), "above")).filter(F.col("side").isNotNull() & geometry.x_overlaps(i, b))
    near = near.withColumn("distance", F.when(F.col("side") == "below", below).otherwise(above))
    best = F.struct((F.col("side") == "above").alias("up"), "distance", "element_id", "side")
    return near.groupBy("image_id").agg(F.min(best).alias("m")).select("image_id", "m.element_id", "m.side", "m.distance")


def joined(boxes: list[tuple[float, float, float, float]], gap: float) -> list[int]:
    """For each box a number that boxes share which are no farther apart than ``gap`` in x and y, directly or through others.

    A sweep from left to right compares a box only with those that still reach it.
    """
    root = list(range(len(boxes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    live: list[int] = []
    for i in sorted(root[:], key=lambda k: boxes[k][0]):
        x0, y0, _, y1 = boxes[i]
        live = [j for j in live if x0 - boxes[j][2] <= gap]
        for j in live:
            if max(y0, boxes[j][1]) - min(y1, boxes[j][3]) <= gap:
                root[find(i)] = find(j)
        live.append(i)
    return [find(i) for i in range(len(boxes))]


def components(boxes: DataFrame, key: str, gap: float) -> DataFrame:
    """``doc``, ``page_number``, the key, ``component`` (its least key) and the component's box; boxes without corners go.

    Many pages go through Python together; what a task holds at once is a batch of pages.
    """
    box = F.col("bbox")
    corners = [g(box).alias(g.__name__) for g in (geometry.x0, geometry.y0, geometry.x1, geometry.y1)]
    pages = boxes.filter(F.size("bbox") == 4).groupBy("doc", "page_number").agg(F.collect_list(F.struct(F.col(key).alias("key"), *corners)).alias("boxes"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for doc, page, rows in zip(part["doc"], part["page_number"], part["boxes"]):
                found = [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in rows]
                number = joined(found, gap)
                union: dict[int, list] = {}
                for n, r, b in zip(number, rows, found):
                    u = union.get(n)
                    union[n] = [r["key"], *b] if u is None else [min(u[0], r["key"]), min(u[1], b[0]), min(u[2], b[1]), max(u[3], b[2]), max(u[4], b[3])]
                out += [(doc, page, r["key"], *union[n]) for n, r in zip(number, rows)]
            yield pd.DataFrame(out, columns=["doc", "page_number", key, "component", "x0", "y0", "x1", "y1"])

    kind = boxes.schema[key].dataType.simpleString()
    return shipped(pages).mapInPandas(run, f"doc string, page_number int, {key} {kind}, component {kind}, x0 double, y0 double, x1 double, y1 double")


def box_components(boxes: DataFrame, gap: float = BOX_GAP) -> DataFrame:
    """Boxes of a page that are near each other, directly or through others, as one: ``component`` and its box."""
    return components(boxes, "element_id", gap).drop("doc", "page_number")


def start_levels(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """Level at which a page starts: that of the last contents entry on an earlier page, else null."""
    marks = entries.filter("page is not null").select("doc", F.col("page").alias("page_number"), F.lit(0).alias("_side"), F.col("level").alias("_level"), F.col("entry_id").alias("_e"))
    # A page looks strictly before itself, so entries of its own page come after it.
    line = pages.select("doc", "page_number").distinct().select("doc", "page_number", F.lit(-1).alias("_side"), F.lit(None).cast("int").alias("_level"), F.lit(None).cast("bigint").alias("_e")).unionAll(marks)
    order = Window.partitionBy("doc").orderBy("page_number", "_side", "_e").rowsBetween(Window.unboundedPreceding, -1)
    return line.withColumn("level", F.last("_level", ignorenulls=True).over(order)).filter("_side = -1").select("doc", "page_number", "level")


def paragraphs(words: DataFrame) -> DataFrame:
    """Recognised words as paragraphs: ``block``, ``par``, ``line``, ``word_no``, ``text``, ``conf`` by page.

    Lines are joined without a space after a hyphen; ``confidence`` is the mean of the known ones.
    """
    from quire.functions.text import join_texts

    known = F.when(F.col("conf") >= 0, F.col("conf"))
    lines = words.filter(F.trim("text") != "").groupBy("doc", "page_number", "block", "par", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"]), " ").alias("text"), F.sum(known).alias("c"), F.count(known).alias("n"))
    whole = join_texts(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]))
    return lines.groupBy("doc", "page_number", "block", "par").agg(whole.alias("text"), (F.sum("c") / F.sum("n") / 100).alias("confidence"))
