"""What repeats from page to page: running lines, boxes, and output lines.

Lines are rows of ``doc``, ``page_number``, ``text`` and ``bbox``; a page's height is a column or
constant. Counting is by (doc, key, edge) with partial aggregation, so a long document costs its
distinct keys, not its lines.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry
from quire.functions.text import furniture_key, has_letters
from quire.session import cut, shipped

MIN_PAGES, MIN_FRACTION = 2, 0.6
#: Boxes within this distance of a group's first box belong to it.
GROUP_TOLERANCE = 2.0
OUTPUT_MIN, OUTPUT_FRACTION = 3, 0.1
#: Share of the page from which an image is its background.
LARGEST = 0.6


def text_lines(elements: DataFrame) -> DataFrame:
    """Lines of the elements' texts: ``doc``, ``page_number``, ``seq``, ``type``, ``line_no``, ``text``, ``bbox``."""
    split = F.posexplode(F.split("text", r"\r\n|[\n\x{B}\x{C}\r\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"))
    return elements.filter(F.col("text").isNotNull()).select("element_id", "doc", "page_number", "seq", "type", "bbox", split.alias("line_no", "text"))


def repeated_lines(lines: DataFrame, page_height: Column, min_fraction: float = MIN_FRACTION, min_pages: int = MIN_PAGES) -> DataFrame:
    """Keys of lines that stand in one edge band on most pages: ``doc``, ``key``, ``edge``, ``pages``, ``y_min``, ``y_max``."""
    pages = lines.groupBy("doc").agg(F.countDistinct("page_number").alias("page_count"))
    banded = lines.withColumn("edge", geometry.edge(F.col("bbox"), page_height)).filter("edge is not null").withColumn("key", furniture_key(F.col("text"))).filter("key <> ''")
    found = banded.groupBy("doc", "key", "edge").agg(F.countDistinct("page_number").alias("pages"), F.min(geometry.y0(F.col("bbox"))).alias("y_min"), F.max(geometry.y1(F.col("bbox"))).alias("y_max"))
    return found.join(pages, "doc").filter((F.col("pages") >= min_pages) & (F.col("pages") >= min_fraction * F.col("page_count"))).drop("page_count")


def document_lines(lines: DataFrame, min_fraction: float = MIN_FRACTION, min_pages: int = MIN_PAGES) -> DataFrame:
    """The same for lines without boxes, wherever they stand: keys with letters only."""
    pages = lines.groupBy("doc").agg(F.countDistinct("page_number").alias("page_count"))
    keyed = lines.withColumn("key", furniture_key(F.col("text"))).filter(has_letters(F.col("key")))
    found = keyed.groupBy("doc", "key").agg(F.countDistinct("page_number").alias("pages"), F.count(F.lit(1)).alias("lines"))
    return found.join(pages, "doc").filter((F.col("pages") >= min_pages) & (F.col("pages") >= min_fraction * F.col("page_count"))).drop("page_count")


def strip_lines(elements: DataFrame, patterns: DataFrame) -> DataFrame:
    """Elements with the lines of ``patterns`` (doc, key) removed: ``element_id``, ``text``, ``removed``.

    Text without such a line stays as it is; one of such lines alone becomes empty.
    """
    lines = text_lines(elements).withColumn("key", furniture_key(F.col("text")))
    known = patterns.select("doc", "key").distinct().withColumn("_hit", F.lit(True))
    marked = lines.join(known, ["doc", "key"], "left")
    kept = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("line_no", "text", F.coalesce("_hit", F.lit(False)).alias("hit")))), lambda x: ~x["hit"]), lambda x: x["text"])
    return marked.groupBy("element_id").agg(F.array_join(kept, "\n").alias("text"), F.count("_hit").alias("removed"))


def strip_banded(elements: DataFrame, patterns: DataFrame, page_height: Column) -> DataFrame:
    """:func:`strip_lines` by place: ``element_id``, ``text``, ``removed``.

    An element with a box loses lines only if that lies in an edge band; one without a box loses those
    whose key has letters, wherever it stood.
    """
    boxed = F.coalesce(F.size("bbox") == 4, F.lit(False)) & (page_height > 0)
    banded = boxed & geometry.edge(F.col("bbox"), page_height).isNotNull()
    kind = elements.withColumn("_place", F.when(banded, "any").when(~boxed, "letters")).filter(F.col("_place").isNotNull())
    lettered = patterns.filter(has_letters(F.col("key")))
    return strip_lines(kind.filter("_place = 'any'"), patterns).unionAll(strip_lines(kind.filter("_place = 'letters'"), lettered))


def side_margin_lines(lines: DataFrame, page_width: Column) -> DataFrame:
    """Lines (with ``dir``, their direction) that run up or down wholly within a side margin."""
    b, band = F.col("bbox"), geometry.BAND * page_width
    return lines.filter((F.abs(F.get("dir", F.lit(1))) >= 0.5) & (page_width > 0) & ((geometry.x1(b) <= band) | (geometry.x0(b) >= page_width - band)))


def first_page_text(lines: DataFrame, patterns: DataFrame) -> DataFrame:
    """The running lines of each document's first page as they stand there, from the top: ``doc``, ``text``."""
    keyed = lines.filter("page_number = 1").withColumn("key", furniture_key(F.col("text"))).join(patterns.select("doc", "key").distinct(), ["doc", "key"], "left_semi")
    # Of each key the topmost line counts.
    place = F.struct(geometry.y0(F.col("bbox")).alias("y"), F.col("seq"), F.col("line_no"), F.trim("text").alias("text"))
    each = keyed.groupBy("doc", "key").agg(F.min(place).alias("l"))
    return each.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["text"]), "\n").alias("text"))


def repeated_images(images: DataFrame, page_height: Column, page_area: Column, pages: DataFrame, min_pages: int = 2, min_fraction: float = 0.5) -> DataFrame:
    """Images (``doc``, ``asset``) that stand as furniture on most pages: in an edge band, or over most of the page.

    A page counts if all places of the image there are such. ``pages`` has every page of each document.
    """
    b = F.col("bbox")
    placed = geometry.edge(b, page_height).isNotNull() | (geometry.area(b) >= LARGEST * page_area)
    each = images.filter(F.col("asset").isNotNull()).groupBy("doc", "asset", "page_number").agg(F.min(F.coalesce(placed, F.lit(False))).alias("ok")).filter("ok")
    found = each.groupBy("doc", "asset").agg(F.count(F.lit(1)).alias("pages"))
    total = pages.groupBy("doc").agg(F.countDistinct("page_number").alias("page_count"))
    return found.join(total, "doc").filter((F.col("pages") >= min_pages) & (F.col("pages") >= min_fraction * F.col("page_count"))).drop("page_count")


def output_repeats(lines: DataFrame) -> DataFrame:
    """Whole lines that recur in a document's output: at least three times and on a tenth of its pages."""
    pages = lines.groupBy("doc").agg(F.countDistinct("page_number").alias("page_count"))
    counts = lines.withColumn("line", F.trim("text")).filter("line <> ''").groupBy("doc", "line").agg(F.count(F.lit(1)).alias("n"))
    least = F.greatest(F.lit(OUTPUT_MIN), F.ceil(F.col("page_count") * OUTPUT_FRACTION))
    return counts.join(pages, "doc").filter(F.col("n") >= least).select("doc", "line", "n")


def _apart(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``, a number of the run of ``value`` within ``keys``: runs lie more than the tolerance apart.

    The window holds the different values alone, which the resolution of a page bounds.
    """
    order = Window.partitionBy(*keys).orderBy(value)
    far = F.coalesce(F.col(value) - F.lag(value).over(order) > GROUP_TOLERANCE, F.lit(False))
    runs = df.select(*keys, value).distinct().withColumn("_far", far.cast("int")).withColumn(name, F.sum("_far").over(order)).drop("_far")
    return df.join(runs, [*keys, value])


def box_groups(boxes: DataFrame, min_pages: int = 3, min_fraction: float = 0.5) -> DataFrame:
    """Boxes that recur at one place: ``doc``, ``kind``, ``x0`` .. ``y1`` (means), ``pages``.

    A box joins the first group whose first box lies within :data:`GROUP_TOLERANCE` in all four
    coordinates, in the order of pages. That order decides, so it is a grouped Python stage. Equal boxes
    join one group, so only different ones take part, with their first page; and boxes with a gap between
    them in x or y never meet, so each stretch without such a gap is a group of its own, not a document.
    """
    corners = ["x0", "y0", "x1", "y1"]

    def group(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["page", *corners])
        firsts: list[tuple] = []
        grid: dict[tuple[int, int], list[int]] = {}
        hits = []
        for box in part[corners].itertuples(index=False, name=None):
            cx, cy = int(box[0] // GROUP_TOLERANCE), int(box[1] // GROUP_TOLERANCE)
            near = sorted(g for i in (-1, 0, 1) for j in (-1, 0, 1) for g in grid.get((cx + i, cy + j), ()))
            hit = next((g for g in near if all(abs(a - b) <= GROUP_TOLERANCE for a, b in zip(firsts[g], box))), None)
            if hit is None:
                hit = len(firsts)
                firsts.append(box)
                grid.setdefault((cx, cy), []).append(hit)
            hits.append(hit)
        return part[["doc", "kind", *corners, "_x", "_y"]].assign(_group=hits)

    b = F.col("bbox")
    flat = boxes.filter((F.size("bbox") == 4) & F.col("doc").isNotNull()).select("doc", F.coalesce("kind", F.lit("")).alias("kind"), "page_number", *[getattr(geometry, c)(b).alias(c) for c in corners]).distinct()
    different = flat.groupBy("doc", "kind", *corners).agg(F.min("page_number").alias("page"))
    parted = _apart(_apart(different, ["doc", "kind"], "x0", "_x"), ["doc", "kind", "_x"], "y0", "_y")
    # Where all boxes lie within the tolerance, all join the first one; only the other stretches are Python's.
    stretch = Window.partitionBy("doc", "kind", "_x", "_y")
    wide = F.greatest(*[F.max(c).over(stretch) - F.min(c).over(stretch) for c in corners]) > GROUP_TOLERANCE
    parted = cut(parted.withColumn("_wide", wide))
    plain = parted.filter("not _wide").select("doc", "kind", *corners, "_x", "_y", F.lit(0).cast("bigint").alias("_group"))
    schema = "doc string, kind string, x0 double, y0 double, x1 double, y1 double, _x bigint, _y bigint, _group bigint"
    grouped = plain.unionByName(shipped(parted.filter("_wide")).groupBy("doc", "kind", "_x", "_y").applyInPandas(group, schema))
    means = [F.round(F.avg(c), 2).alias(c) for c in corners]
    found = flat.join(grouped, ["doc", "kind", *corners]).groupBy("doc", "kind", "_x", "_y", "_group").agg(*means, F.countDistinct("page_number").alias("pages")).drop("_x", "_y", "_group").withColumn("kind", F.nullif("kind", F.lit("")))
    pages = boxes.groupBy("doc").agg(F.countDistinct("page_number").alias("page_count"))
    return found.join(pages, "doc").filter((F.col("pages") >= min_pages) & (F.col("pages") >= min_fraction * F.col("page_count"))).drop("page_count")


def language_hits(texts: DataFrame, key: str, text: str, words: list[tuple[str, str]], min_hits: int = 20, min_share: float = 0.15) -> DataFrame:
    """Languages of each text by their function words: ``key``, ``lang``, ``hits``, ``share``."""
    table = texts.sparkSession.createDataFrame(words, "word string, lang string")
    found = texts.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    hits = found.join(F.broadcast(table), "word").groupBy(key, "lang").agg(F.count(F.lit(1)).alias("hits"))
    total = hits.groupBy(key).agg(F.sum("hits").alias("_t"))
    shared = hits.join(total, key).withColumn("share", F.col("hits") / F.col("_t"))
    return shared.filter((F.col("hits") >= min_hits) & (F.col("share") >= min_share)).select(key, "lang", "hits", "share")
