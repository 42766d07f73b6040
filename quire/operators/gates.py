"""Checks of an extraction against its source, as rows of what fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry
from quire.functions.text import coverage_words, is_caption, number_depth, section_number
from quire.operators.scan import page_keys

CONFIDENCE, LARGE, MIN_MISSING, MAX_MISSING, MIN_OUTPUT = 0.5, 0.2, 3, 0.05, 20
# Reasons for which a region may well be left out.
BENIGN = ("frame_drawing", "repeated_drawing", "tiny", "text_box", "grid_table", "table_in_figure", "invisible_drawing", "bitmap_panel")


def empty_pages(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """Pages (``doc``, ``page_number``) that have no element."""
    return pages.select("doc", "page_number").distinct().join(elements.select("doc", "page_number").distinct(), ["doc", "page_number"], "left_anti")


def low_confidence(pages: DataFrame) -> DataFrame:
    """Pages read by OCR below the floor; an unknown confidence is 0. Needs ``tier`` and ``ocr_confidence``."""
    return pages.filter((F.col("tier") == "ocr") & (F.coalesce("ocr_confidence", F.lit(0.0)) < CONFIDENCE))


def large_regions(regions: DataFrame, page_area: Column) -> DataFrame:
    """Excluded regions of more than a fifth of the page and no benign reason; adds ``share``."""
    share = geometry.area(F.col("bbox")) / page_area
    return regions.withColumn("share", F.round(share, 3)).filter((share > LARGE) & ~F.coalesce("reason", F.lit("")).isin(*BENIGN))


def orphan_captions(elements: DataFrame) -> DataFrame:
    """Paragraphs that read like a caption and that no image on this page or the next one has."""
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    lone = elements.filter((F.col("type") == "paragraph") & is_caption(F.col("text"))).withColumn("_key", key(F.col("text")))
    images = elements.filter((F.col("type") == "image") & F.col("caption").isNotNull()).select("doc", key(F.col("caption")).alias("_key"), F.explode(F.array(F.col("page_number"), F.col("page_number") - 1)).alias("page_number")).distinct()
    return lone.join(images, ["doc", "page_number", "_key"], "left_anti").select("element_id", "doc", "page_number", "text")


def tables_as_figures(elements: DataFrame) -> DataFrame:
    """Images with the caption of a table."""
    return elements.filter((F.col("type") == "image") & F.trim("caption").rlike(r"(?i)^table\s+\d+\.?:?(\s|$)")).select("element_id", "doc", "page_number", "caption")


def incomplete_figures(elements: DataFrame) -> DataFrame:
    """Images with neither a caption nor a text; adds ``missing``."""
    blank = lambda n: F.trim(F.coalesce(n, F.lit(""))) == ""
    return elements.filter((F.col("type") == "image") & blank("caption") & blank("figure_text")).select("element_id", "doc", "page_number", "asset", F.lit("caption or figure_text").alias("missing"))


def number_levels(elements: DataFrame) -> DataFrame:
    """Headings whose level is not the depth of their section number, up to depth 6."""
    depth = number_depth(section_number(F.col("text")))
    return elements.filter(F.col("type") == "heading").select("element_id", "doc", "page_number", "level", depth.alias("depth")).filter("depth <= 6 and (level is null or level <> depth)")


def _words(elements: DataFrame) -> Column:
    cells = F.array_join(F.flatten("rows"), " ")
    return F.explode(coverage_words(F.concat_ws(" ", "text", "caption", "figure_text", cells)))


def page_words(elements: DataFrame) -> DataFrame:
    """Words of each page with their counts: text, captions, figure texts and cells."""
    keys = page_keys(elements)
    return elements.select(*keys, _words(elements).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n")).drop("_block")


def kept_words(elements: DataFrame, kept: str) -> DataFrame:
    """Words of each page, ``src``, and how many of them are in rows that ``kept`` names, ``out``."""
    keys = page_keys(elements)
    return elements.select(*keys, kept, _words(elements).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("src"), F.count_if(kept).alias("out"))


def coverage(source: DataFrame, output: DataFrame) -> DataFrame:
    """:func:`uncovered` for counts by (doc, page, word) of a source and an output."""
    zero = F.lit(0).cast("bigint")
    both = source.select("doc", "page_number", "word", F.col("n").alias("src"), zero.alias("out")).unionAll(output.select("doc", "page_number", "word", zero, "n"))
    return uncovered(both.groupBy("doc", "page_number", "word").agg(F.sum("src").alias("src"), F.sum("out").alias("out")))


def uncovered(both: DataFrame) -> DataFrame:
    """Pages that lack words of their source: ``doc``, ``page_number``, ``missing``, ``total``.

    ``both`` counts each word of each page in the source and in the output. A surplus of a word on a
    neighbouring page, beyond that page's own source, makes up for it. Only words that lack or
    abound meet in a join.
    """
    keys = page_keys(both)
    totals = both.groupBy(*keys).agg(F.sum("src").alias("total"), F.sum(F.greatest(F.col("src") - F.col("out"), F.lit(0))).alias("lacking")).filter((F.col("lacking") >= MIN_MISSING) & (F.col("lacking") >= MAX_MISSING * F.col("total")))
    spare = both.filter("out > src").select("doc", "word", (F.col("out") - F.col("src")).alias("spare"), F.explode(F.array(F.col("page_number") - 1, F.col("page_number") + 1)).alias("page_number"))
    lent = spare.groupBy("doc", "page_number", "word").agg(F.sum("spare").alias("lent"))
    lack = both.filter("src > out").select("doc", "page_number", "word", (F.col("src") - F.col("out")).alias("lack")).join(lent, ["doc", "page_number", "word"], "left")
    missing = lack.groupBy("doc", "page_number").agg(F.sum(F.greatest(F.col("lack") - F.coalesce("lent", F.lit(0)), F.lit(0))).alias("missing"))
    pages = totals.select("doc", "page_number", "total").join(missing, ["doc", "page_number"])
    return pages.filter((F.col("missing") >= MIN_MISSING) & (F.col("missing") >= MAX_MISSING * F.col("total"))).select("doc", "page_number", "missing", "total")


def ragged_tables(elements: DataFrame) -> DataFrame:
    """Tables whose rows differ in length: widest and narrowest row, and share of filled cells."""
    sizes = F.transform("rows", F.size)
    cells = F.flatten("rows")
    filled = F.size(F.filter(cells, lambda c: c.isNotNull() & (F.trim(c) != "")))
    df = elements.filter((F.col("type") == "table") & (F.size("rows") > 0)).select("element_id", "doc", F.array_max(sizes).alias("widest"), F.array_min(sizes).alias("narrowest"), F.size("rows").alias("n_rows"), (filled / F.greatest(F.size(cells), F.lit(1))).alias("filled"))
    return df.filter("widest <> narrowest")


def layout_tables(elements: DataFrame) -> DataFrame:
    """Tables that are laid-out prose: under half of the cells filled and one of them long."""
    cells = F.flatten("rows")
    filled = F.size(F.filter(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    prose = F.exists(cells, lambda c: F.length(F.coalesce(c, F.lit(""))) >= 150)
    return elements.filter((F.col("type") == "table") & (F.size(cells) > 0) & (filled < 0.5 * F.size(cells)) & prose)


def missing_assets(elements: DataFrame, files: DataFrame) -> DataFrame:
    """Images whose ``asset`` is no ``path`` of the document's ``files``; images without an asset count."""
    images = elements.filter("type = 'image'").select("element_id", "doc", "page_number", "asset")
    return images.join(files.select("doc", F.col("path").alias("asset")).distinct(), ["doc", "asset"], "left_anti").select("element_id", "doc", "page_number", "asset")


def uncovered_figures(census: DataFrame, elements: DataFrame) -> DataFrame:
    """Shapes of the census that no image or table element of their page stands for.

    ``census`` has ``doc``, ``page_number``, ``shape_id``, ``groups`` (ids of the groups around it) and ``kind``;
    ``elements`` has ``source_shape_id`` and ``tier``. On a page that was read by sight, ids are lost: there
    as many figures as shapes are enough.
    """
    page = ["doc", "page_number"]
    figures = elements.filter("type in ('image', 'table')").select(*page, "source_shape_id", "tier")
    ids = figures.filter("source_shape_id is not null").select(*page, F.col("source_shape_id").alias("_id")).distinct()
    wanted = census.withColumn("_key", F.struct("shape_id", "kind")).select(*page, "_key", F.explode(F.array_distinct(F.concat(F.array("shape_id"), F.coalesce("groups", F.array())))).alias("_id"))
    met = wanted.join(ids, [*page, "_id"], "left_semi").select(*page, "_key").distinct()
    lost = census.withColumn("_key", F.struct("shape_id", "kind")).join(met, [*page, "_key"], "left_anti")
    shown = figures.groupBy(*page).agg(F.count(F.lit(1)).alias("_figures"), F.max(F.col("tier") == "vision").alias("_seen"))
    shapes = census.groupBy(*page).agg(F.count(F.lit(1)).alias("_shapes"))
    excused = shapes.join(shown, page).filter("_seen and _figures >= _shapes").select(*page)
    return lost.join(excused, page, "left_anti").select(*page, "shape_id", "kind")


def incomplete_outputs(files: DataFrame) -> DataFrame:
    """Documents whose split output is incomplete: ``doc``, ``reason``.

    ``files`` has ``doc``, ``path`` (below the document's folder) and ``content``. There must be an index of
    at least :data:`MIN_OUTPUT` characters that links to files, all of which exist.
    """
    index = files.filter(F.col("path") == F.concat("doc", F.lit("/index.md")))
    links = index.select("doc", F.explode(F.regexp_extract_all("content", F.lit(r"\]\(([^)]+)\)"), F.lit(1))).alias("link"))
    target = F.concat("doc", F.lit("/"), F.regexp_replace("link", r"^\./", ""))
    dead = links.withColumn("path", target).join(files.select("doc", "path"), ["doc", "path"], "left_anti").groupBy("doc").agg(F.count(F.lit(1)).alias("dead"))
    linked = links.groupBy("doc").agg(F.count(F.lit(1)).alias("links"))
    found = files.select("doc").distinct().join(index.select("doc", F.length("content").alias("size")), "doc", "left").join(linked, "doc", "left").join(dead, "doc", "left")
    reason = F.when(F.col("size").isNull(), "no index").when(F.col("size") < MIN_OUTPUT, "index too short").when(F.col("links").isNull(), "no links").when(F.col("dead").isNotNull(), "dead links")
    return found.select("doc", reason.alias("reason")).filter("reason is not null")


def unparsed_warnings(unparsed: DataFrame, unmatched: DataFrame) -> DataFrame:
    """Contents lines without an entry (``doc``, ``unparsed``) of documents all of whose entries met a heading."""
    lines = unparsed.filter("unparsed is not null")
    return lines.join(unmatched.select("doc").distinct(), "doc", "left_anti").groupBy("doc").agg(F.count(F.lit(1)).alias("lines"), F.min("unparsed").alias("first"))
