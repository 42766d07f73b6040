"""Queries on text blocks, figures and outside records, with lines and boxes taken from the elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.operators import blocks, figures, furniture, layout, records
from quire.operators import elements as ops
from quire.plans import planted
from quire.plans.texts import LATEST
from quire.sources.tables import table

WIDTH, HEIGHT = 612.0, 792.0


def _now(spark: SparkSession, folder: str) -> DataFrame:
    return ops.latest(table(spark, folder, "elements"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of text elements, each element a block and its lines below each other in its box."""
    df = furniture.text_lines(_now(spark, folder).filter("size(bbox) = 4 and type <> 'image'"))
    b = F.col("bbox")
    size = F.round(g.y1(b) - g.y0(b), 1)
    return df.select("doc", "page_number", F.col("seq").alias("block"), F.col("line_no").alias("line"), "text", "bbox", size.alias("size"), (F.col("type") == "heading").alias("bold"), F.lit(False).alias("accent"))


def text_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks that are headings by the contents, or by size and weight where there are none."""
    lines = _lines(spark, folder).withColumn("weight", F.length("text").cast("bigint"))
    return blocks.heading_levels(lines, layout.body_size(lines, "size", "weight"), table(spark, folder, "toc_entries"))


def text_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Lines put together as elements again."""
    df = blocks.text_elements(_lines(spark, folder), text_headings(spark, folder))
    return df.select("doc", "page_number", "seq", "type", "level", "marker", F.length("text").alias("chars"))


def figure_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Image boxes as drawings: regions, and why some are none."""
    now = _now(spark, folder).filter("size(bbox) = 4")
    drawings = now.filter("type = 'image'").select("doc", "page_number", F.col("element_id").alias("drawing_id"), F.coalesce("kind", F.lit("path")).alias("kind"), "bbox", F.lit(None).cast("array<double>").alias("fill"), F.lit(True).alias("stroked"))
    repeated = furniture.box_groups(now.filter("type = 'image'"), 3, 0.8).select("doc", F.array("x0", "y0", "x1", "y1").alias("bbox"))
    df = figures.regions(drawings, now.filter("type = 'table'"), now.filter("text is not null"), repeated, WIDTH, HEIGHT)
    return df.select("doc", "page_number", "region", "drawings", "reason")


def element_errors(spark: SparkSession, folder: str) -> DataFrame:
    return planted.elements(spark, folder).select("element_id", records.element_error().alias("error")).filter("error is not null")


def page_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Pages in batches by the effort of their tier and images."""
    effort = F.max(F.when(F.col("tier") == "vision", 3).when(F.col("tier") == "ocr", 2).otherwise(1)) + 2 * F.count_if(F.col("type") == "image")
    work = _now(spark, folder).groupBy("doc", "page_number").agg(effort.alias("effort"))
    return records.batches(work, 18, 10)


SQL = {
    "element_errors": planted.sql("""with e as (select element_id, case when type is null or type not in ('heading', 'paragraph', 'list_item', 'table', 'image') then 'unknown type: ' || coalesce(type, 'none')
    when type = 'heading' and level is null then 'heading without level' when type = 'heading' and text is null then 'heading without text' when type = 'paragraph' and text is null then 'paragraph without text'
    when type = 'list_item' and marker is null then 'list_item without marker' when type = 'list_item' and level is null then 'list_item without level' when type = 'list_item' and text is null then 'list_item without text'
    when type = 'table' and rows is null then 'table without rows' when type = 'image' and asset is null then 'image without asset' when type = 'heading' and level not between 1 and 6 then 'heading level out of range'
    when type = 'list_item' and level < 1 then 'list level out of range' when type = 'table' and len(rows) = 0 then 'table without rows' end as error from elements) select * from e where error is not null"""),
    "figure_pages": f"with {LATEST} select doc, page_number, count(*) as figures from latest where type = 'image' and len(bbox) = 4 and greatest(0.0, bbox[3] - bbox[1]) * greatest(0.0, bbox[4] - bbox[2]) >= 0.01 * {WIDTH * HEIGHT} group by doc, page_number",
}


def figure_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Images of each page that are no slivers."""
    df = _now(spark, folder).filter("type = 'image' and size(bbox) = 4").filter(g.area(F.col("bbox")) >= figures.TINY * WIDTH * HEIGHT)
    return df.groupBy("doc", "page_number").agg(F.count(F.lit(1)).alias("figures"))


QUERIES = {q.__name__: q for q in (text_headings, text_blocks, figure_regions, figure_pages, element_errors, page_batches)}
