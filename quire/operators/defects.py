"""Defects put into good documents, to see whether checks find them.

Each takes current elements and gives them with one defect a document, at the first place where the
document has room for it; a document without such a place stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INVENTED = "All values were confirmed by an independent laboratory."


def _first(elements: DataFrame, where: Column) -> DataFrame:
    """Add ``_hit``: the row is the first of its document that ``where`` holds for."""
    at = F.struct("page_number", "seq", "element_id")
    first = elements.filter(where).groupBy("doc").agg(F.min(at).alias("_at"))
    return elements.join(first, "doc", "left").withColumn("_hit", F.coalesce(at == F.col("_at"), F.lit(False))).drop("_at")


def _change(elements: DataFrame, where: Column, column: str, value: Column) -> DataFrame:
    df = _first(elements, where)
    return df.withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column))).drop("_hit")




def _is(kind: str) -> Column:
    return F.col("type") == kind


def drop_paragraph(elements: DataFrame) -> DataFrame:
    return _first(elements, _is("paragraph")).filter(~F.col("_hit")).drop("_hit")


def duplicate_paragraph(elements: DataFrame) -> DataFrame:
    df = _first(elements, _is("paragraph"))
    return df.drop("_hit").unionByName(df.filter("_hit").drop("_hit").withColumns({"element_id": -F.col("element_id"), "seq": F.col("seq") + 1000}))


def swap_paragraphs(elements: DataFrame) -> DataFrame:
    """The first two paragraphs of the first page that has two change places."""
    p = _is("paragraph")
    page = Window.partitionBy("doc", "page_number")
    df = elements.withColumn("_n", F.when(p, F.row_number().over(Window.partitionBy("doc", "page_number", "type").orderBy("seq", "element_id"))))
    first = elements.filter(p).groupBy("doc", "page_number").count().filter("count >= 2").groupBy("doc").agg(F.min("page_number").alias("_page"))
    df = df.join(first, "doc", "left")
    here = F.coalesce((F.col("page_number") == F.col("_page")) & F.col("_n").isin(1, 2), F.lit(False))
    other = F.sum(F.when(here, F.col("seq"))).over(page) - F.col("seq")
    return df.withColumn("seq", F.when(here, other).otherwise(F.col("seq")).cast("int")).drop("_n", "_page")


def invent_sentence(elements: DataFrame) -> DataFrame:
    return _change(elements, _is("paragraph"), "text", F.concat_ws(" ", "text", F.lit(INVENTED)))


def shift_heading_level(elements: DataFrame) -> DataFrame:
    return _change(elements, _is("heading") & F.col("level").isNotNull(), "level", F.when(F.col("level") < 3, F.col("level") + 1).otherwise(F.col("level") - 1))


def corrupt_table(elements: DataFrame) -> DataFrame:
    """The last row of the first table is lost."""
    return _change(elements, _is("table") & (F.size("rows") > 1), "rows", F.slice("rows", 1, F.greatest(F.size("rows") - 1, F.lit(0))))


def remove_image(elements: DataFrame) -> DataFrame:
    return _first(elements, _is("image")).filter(~F.col("_hit")).drop("_hit")


def wrong_caption(elements: DataFrame) -> DataFrame:
    return _change(elements, _is("image"), "caption", F.lit("image"))


def split_paragraph(elements: DataFrame) -> DataFrame:
    """The first paragraph of at least four words becomes two."""
    words = F.split("text", " ")
    half = F.floor(F.size(words) / 2).cast("int")
    df = _first(elements, _is("paragraph") & (F.size(words) >= 4))
    rest = df.filter("_hit").withColumns({"text": F.array_join(F.slice(words, half + 1, F.size(words)), " "), "element_id": -F.col("element_id"), "seq": F.col("seq") + 1000})
    kept = df.withColumn("text", F.when(F.col("_hit"), F.array_join(F.slice(words, 1, half), " ")).otherwise(F.col("text")))
    return kept.unionByName(rest).drop("_hit")


DEFECTS = {f.__name__: f for f in (drop_paragraph, duplicate_paragraph, swap_paragraphs, invent_sentence, shift_heading_level, corrupt_table, remove_image, wrong_caption, split_paragraph)}
