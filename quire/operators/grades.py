"""Scores of pages and documents, and measures of one extraction against another."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import shipped

PENALTY = 0.3
UNIT = 15


def current_grades(shards: DataFrame) -> DataFrame:
    """Of each page the grade given last."""
    order = Window.partitionBy("doc", "page_number").orderBy(F.col("graded_at").desc_nulls_last(), F.col("shard_id").desc())
    return shards.filter("doc is not null").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def page_scores(shards: DataFrame) -> DataFrame:
    """Score of each page from its different issues; no issues or null ones score 1."""
    n = F.coalesce(F.size(F.array_compact(F.array_distinct("issues"))), F.lit(0))
    n = F.when(F.col("issues").isNull(), 0).otherwise(n)
    return shards.withColumn("score", F.round(F.greatest(F.lit(0.0), 1 - PENALTY * n), 3))


def document_scores(pages: DataFrame) -> DataFrame:
    """Mean score, graded pages, and the issues of a document as one sorted text."""
    issues = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("issues", F.array())))))
    return pages.groupBy("doc").agg(F.round(F.avg("score"), 3).alias("score"), F.count(F.lit(1)).alias("pages"), F.array_join(issues, ",").alias("issues"))


def issue_pages(pages: DataFrame) -> DataFrame:
    """Pages and documents by issue."""
    each = pages.select("doc", "page_number", F.explode(F.array_distinct("issues")).alias("issue"))
    return each.groupBy("issue").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("doc").alias("docs"))


def recall(expected: DataFrame, given: DataFrame) -> DataFrame:
    """Share of expected (doc, page_number, issue) rows that were given, by issue."""
    hit = given.distinct().withColumn("_hit", F.lit(1))
    return expected.distinct().join(hit, ["doc", "page_number", "issue"], "left").groupBy("issue").agg(F.count(F.lit(1)).alias("expected"), F.count("_hit").alias("found"), F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))


def cell_f1(left: DataFrame, right: DataFrame) -> DataFrame:
    """F1 of the cells of two extractions as multisets, by document: ``doc``, ``both``, ``f1``."""

    def cells(df: DataFrame, name: str) -> DataFrame:
        return df.filter("type = 'table' and rows is not null").select("doc", F.explode(F.flatten("rows")).alias("cell")).filter("cell is not null").groupBy("doc", "cell").agg(F.count(F.lit(1)).alias(name))

    met = cells(left, "a").join(cells(right, "b"), ["doc", "cell"], "full").fillna(0, ["a", "b"])
    total = met.groupBy("doc").agg(F.sum(F.least("a", "b")).alias("both"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return total.select("doc", "both", (2 * F.col("both") / (F.col("a") + F.col("b"))).alias("f1"))


def missing_words(source: DataFrame, output: DataFrame) -> DataFrame:
    """Different words of each page's source that its output lacks: count, and the first eight in order."""
    lost = source.select("doc", "page_number", "word").join(output.select("doc", "page_number", "word"), ["doc", "page_number", "word"], "left_anti")
    return lost.groupBy("doc", "page_number").agg(F.count(F.lit(1)).alias("missing"), F.array_join(F.slice(F.array_sort(F.collect_list("word")), 1, 8), ",").alias("first"))


def dropped_units(units: DataFrame, output: DataFrame) -> DataFrame:
    """Texts of at least 15 characters that are no part of their page's output, space and case aside."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    wanted = units.withColumn("_unit", plain(F.col("text"))).filter(F.length("_unit") >= UNIT)
    # Only pages with such a text are put together.
    shown = output.filter("text is not null").select("doc", "page_number", "seq", "element_id", "text").join(wanted.select("doc", "page_number").distinct(), ["doc", "page_number"], "left_semi")
    pages = shown.groupBy("doc", "page_number").agg(plain(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "element_id", "text"))), lambda x: x["text"]), " ")).alias("_page"))
    both = wanted.join(pages, ["doc", "page_number"], "left")
    return both.filter(F.col("_page").isNull() | ~F.contains("_page", "_unit")).select("element_id", "doc", "page_number")


def headings_missing(expected: DataFrame, output: DataFrame) -> DataFrame:
    """Headings (doc, key, level) of one side that the other lacks, as often as they are lacking."""
    return expected.select("doc", "key", "level").exceptAll(output.select("doc", "key", "level"))


def sequence_ratio(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Similarity of two texts by their words in order, from 0 to 1: ``key``, ``ratio``; null counts as empty."""
    kind = pairs.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            ratio = [difflib.SequenceMatcher(None, (a or "").split(), (b or "").split(), autojunk=False).ratio() for a, b in zip(p["_a"], p["_b"])]
            yield pd.DataFrame({"k": p["_k"], "ratio": ratio})

    return shipped(pairs).select(F.col(key).alias("_k"), F.col(left).alias("_a"), F.col(right).alias("_b")).mapInPandas(run, f"k {kind}, ratio double").withColumnRenamed("k", key)
