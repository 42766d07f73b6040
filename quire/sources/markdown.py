"""Markdown read back: body words, headings and table cells, and scores of one text against another."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import shipped

# Lines that hold no body text, headings, table rules and list markers.
SKIPPED = r"^(!\[|>|<!--|---)"
HEADING = r"^(#{1,6})\s+(.*)$"
RULE = r"^[-: |]*$"
ITEM = r"^([-*]|\d+[.)])\s+"


def markdown_lines(texts: DataFrame, key: str, markdown: str) -> DataFrame:
    """Each line with body text: ``key``, ``line_no``, ``words``, ``level`` and ``heading`` (null elsewhere), ``cells``.

    Words and headings are in lower case, cells too; empty cells have no part. Null texts give no lines.
    """
    df = texts.select(key, F.posexplode(F.split(markdown, r"\r\n|[\n\r\x{B}\x{C}\x{85}\x{2028}\x{2029}]")).alias("line_no", "line"))
    df = df.withColumn("line", F.trim("line")).filter((F.col("line") != "") & ~F.col("line").rlike(SKIPPED))
    row = F.startswith("line", F.lit("|"))
    df = df.filter(~(row & F.col("line").rlike(RULE)))
    cells = F.transform(F.split(F.trim("line", F.lit("|")), r"\|"), lambda c: F.lower(F.trim(c)))
    level = F.length(F.regexp_extract("line", HEADING, 1))
    heading = F.when(~row & (level > 0), F.lower(F.trim(F.regexp_extract("line", HEADING, 2))))
    body = F.when(row, F.array_join(cells, " ")).otherwise(F.lower(F.regexp_replace(F.coalesce(heading, F.col("line")), ITEM, "")))
    words = F.filter(F.split(body, r"\s+"), lambda w: w != "")
    return df.select(key, "line_no", words.alias("words"), F.when(heading.isNotNull(), level).alias("level"), heading.alias("heading"), F.when(row, F.filter(cells, lambda c: c != "")).otherwise(F.array()).alias("cells"))


def markdown_parts(texts: DataFrame, key: str, markdown: str) -> DataFrame:
    """One row a text: ``words``, ``headings`` (level and text) and ``cells`` in their order."""
    lines = markdown_lines(texts, key, markdown)
    listed = F.array_sort(F.collect_list(F.struct("line_no", "words", "level", "heading", "cells")))
    df = lines.groupBy(key).agg(listed.alias("l"))
    headings = F.transform(F.filter("l", lambda x: x["heading"].isNotNull()), lambda x: F.concat(x["level"].cast("string"), F.lit(" "), x["heading"]))
    return df.select(key, F.flatten(F.transform("l", lambda x: x["words"])).alias("words"), headings.alias("headings"), F.flatten(F.transform("l", lambda x: x["cells"])).alias("cells"))


def markdown_scores(output: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Scores of two frames of :func:`markdown_parts`: ``key``, ``text``, ``headings``, ``tables``, each from 0 to 1.

    Similarity of the words in order, share of the reference's headings found in order, and F1 of the cells.
    A pair of texts is compared where it lies; its lists are as long as the texts.
    """
    kind = output.schema[key].dataType.simpleString()
    pairs = output.select(key, F.struct("words", "headings", "cells").alias("a")).join(reference.select(key, F.struct("words", "headings", "cells").alias("b")), key)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = lambda x, y: difflib.SequenceMatcher(None, list(x), list(y), autojunk=False)
        for p in parts:
            rows = []
            for k, a, b in zip(p[key], p["a"], p["b"]):
                found = sum(m.size for m in match(a["headings"], b["headings"]).get_matching_blocks())
                common = sum((Counter(a["cells"]) & Counter(b["cells"])).values())
                precision, recall = (common / len(x) if len(x) else 1.0 for x in (a["cells"], b["cells"]))
                f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
                rows.append((k, round(match(a["words"], b["words"]).ratio(), 3), round(found / len(b["headings"]), 3) if len(b["headings"]) else 1.0, round(f1, 3)))
            yield pd.DataFrame(rows, columns=["k", "text", "headings", "tables"])

    return shipped(pairs).mapInPandas(run, f"k {kind}, text double, headings double, tables double").withColumnRenamed("k", key)
