"""Text and tables that a page break cuts in two."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry
from quire.functions.text import ends_sentence, join_text
from quire.session import shipped

X_TOLERANCE = 3.0


def _ends(elements: DataFrame) -> DataFrame:
    """First and last body element of every page, and whether it has but one."""
    body = elements.filter(F.col("type") != "image")
    row = F.struct("seq", "element_id", "type", "text", "bbox")
    return body.groupBy("doc", "page_number").agg(F.min_by(row, "seq").alias("first"), F.max_by(row, "seq").alias("last"), (F.count(F.lit(1)) == 1).alias("single"))


def page_break_joins(elements: DataFrame) -> DataFrame:
    """Paragraphs joined over page breaks: ``doc``, ``page_number``, ``element_id``, ``joined_id``, ``text``.

    The last body element of a page, a paragraph or list item that ends no sentence, takes the
    paragraph that opens the next page if it starts at the same x, or in small letters where boxes
    are unknown. A page whose only element was taken has none left to go on: along a run of pages
    that could join, every other joint counts from the last page where the run must start anew.
    """
    order = Window.partitionBy("doc").orderBy("page_number")
    pages = _ends(elements).withColumns({"next": F.lead(F.struct("page_number", "first")).over(order)})
    last, first = F.col("last"), F.col("next.first")
    boxes = last["bbox"].isNotNull() & first["bbox"].isNotNull()
    near = F.abs(geometry.x0(first["bbox"]) - geometry.x0(last["bbox"])) <= X_TOLERANCE
    small = F.coalesce(first["text"], F.lit("")).rlike(r"^\p{Ll}")
    able = (F.col("next.page_number") == F.col("page_number") + 1) & last["type"].isin("paragraph", "list_item") & ~ends_sentence(last["text"]) & (first["type"] == "paragraph") & F.when(boxes, near).otherwise(small)
    pages = pages.withColumn("able", F.coalesce(able, F.lit(False)))
    chained = F.col("able") & F.col("single") & F.coalesce(F.lag("able").over(order), F.lit(False)) & (F.lag("page_number").over(order) == F.col("page_number") - 1)
    pages = pages.withColumn("_run", F.sum(F.when(F.coalesce(chained, F.lit(False)), 0).otherwise(1)).over(order))
    nth = F.row_number().over(Window.partitionBy("doc", "_run").orderBy("page_number"))
    joined = pages.withColumn("_n", nth).filter(F.col("able") & (F.col("_n") % 2 == 1))
    return joined.select("doc", "page_number", last["element_id"].alias("element_id"), first["element_id"].alias("joined_id"), join_text(last["text"], first["text"]).alias("text"))


def table_chains(elements: DataFrame) -> DataFrame:
    """Tables that go on over pages: ``doc``, ``element_id`` of the first part, ``parts`` (ids), ``rows``.

    The next page must open with a table of as many columns at the same left and right edges; rows
    that repeat the first part's head are dropped. A chain passes over a page that it emptied and
    compares with its first page, so it is a grouped stage over the tables at page edges alone.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        pages = {r.page_number: r for r in part.itertuples(index=False)}
        rows, current = [], None
        for n in sorted(pages):
            p = pages[n]
            if current is not None and n == current[2] + 1 and p.first_table and _continues(current, p):
                again = 0
                while again < min(len(p.first_rows), len(current[1])) and list(p.first_rows[again]) == current[1][again]:
                    again += 1
                current[1].extend(list(r) for r in p.first_rows[again:])
                current[3].append(p.first_id)
                if p.single:
                    current[2] = n
                    continue
            if current is not None and len(current[3]) > 1:
                rows.append((part["doc"].iloc[0], current[3][0], current[3], len(current[1])))
            current = [(p.last_x0, p.last_x1), [list(r) for r in p.last_rows], n, [p.last_id]] if p.last_table else None
        if current is not None and len(current[3]) > 1:
            rows.append((part["doc"].iloc[0], current[3][0], current[3], len(current[1])))
        return pd.DataFrame(rows, columns=["doc", "element_id", "parts", "rows"])

    body = elements.filter(F.col("type") != "image")
    row = F.struct("element_id", "type", "rows", "bbox")
    ends = body.groupBy("doc", "page_number").agg(F.min_by(row, "seq").alias("a"), F.max_by(row, "seq").alias("z"), (F.count(F.lit(1)) == 1).alias("single"))
    usable = lambda c: (c["type"] == "table") & (F.size(c["rows"]) > 0) & (F.size(c["bbox"]) == 4)
    a, z = F.col("a"), F.col("z")
    flat = ends.select(
        "doc", "page_number", "single", F.coalesce(usable(a), F.lit(False)).alias("first_table"), F.coalesce(usable(z), F.lit(False)).alias("last_table"), a["element_id"].alias("first_id"), z["element_id"].alias("last_id"),
        F.coalesce(a["rows"], F.array()).alias("first_rows"), F.coalesce(z["rows"], F.array()).alias("last_rows"),
        *[g(c["bbox"]).alias(f"{n}_{g.__name__}") for n, c in (("first", a), ("last", z)) for g in (geometry.x0, geometry.x1)],
    ).filter("first_table or last_table")
    return shipped(flat).groupBy("doc").applyInPandas(run, "doc string, element_id bigint, parts array<bigint>, rows bigint")


def _continues(current: list, p) -> bool:
    width = lambda rows: max((len(r) for r in rows), default=0)
    return width(current[1]) == width(p.first_rows) and abs(current[0][0] - p.first_x0) <= X_TOLERANCE and abs(current[0][1] - p.first_x1) <= X_TOLERANCE
