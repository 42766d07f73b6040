"""Records that others write: elements of read pages, descriptions of figures, diagram sources, batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import shipped

# Types with the fields they need, and the first words of diagram sources.
REQUIRED = {"heading": ("level", "text"), "paragraph": ("text",), "list_item": ("marker", "level", "text"), "table": ("rows",), "image": ("asset",)}
DIAGRAMS = ("flowchart", "graph", "sequenceDiagram", "classDiagram", "stateDiagram-v2", "stateDiagram", "erDiagram", "journey", "gantt", "pie", "quadrantChart", "requirementDiagram", "gitGraph", "mindmap", "timeline", "sankey-beta", "xychart-beta", "block-beta", "packet-beta")


def element_error() -> Column:
    """What is wrong with an element of an outside writer, or null: unknown type, a field missing, a level out of range."""
    error = F.when(F.col("type").isNull() | ~F.col("type").isin(*REQUIRED), F.concat(F.lit("unknown type: "), F.coalesce("type", F.lit("none"))))
    for kind, fields in REQUIRED.items():
        for f in fields:
            error = error.when((F.col("type") == kind) & F.col(f).isNull(), F.lit(f"{kind} without {f}"))
    error = error.when((F.col("type") == "heading") & ~F.col("level").between(1, 6), F.lit("heading level out of range"))
    return error.when((F.col("type") == "list_item") & (F.col("level") < 1), F.lit("list level out of range")).when((F.col("type") == "table") & (F.size("rows") == 0), F.lit("table without rows"))


def diagram_error(source: Column) -> Column:
    """Null for a source whose first line, front matter and comments aside, begins a known diagram."""
    body = F.regexp_replace(source, r"(?s)\A\s*---[ \t]*\n.*?\n[ \t]*---[ \t]*(?:\n|\z)", "")
    lines = F.filter(F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("%%"))
    first = F.get(lines, F.lit(0))
    known = first.rlike("^(?:" + "|".join(DIAGRAMS) + r")(?![\w-])")
    return F.when(F.coalesce(known, F.lit(False)), None).otherwise(F.concat(F.lit("no known diagram: "), F.coalesce(first, F.lit(""))))


def describe(images: DataFrame, notes: DataFrame) -> DataFrame:
    """Images with the notes for them (``doc``, ``page_number``, ``asset``; ``description``, ``figure_text``, ``no_visible_text``).

    A text that was read from the page is never replaced, and an image with text is not without
    visible text. Adds ``refused`` with what was not taken. Of several notes for an image the
    longest description counts.
    """
    own = notes.groupBy("doc", "page_number", "asset").agg(F.max_by(F.struct(F.col("description").alias("d"), F.col("figure_text").alias("f"), F.col("no_visible_text").alias("v")), F.struct(F.length(F.coalesce("description", F.lit(""))), F.coalesce("description", F.lit("")))).alias("_n"))
    df = images.join(own, ["doc", "page_number", "asset"], "left")
    has = F.trim(F.coalesce("figure_text", F.lit(""))) != ""
    printed = F.trim(F.coalesce("caption", F.lit(""))) != ""
    wants = F.trim(F.coalesce("_n.f", F.lit(""))) != ""
    blank = F.coalesce("_n.v", F.lit(False))
    refused = F.concat_ws("; ", F.when(has & wants, "figure_text is there"), F.when(blank & (has | printed | wants), "image has text"))
    text = F.when(~has & wants, F.col("_n.f")).otherwise(F.col("figure_text"))
    return df.withColumns({"figure_text": text, "description": F.col("_n.d"), "no_visible_text": blank & ~(has | printed | wants), "refused": F.nullif(refused, F.lit(""))}).drop("_n")


def batches(work: DataFrame, budget: int, max_pages: int) -> DataFrame:
    """Pages in order as batches whose effort stays within a budget: ``doc``, ``page_number``, ``batch``, ``oversize``.

    A page above the budget is a batch of its own. What was put into a batch decides where the next
    begins, so each document is a grouped stage over its pages' effort.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("page_number")
        out, batch, used, pages = [], 0, 0, 0
        for effort in part["effort"]:
            if pages and (used + effort > budget or pages >= max_pages):
                batch, used, pages = batch + 1, 0, 0
            out.append(batch)
            used, pages = used + effort, pages + 1
        return pd.DataFrame({"doc": part["doc"], "page_number": part["page_number"], "batch": out, "oversize": part["effort"] > budget})

    return shipped(work).select("doc", "page_number", F.coalesce("effort", F.lit(0)).cast("bigint").alias("effort")).groupBy("doc").applyInPandas(run, "doc string, page_number int, batch int, oversize boolean")
