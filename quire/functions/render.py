"""Elements as Markdown, JSON lines and HTML, as Column expressions on the element columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 6


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def markdown_table(rows: Column) -> Column:
    """A pipe table, ragged rows padded, the first row as its header; empty without rows."""
    cell = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    width = F.array_max(F.transform(rows, F.size))
    places = F.sequence(F.lit(0), width - 1)
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(places, lambda i: cell(F.get(r, i))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(places, lambda i: F.lit("---")), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    whole = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(rows) - 1, F.lit(0)))), "\n")
    return F.when((F.size(rows) > 0) & (width > 0), whole).otherwise("")


#: Columns of what was written about an image later, and the lines that enclose it.
DESCRIBED = ("caption_source", "description", "data_table", "mermaid")
INTERPRETED = ("<!-- interpretation -->", "<!-- /interpretation -->")


def described(elements: DataFrame) -> bool:
    """Whether elements have all columns of descriptions."""
    return set(DESCRIBED) <= set(elements.columns)


def markdown_image(interpreted: bool = False) -> Column:
    """The image, its printed caption and its text as a quotation.

    With ``interpreted`` also what was written about it, between :data:`INTERPRETED`: a caption whose source
    is ``agent``, which is then no printed one, the description, the data as a table and the diagram.
    """
    filled = lambda name: F.nullif(F.coalesce(name, F.lit("")), F.lit(""))
    written = F.coalesce(F.col("caption_source") == "agent", F.lit(False)) if interpreted else F.lit(False)
    caption, quoted = F.when(~written, filled("caption")), filled("figure_text")
    alt = F.coalesce(filled("description"), caption, F.lit("")) if interpreted else F.coalesce(caption, F.lit(""))
    shown = F.concat(F.lit("!["), alt, F.lit("]("), F.coalesce("asset", F.lit("")), F.lit(")"))
    parts = [shown, caption, F.concat(F.lit("> "), F.replace(quoted, F.lit("\n"), F.lit("\n> ")))]
    if interpreted:
        data = F.nullif(markdown_table(F.col("data_table")), F.lit(""))
        diagram = F.concat(F.lit("```mermaid\n"), filled("mermaid"), F.lit("\n```"))
        inner = F.nullif(F.concat_ws("\n\n", F.when(written, filled("caption")), filled("description"), data, diagram), F.lit(""))
        parts.append(F.concat(F.lit(INTERPRETED[0] + "\n"), inner, F.lit("\n" + INTERPRETED[1])))
    return F.concat_ws("\n", *parts)


def markdown(depth: str, interpreted: bool = False) -> Column:
    """Markdown of one element; ``depth`` names the column of list depths."""
    level = F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(LEVELS))
    marker = F.when(F.length(F.coalesce("marker", F.lit(""))) > 1, F.col("marker")).otherwise("-")
    kind = F.col("type")
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), _text()))
        .when(kind == "paragraph", _text())
        .when(kind == "list_item", F.concat(F.repeat(F.lit("  "), F.col(depth).cast("int")), marker, F.lit(" "), _text()))
        .when(kind == "table", F.coalesce(markdown_table(F.col("rows")), F.lit("")))
        .when(kind == "image", markdown_image(interpreted))
        .otherwise("")
    )


def page_markdown(elements: DataFrame) -> DataFrame:
    """Markdown of each page: ``doc``, ``page_number``, ``markdown``; items of one list run without blank lines."""
    from quire.operators.elements import list_depths
    from quire.operators.scan import page_keys

    within = Window.partitionBy(*page_keys(elements)).orderBy("seq")
    df = list_depths(elements).withColumn("_next", F.lead("type").over(within))
    gap = F.when((F.col("type") == "list_item") & (F.col("_next") == "list_item"), "\n").otherwise("\n\n")
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat(markdown("depth", described(elements)), gap).alias("m")))), lambda x: x["m"])
    return df.groupBy(*page_keys(elements)).agg(F.concat(F.trim(F.array_join(blocks, ""), F.lit("\n")), F.lit("\n")).alias("markdown")).drop("_block")


def json_line(number: Column, path: Column) -> Column:
    """One JSON object of an element: id by page, type, page, heading path and the fields that are set."""
    filled = lambda name: F.nullif(F.col(name), F.lit("")).alias(name)
    record = F.struct(
        F.concat(F.lit("p"), F.col("page_number"), F.lit("-"), number).alias("id"),
        F.col("type"),
        F.array("page_number").alias("pages"),
        path.alias("heading_path"),
        F.col("level"),
        *map(filled, ("marker", "text")),
        F.col("rows"),
        *map(filled, ("asset", "caption", "figure_text")),
        F.col("bbox"),
    )
    return F.to_json(record)


def escape_html(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def strike(text: Column) -> Column:
    """``~~struck~~`` as an HTML deletion; the text must be escaped already."""
    return F.regexp_replace(text, r"~~(\S(?:.*?\S)?)~~", "<del>$1</del>")


def html(depth: str) -> Column:
    """HTML of one element."""
    level = F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(LEVELS))
    body = strike(escape_html(_text()))
    tag = lambda name, inner: F.concat(F.lit("<"), name, F.lit(">"), inner, F.lit("</"), name, F.lit(">"))
    heading = F.concat(F.lit("h"), level)
    row = lambda r, cell: tag(F.lit("tr"), F.array_join(F.transform(r, lambda c: tag(F.lit(cell), strike(escape_html(F.coalesce(c, F.lit("")))))), ""))
    rows = F.col("rows")
    table = tag(F.lit("table"), F.concat(F.coalesce(row(F.get(rows, F.lit(0)), "th"), F.lit("")), F.array_join(F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: row(r, "td")), "")))
    image = F.concat(F.lit('<figure><img src="'), escape_html(F.coalesce("asset", F.lit(""))), F.lit('">'), F.when(F.coalesce("caption", F.lit("")) != "", tag(F.lit("figcaption"), escape_html(F.col("caption")))).otherwise(""), F.lit("</figure>"))
    kind = F.col("type")
    item = F.concat(F.lit('<li class="l'), F.col(depth).cast("int") + 1, F.lit('">'), body, F.lit("</li>"))
    return F.when(kind == "heading", tag(heading, body)).when(kind == "paragraph", tag(F.lit("p"), body)).when(kind == "list_item", item).when(kind == "table", F.coalesce(table, F.lit("<table></table>"))).when(kind == "image", image).otherwise("")
