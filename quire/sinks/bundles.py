"""Documents as files: Markdown, HTML, JSON lines, split bundles and requirement exchange.

Every format is a frame of ``doc``, ``path`` and ``content``, made by expressions and windows; what
writes it is separate. Paths begin with the document's folder.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import render
from quire.functions.text import first_sentence, heading_slug, slug, split_number, two_digits
from quire.operators.elements import list_depths, open_headings, sections
from quire.operators.scan import page_keys
from quire.session import shipped

REQIF = "http://www.omg.org/spec/ReqIF/20110401/reqif.xsd"


def _pages(df: DataFrame, column: str, joint: str) -> DataFrame:
    """One text a document from one a page, pages in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_number", F.col(column).alias("c")))), lambda x: x["c"])
    return df.groupBy("doc").agg(F.array_join(parts, joint).alias("content"))


def _named(df: DataFrame, ending: str) -> DataFrame:
    return df.select("doc", F.concat("doc", F.lit("/"), "doc", F.lit(ending)).alias("path"), "content")


def markdown_files(elements: DataFrame) -> DataFrame:
    return _named(_pages(render.page_markdown(elements), "markdown", "\n"), ".md")


def jsonl_lines(elements: DataFrame) -> DataFrame:
    """One JSON line an element: ``doc``, ``page_number``, ``seq``, ``line``; furniture images are left out."""
    body = elements.filter(~F.coalesce(F.col("kind") == "furniture", F.lit(False)))
    number = F.row_number().over(Window.partitionBy(*page_keys(elements)).orderBy("seq", "element_id"))
    df = open_headings(body).withColumn("_n", number)
    return df.select("doc", "page_number", "seq", render.json_line(F.col("_n").cast("string"), F.col("path")).alias("line"))


def jsonl_files(elements: DataFrame) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"])
    pages = jsonl_lines(elements).groupBy("doc", "page_number").agg(F.array_join(lines, "\n").alias("lines"))
    return _named(_pages(pages, "lines", "\n"), ".jsonl")


def page_html(elements: DataFrame) -> DataFrame:
    """``doc``, ``page_number``, ``html``: each page's elements, runs of list items in one list."""
    within = Window.partitionBy(*page_keys(elements)).orderBy("seq", "element_id")
    item = F.col("type") == "list_item"
    df = list_depths(elements).withColumns({"_a": F.coalesce(F.lag("type").over(within), F.lit("")), "_z": F.coalesce(F.lead("type").over(within), F.lit(""))})
    one = F.concat(F.when(item & (F.col("_a") != "list_item"), "<ul>").otherwise(""), render.html("depth"), F.when(item & (F.col("_z") != "list_item"), "</ul>").otherwise(""))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "element_id", one.alias("h")))), lambda x: x["h"])
    return df.groupBy(*page_keys(elements)).agg(F.array_join(parts, "\n").alias("html")).drop("_block")


def html_files(elements: DataFrame) -> DataFrame:
    body = _pages(page_html(elements).withColumn("html", F.concat(F.lit("<section>\n"), "html", F.lit("\n</section>"))), "html", "\n")
    head = F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>'), render.escape_html(F.col("doc")), F.lit("</title></head><body>\n"))
    return _named(body.withColumn("content", F.concat(head, "content", F.lit("\n</body></html>\n"))), ".html")


def _yaml(text):
    """A string as a quoted YAML scalar; JSON strings are such."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def _section_bodies(elements: DataFrame, depth: int) -> DataFrame:
    """Per section its heading, Markdown, first sentence and pages; the heading itself is no body."""
    marked = sections(list_depths(elements), depth)
    opener = (F.col("type") == "heading") & F.coalesce(F.col("level") <= depth, F.lit(False))
    within = Window.partitionBy("doc", "section").orderBy("page_number", "seq", "element_id")
    df = marked.withColumn("_next", F.lead("type").over(within)).withColumn("_open", opener)
    anchor = F.when(F.col("type") == "heading", F.concat(F.lit('<a id="'), heading_slug(F.coalesce("text", F.lit(""))), F.lit('"></a>\n\n'))).otherwise("")
    gap = F.when((F.col("type") == "list_item") & (F.col("_next") == "list_item"), "\n").otherwise("\n\n")
    order = F.struct("page_number", "seq", "element_id")
    text = F.trim(F.coalesce("text", F.lit("")))
    shown = render.markdown("depth", render.described(elements))
    body = lambda c: F.concat(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_open"), F.struct(order.alias("o"), c.alias("m"))))), lambda x: x["m"]), ""), F.lit("\n")), F.lit("\n"))
    return df.groupBy("doc", "section").agg(
        F.max(F.when(F.col("_open"), F.col("text"))).alias("heading"), F.max(F.when(F.col("_open"), F.col("level"))).alias("level"), F.count_if(~F.col("_open")).alias("n"),
        body(F.concat(shown, gap)).alias("body"), body(F.concat(anchor, shown, gap)).alias("anchored"),
        F.min_by(text, F.when((F.col("type") == "paragraph") & (text != ""), order)).alias("lead"), F.array_sort(F.collect_set("page_number")).alias("pages"),
    ).filter("heading is not null or n > 0")


def bundle_files(elements: DataFrame) -> DataFrame:
    """A file a level-1 section with front matter and links to its neighbours, and an index."""
    s = _section_bodies(elements, 1)
    order = Window.partitionBy("doc").orderBy("section")
    title = F.coalesce("heading", F.lit("Front Matter"))
    s = s.withColumns({"i": F.row_number().over(order) - 1, "title": title, "about": F.coalesce(first_sentence(F.col("lead")), F.lit(""))})
    s = s.withColumn("file", F.concat(F.format_string("%02d-", "i"), slug(F.col("title")), F.lit(".md")))
    s = s.withColumns({n: f(F.struct("title", "file")).over(order) for n, f in (("before", F.lag), ("after", F.lead))})
    link = lambda c, a, z: F.concat(F.lit("[" + a), c["title"], F.lit(z + "](/"), c["file"], F.lit(")"))
    links = F.concat_ws(" | ", link(F.col("before"), "← ", ""), link(F.col("after"), "", " →"))
    pages = F.concat_ws(", ", F.transform("pages", lambda p: p.cast("string")))
    front = F.concat(F.lit("---\ntype: Document Section\ntitle: "), _yaml(F.col("title")), F.lit("\ndescription: "), _yaml(F.col("about")), F.lit("\nsource_pages: ["), pages, F.lit("]\n---\n\n"))
    content = F.concat(front, "body", F.when(links != "", F.concat(F.lit("\n---\n\n"), links, F.lit("\n"))).otherwise(""))
    files = s.select("doc", F.concat("doc", F.lit("/"), "file").alias("path"), content.alias("content"))
    entry = F.concat(F.lit("* ["), "title", F.lit("](/"), "file", F.lit(")"), F.when(F.col("about") != "", F.concat(F.lit(" - "), "about")).otherwise(""))
    index = s.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", entry.alias("e")))), lambda x: x["e"]), "\n").alias("list"))
    return files.unionByName(index.select("doc", F.concat("doc", F.lit("/index.md")).alias("path"), F.concat(F.lit("# "), "doc", F.lit("\n\n"), "list", F.lit("\n")).alias("content")))


def tree_files(elements: DataFrame, depth: int = 2) -> DataFrame:
    """A folder for each heading above ``depth`` and a file for each at it, with anchors, and an index.

    A heading above the depth holds its own content in a file of its folder. One at the depth
    without a folder above it lies at the top. Names that a folder has twice get a number.
    """
    if not 1 <= depth <= 6:
        raise ValueError("the depth is between 1 and 6")
    s = _section_bodies(elements, depth)
    number, title = split_number(F.coalesce("heading", F.lit("Front Matter")))
    order = Window.partitionBy("doc").orderBy("section")
    s = s.withColumns({"level": F.coalesce(F.least("level", F.lit(depth)), F.lit(1)), "number": number, "title": title, "i": F.row_number().over(order)})
    name = F.concat(two_digits(F.col("number"), F.col("i")), F.lit("-"), slug(F.col("title")))
    s = s.withColumn("name", name)
    for k in range(1, depth):  # the open folders, as for headings
        at = F.last(F.when(F.col("level") == k, F.struct("section", "name")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        s = s.withColumn(f"_f{k}", at)
    opened = []
    for k in range(1, depth):
        above = [F.coalesce(F.col(f"_f{j}.section"), F.lit(-1)) for j in range(1, k)]
        still = (F.col(f"_f{k}.section") > (F.greatest(F.lit(-1), *above) if above else F.lit(-1))) & (F.col("level") > k)
        opened.append(F.when(still, F.col(f"_f{k}.name")))
    folder = F.concat_ws("/", "doc", *opened)
    own = F.when((F.col("level") < depth) & F.col("heading").isNotNull(), F.concat(F.col("name"), F.lit("/00-"), slug(F.col("title")))).otherwise(F.col("name"))
    s = s.withColumns({"stem": F.concat(folder, F.lit("/"), own), "shift": F.size(F.array_compact(F.array(*opened)))})
    again = F.row_number().over(Window.partitionBy("doc", "stem").orderBy("section"))
    s = s.withColumn("_again", again).withColumn("path", F.concat("stem", F.when(F.col("_again") > 1, F.concat(F.lit("-"), "_again")).otherwise(""), F.lit(".md")))
    anchor = F.when(F.col("heading").isNotNull(), F.concat(F.lit('<a id="'), heading_slug(F.col("heading")), F.lit('"></a>\n\n'))).otherwise("")
    pages = F.concat_ws(", ", F.transform("pages", lambda p: p.cast("string")))
    front = F.concat(F.lit("---\ntitle: "), _yaml(F.col("title")), F.when(F.col("number").isNotNull(), F.concat(F.lit("\nsection: "), _yaml(F.col("number")))).otherwise(""), F.lit("\nsource_pages: ["), pages, F.lit("]\n---\n\n"))
    files = s.select("doc", "path", F.concat(front, anchor, "anchored").alias("content"))
    entry = F.concat(F.repeat(F.lit("  "), F.col("shift")), F.lit("* ["), F.coalesce("heading", F.lit("Front Matter")), F.lit("]("), F.expr("substring(path, length(doc) + 2)"), F.lit(")"))
    index = s.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", entry.alias("e")))), lambda x: x["e"]), "\n").alias("list"))
    return files.unionByName(index.select("doc", F.concat("doc", F.lit("/index.md")).alias("path"), F.concat(F.lit("# "), "doc", F.lit("\n\n"), "list", F.lit("\n")).alias("content")))


def _identifier(*parts) -> str:
    return "_" + hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()[:32]


def _reqif(doc: str, part: pd.DataFrame) -> str:
    ElementTree.register_namespace("", REQIF)
    q = lambda n: f"{{{REQIF}}}{n}"
    clean = lambda t: "".join(" " if ord(c) < 32 and c not in "\t\n\r" else c for c in t or "")
    root = ElementTree.Element(q("REQ-IF"))
    core = ElementTree.SubElement(ElementTree.SubElement(root, q("CORE-CONTENT")), q("REQ-IF-CONTENT"))
    objects = ElementTree.SubElement(core, q("SPEC-OBJECTS"))
    spec = ElementTree.SubElement(ElementTree.SubElement(core, q("SPECIFICATIONS")), q("SPECIFICATION"), {"IDENTIFIER": _identifier(doc), "LONG-NAME": doc})
    places: dict[int | None, ElementTree.Element] = {None: ElementTree.SubElement(spec, q("CHILDREN"))}
    for r in part.itertuples(index=False):
        text = clean(r.text if isinstance(r.text, str) else r.cells)
        o = ElementTree.SubElement(objects, q("SPEC-OBJECT"), {"IDENTIFIER": _identifier(doc, r.element_id), "LONG-NAME": text[:100]})
        ElementTree.SubElement(ElementTree.SubElement(o, q("VALUES")), q("ATTRIBUTE-VALUE-STRING"), {"THE-VALUE": text})
        parent = None if pd.isna(r.parent_id) else int(r.parent_id)
        h = ElementTree.SubElement(places.get(parent, places[None]), q("SPEC-HIERARCHY"), {"IDENTIFIER": _identifier(doc, r.element_id, "h")})
        ElementTree.SubElement(ElementTree.SubElement(h, q("OBJECT")), q("SPEC-OBJECT-REF")).text = _identifier(doc, r.element_id)
        if r.type == "heading":
            places[int(r.element_id)] = ElementTree.SubElement(h, q("CHILDREN"))
    return ElementTree.tostring(root, encoding="unicode", xml_declaration=True)


def reqif_files(elements: DataFrame) -> DataFrame:
    """Requirement exchange: an object an element, under the heading above it. XML of one document is one task."""
    df = open_headings(elements).select("doc", "page_number", "seq", "element_id", "parent_id", "type", "text", F.coalesce(render.markdown_table(F.col("rows")), F.col("caption"), F.lit("")).alias("cells"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        doc = part["doc"].iloc[0]
        return pd.DataFrame({"doc": [doc], "path": [f"{doc}/{doc}.reqif"], "content": [_reqif(doc, part.sort_values(["page_number", "seq", "element_id"]))]})

    return shipped(df).groupBy("doc").applyInPandas(run, "doc string, path string, content string")


def write_files(files: DataFrame, root: str) -> None:
    """Write each row as a file below ``root``, a folder that all executors share; whole or not at all."""

    def write(rows: Iterator) -> None:
        for r in rows:
            target = os.path.join(root, *[p for p in r.path.split("/") if p not in ("", ".", "..")])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            part = f"{target}.{os.getpid()}.part"
            with open(part, "w", encoding="utf-8", newline="") as f:
                f.write(r.content)
            os.replace(part, target)

    files.select("path", "content").foreachPartition(write)
