"""Files of documents: formats, one file a document, and the readers of office formats.

Office files are read from their bytes with the standard library's zip and XML modules. A file that
is encrypted, of an old format, damaged or of an unknown kind gives one row with its ``reason``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.sources import html
from quire.session import shipped

# Extensions in the order of preference, and the first bytes of old office files.
FORMATS = {"pdf": "pdf", "pptx": "pptx", "xlsx": "xlsx", "docx": "docx", "html": "html", "htm": "html", "png": "image", "jpg": "image", "jpeg": "image", "webp": "image", "tiff": "image"}
OLE = bytes.fromhex("d0cf11e0a1b11ae1")
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SCHEMA = "doc string, page_number int, seq int, type string, level int, text string, rows array<array<string>>, asset string, reason string"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """One file per document name: ``doc``, ``format``, ``path``, ``sha256``, ``content``; others are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    known = F.create_map(*[F.lit(x) for i, (e, f) in enumerate(FORMATS.items()) for x in (e, f"{i:02d}{f}")])
    df = files.withColumns({"doc": F.regexp_replace(name, r"\.[^.]+$", ""), "_f": F.element_at(known, ext)}).filter("_f is not null")
    order = Window.partitionBy("doc").orderBy("_f", "path")
    df = df.withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return df.select("doc", F.substring("_f", 3, 9).alias("format"), "path", F.sha2("content", 256).alias("sha256"), "content")


def _text(node, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter(tag))


def _docx(z: zipfile.ZipFile) -> Iterator[tuple]:
    """Paragraphs, headings, tables and pictures; a page starts at each heading 1 after content."""
    links = {}
    if "word/_rels/document.xml.rels" in z.namelist():
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))}
    styles = {}
    if "word/styles.xml" in z.namelist():
        styles = {s.get(W + "styleId"): s.find(W + "name").get(W + "val", "") for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(W + "style") if s.find(W + "name") is not None}
    body = ElementTree.fromstring(z.read("word/document.xml")).find(W + "body")
    page, filled = 1, False
    for block in body if body is not None else ():
        if block.tag == W + "p":
            style = block.find(f"{W}pPr/{W}pStyle")
            name = styles.get(style.get(W + "val"), style.get(W + "val", "")) if style is not None else ""
            m = re.fullmatch(r"heading ?(\d)", name.lower())
            level = 1 if name.lower() == "title" else int(m[1]) if m else None
            if level == 1 and filled:
                page += 1
            filled = True
            if text := _text(block, W + "t").strip():
                yield page, "heading" if level else "paragraph", level and min(level, 3), text, None, None
        elif block.tag == W + "tbl":
            filled = True
            rows = [["\n".join(_text(p, W + "t") for p in c.iter(W + "p")) for c in r.findall(W + "tc")] for r in block.findall(W + "tr")]
            yield page, "table", None, None, rows, None
        for blip in block.iter(A + "blip"):
            if target := links.get(blip.get(R + "embed")):
                yield page, "image", None, None, None, target


def _number(text: str) -> str:
    """A stored number as people read it: whole numbers without a point."""
    try:
        x = float(text)
    except ValueError:
        return text
    return str(int(x)) if x == int(x) and abs(x) < 1e15 and "." not in text and "e" not in text.lower() else repr(x)


def _column(cell: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", cell)[0]:
        n = n * 26 + ord(c) - 64
    return n


def _xlsx(z: zipfile.ZipFile) -> Iterator[tuple]:
    """Each sheet as a page: its name as heading and its used range as one table."""
    names = z.namelist()
    shared = [_text(s, S + "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for page, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(S + "sheet"), 1):
        yield page, "heading", 1, sheet.get("name"), None, None
        path = links[sheet.get(R + "id")].lstrip("/")
        cells: dict[tuple[int, int], str] = {}
        for r, row in enumerate(ElementTree.fromstring(z.read(path if path in names else f"xl/{path}")).iter(S + "row"), 1):
            y = int(row.get("r", r))
            for x, c in enumerate(row.findall(S + "c"), 1):
                kind, v = c.get("t"), c.find(S + "v")
                if kind == "inlineStr":
                    value = _text(c, S + "t")
                elif v is None or v.text is None:
                    continue
                else:
                    value = shared[int(v.text)] if kind == "s" else ("True" if v.text == "1" else "False") if kind == "b" else v.text if kind in ("str", "e") else _number(v.text)
                cells[y, _column(c.get("r", "")) or x] = value
        if cells:
            ys, xs = sorted({y for y, _ in cells}), sorted({x for _, x in cells})
            yield page, "table", None, None, [[cells.get((y, x), "") for x in range(xs[0], xs[-1] + 1)] for y in range(ys[0], ys[-1] + 1)], None


def _pptx(z: zipfile.ZipFile) -> Iterator[tuple]:
    """Each slide as a page: its title as heading, other shapes from the top, tables and pictures."""
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    for page, name in enumerate(slides, 1):
        rels = name.replace("slides/", "slides/_rels/") + ".rels"
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read(rels))} if rels in z.namelist() else {}
        found = []
        for shape in ElementTree.fromstring(z.read(name)).iter():
            if shape.tag not in (P + "sp", P + "pic", P + "graphicFrame"):
                continue
            props = next((e for e in shape.iter(P + "cNvPr")), None)
            if props is not None and props.get("hidden") == "1":
                continue
            off = next((e for e in shape.iter(A + "off")), None)
            top = int(off.get("y", 0)) if off is not None else 0
            kind = next((e.get("type") for e in shape.iter(P + "ph")), None)
            if kind in ("ftr", "sldNum", "dt"):
                continue
            if shape.tag == P + "pic":
                blip = next((b for b in shape.iter(A + "blip")), None)
                found.append((False, top, ("image", None, None, None, links.get(blip.get(R + "embed")) if blip is not None else None)))
            elif shape.tag == P + "graphicFrame":
                for table in shape.iter(A + "tbl"):
                    rows = [["\n".join(_text(p, A + "t") for p in c.iter(A + "p")) for c in r.findall(A + "tc")] for r in table.findall(A + "tr")]
                    found.append((False, top, ("table", None, None, rows, None)))
            else:
                title = kind in ("title", "ctrTitle")
                for p in shape.iter(A + "p"):
                    if text := _text(p, A + "t").strip():
                        found.append((title, top, ("heading" if title else "paragraph", 1 if title else None, text, None, None)))
        for _, _, (kind, level, text, rows, asset) in sorted(found, key=lambda f: (not f[0], f[1])):
            yield page, kind, level, text, rows, asset


def _html(content: bytes) -> Iterator[tuple]:
    for _, kind, level, text, rows in html.elements(content.decode("utf-8", "replace")):
        yield 1, kind, level, text, rows, None


def read_file(kind: str, content: bytes) -> list[tuple]:
    """Rows of one file: page, place, type, level, text, rows, asset, reason."""
    try:
        if kind == "html":
            found = list(_html(content))
        elif kind in ("docx", "xlsx", "pptx"):
            if content[:8] == OLE:
                return [(None,) * 7 + ("encrypted, or an old office format",)]
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                found = list({"docx": _docx, "xlsx": _xlsx, "pptx": _pptx}[kind](z))
        else:
            return [(None,) * 7 + (f"no reader for {kind}",)]
    except (zipfile.BadZipFile, KeyError, IndexError, ValueError, ElementTree.ParseError) as e:
        return [(None,) * 7 + (f"unreadable: {type(e).__name__}",)]
    return [(p, i, k, level, text, rows, asset, None) for i, (p, k, level, text, rows, asset) in enumerate(found, 1)]


def read_documents(files: DataFrame) -> DataFrame:
    """Elements of files (``doc``, ``format``, ``content``); ``seq`` counts through the document."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for doc, kind, content in p.itertuples(index=False):  # a file at a time
                yield pd.DataFrame([(doc, *r) for r in read_file(kind, bytes(content))], columns=_COLUMNS).astype({"page_number": "Int32", "seq": "Int32", "level": "Int32"})

    return shipped(files).select("doc", "format", "content").mapInPandas(run, SCHEMA)
