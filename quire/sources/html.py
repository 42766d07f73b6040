"""HTML as block elements, with the parser of the standard library.

An element that is not closed holds what follows until one around it is closed; void elements hold
nothing. A block is a heading, paragraph, table, preformatted text, quotation or list item, or a
container with text of its own and no block inside; there are no blocks within blocks. Scripts,
styles, templates, the head and comments have no text. White space is collapsed.
"""

from __future__ import annotations

import base64
import mimetypes
import posixpath
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import shipped

# Fixed values of HTML.
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p table pre blockquote li".split())
SILENT = frozenset("script style head template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAX_LEVEL = 3


class Node:
    """An element with its attributes and children, which are nodes and strings."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def nodes(self) -> Iterator[Node]:
        return (c for c in self.children if isinstance(c, Node))

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [*self.nodes()][::-1]
        while stack:
            n = stack.pop()
            yield n
            stack += [*n.nodes()][::-1]

    def strings(self) -> Iterator[str]:
        """Text below, without that of silent elements."""
        stack: list[Node | str] = self.children[::-1]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                yield n
            elif n.tag == "br":
                yield "\n"
            elif n.tag not in SILENT:
                stack += n.children[::-1]

    def text(self, joint: str = "") -> str:
        return " ".join(joint.join(self.strings()).split())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].children.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def blocks(root: Node) -> Iterator[Node]:
    """Block elements in document order."""
    stack = [*root.nodes()][::-1]
    while stack:
        n = stack.pop()
        if n.tag in SILENT:
            continue
        own = any(isinstance(c, str) and c.strip() for c in n.children)
        if n.tag in BLOCKS or (own and not any(d.tag in BLOCKS for d in n.walk())):
            yield n
        else:
            stack += [*n.nodes()][::-1]


def table_rows(table: Node) -> list[list[str]]:
    return [[c.text() for c in tr.nodes() if c.tag in ("td", "th")] for tr in table.walk() if tr.tag == "tr"]


def elements(html: str) -> list[tuple]:
    """Elements of one page: tag, type, level, text, rows; empty texts are left out."""
    out = []
    root = parse(html)
    for n in blocks(root):
        if n.tag == "table":
            rows = table_rows(n)
            if rows:
                out.append((n.tag, "table", None, None, rows))
        elif text := n.text():
            level = int(n.tag[1]) if len(n.tag) == 2 and n.tag[0] == "h" and n.tag[1].isdigit() else None
            out.append((n.tag, "heading" if level else "paragraph", level and min(level, MAX_LEVEL), text, None))
    return out


def read_html(pages: DataFrame, key: list[str], html: str) -> DataFrame:
    """Elements of HTML texts: the key, ``seq`` from 1, ``tag``, ``type``, ``level``, ``text``, ``rows``.

    Null and empty texts give none.
    """
    schema = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in key) + ", seq int, tag string, type string, level int, text string, rows array<array<string>>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(*k, i, *e) for *k, h in p.itertuples(index=False) for i, e in enumerate(elements(h), 1)]
            yield pd.DataFrame(rows, columns=[*key, "seq", "tag", "type", "level", "text", "rows"]).astype({"level": "Int32"})

    return shipped(pages).filter(F.col(html).isNotNull()).select(*key, F.col(html)).mapInPandas(run, schema)


def images(html: str) -> list[tuple[int, str, str | None, bytes | None]]:
    """Images of one page that can be kept: place from 1, ending, and path below the page's folder or content.

    Embedded ones have their content; remote ones, others than base64, and paths that lead out of the folder
    are left out, but keep their place.
    """
    out = []
    for place, n in enumerate((n for n in parse(html).walk() if n.tag == "img"), 1):
        src = (n.attrs.get("src") or "").strip()
        if src.startswith("data:"):
            head, _, data = src.partition(",")
            kind, *flags = head.removeprefix("data:").split(";")
            if "base64" in flags:
                try:
                    content = base64.b64decode(unquote(data))
                except ValueError:
                    continue
                out.append((place, (mimetypes.guess_extension(kind or "image/png") or ".png").lstrip("."), None, content))
            continue
        try:
            url = urlsplit(src)
        except ValueError:
            continue
        path = posixpath.normpath(unquote(url.path)) if url.path else ""
        if path and not url.scheme and not url.netloc and not path.startswith(("/", "..")):
            out.append((place, posixpath.splitext(path)[1].lstrip(".") or "png", path, None))
    return out


def html_images(pages: DataFrame, key: list[str], html: str) -> DataFrame:
    """Images of HTML texts: the key, ``place``, ``ext``, ``path`` and ``content``; see :func:`images`."""
    schema = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in key) + ", place int, ext string, path string, content binary"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([(*k, *i) for *k, h in p.itertuples(index=False) for i in images(h)], columns=[*key, "place", "ext", "path", "content"])

    return shipped(pages).filter(F.col(html).isNotNull()).select(*key, F.col(html)).mapInPandas(run, schema)


def with_contents(found: DataFrame, key: list[str], files: DataFrame) -> DataFrame:
    """Images with the contents of their files (key, ``path``, ``content``); those whose file is missing go."""
    paths = found.filter("path is not null").drop("content").join(files.select(*key, "path", "content"), [*key, "path"])
    return found.filter("path is null").unionByName(paths)


def triage(pages: DataFrame, html: str) -> DataFrame:
    """Whether each page has tables and images, found without a parse, and how closely to look at it."""
    table, images = F.col(html).rlike(r"(?i)<table[\s>]"), F.regexp_count(F.col(html), F.lit(r"(?i)<img[\s>/]"))
    return pages.withColumns({"has_table": table, "image_count": images, "loop_size": F.when(table | (images > 0), "tight").otherwise("loose")})
