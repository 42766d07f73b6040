"""Deeply nested document records as related flat tables.

A record is the JSON text of one merged document: pages that hold elements, table cells and
excluded regions, in layouts that differ by producer. ``flat_rows`` turns every record into linked
rows of four kinds with :mod:`quire.operators.structural`; ``flat_tables`` gives one table a kind.

Rules, for each record by itself:

* A null, empty or invalid text gives no rows. So does a record without pages.
* ``pages`` may sit in the root or in objects around it; the outermost one counts. It is a list, a
  map from page number to page, or one page. The page number is the page's own, a number or a
  number as text; else its key in the map; else its place in the list.
* A list stored without its enclosing list is a list of one, a list stored as text is that list,
  and a table row stored as an object is the list in it.
* Places count from 1 and include null entries. A null entry or cell gives no row; an empty string
  does. Of a name that is repeated in one object the last value counts.
* Names are compared without underscores and case, so ``excludedRegions`` is ``excluded_regions``.
* Repeated records give repeated rows; other columns of the input, whatever their names, are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.structural import ARRAY, NULL, OBJECT, STRING, Nodes, index
from quire.session import shipped

PAGE, ELEMENT, CELL, REGION = "page", "element", "cell", "region"
_KINDS = (PAGE, ELEMENT, CELL, REGION)
#: Payload bytes that are indexed at once; the index needs about 60 bytes for each.
BLOCK_BYTES = 2 << 20
_LINKS = [("page_no", pa.int32()), ("item_no", pa.int32()), ("row_no", pa.int32()), ("cell_no", pa.int32())]
#: Text fields of the rows of each kind.
FIELDS = {
    PAGE: ("tier", "skipped", "ocrconfidence"),
    ELEMENT: ("type", "text", "level", "marker", "kind", "asset", "caption", "figuretext", "bbox"),
    CELL: (),
    REGION: ("reason", "count", "filledcells", "bbox"),
}
_NAMES = {"ocrconfidence": "ocr_confidence", "figuretext": "figure_text", "filledcells": "filled_cells"}
_ALL = tuple(dict.fromkeys(f for k in _KINDS for f in FIELDS[k]))


def _plain(names: list[str]) -> list[str]:
    return [n.replace("_", "").lower() for n in names]


def _graft(nodes: Nodes) -> Nodes:
    """Put lists that are stored as text in the place of their text."""
    lists = [i for i, k in enumerate(nodes.keys) if k in ("pages", "elements", "rows", "excludedregions")]
    is_text = nodes.kind == STRING
    at = np.flatnonzero(is_text & np.isin(nodes.key, lists))
    rows = [i for i, k in enumerate(nodes.keys) if k == "rows"]
    kid = np.flatnonzero(is_text & (nodes.parent >= 0))
    at = np.r_[at, kid[np.isin(nodes.key[nodes.parent[kid]], rows)]]
    texts = {int(i): nodes.string(i) for i in at}
    at = np.array([i for i, t in texts.items() if t.lstrip(" \t\r\n")[:1] in ("[", "{")], np.int64)
    if not len(at):
        return nodes
    inner, good = index([texts[int(i)].encode("utf-8", "surrogatepass") for i in at])
    inner.keys = _plain(inner.keys)
    inner = _graft(inner)
    root = np.flatnonzero(inner.parent == -1)
    root_of = inner.text[root]
    old = at[root_of]
    shift = len(nodes)
    nodes.parent = nodes.parent.copy()
    parent = np.where(inner.parent >= 0, inner.parent + shift, inner.parent)
    parent[root], key, place = nodes.parent[old], inner.key.copy(), inner.place.copy()
    key[key >= 0] += len(nodes.keys)
    key[root], place[root] = nodes.key[old], nodes.place[old]
    nodes.parent[old] = -2  # the text itself is out
    return Nodes(
        nodes.data + inner.data,
        np.r_[nodes.text, nodes.text[at][inner.text]],
        np.r_[nodes.kind, inner.kind],
        np.r_[nodes.start, inner.start + len(nodes.data)],
        np.r_[nodes.end, inner.end + len(nodes.data)],
        np.r_[nodes.parent, parent],
        np.r_[nodes.place, place],
        np.r_[nodes.key, key],
        nodes.keys + inner.keys,
    )


def _entries(nodes: Nodes, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of list values: node, index of the list in ``lists``, place. -1 and null have none."""
    known = np.flatnonzero(lists >= 0)
    kind = nodes.kind[lists[known]]
    arrays = known[kind == ARRAY]
    kids, of = nodes.children(lists[arrays])
    alone = known[(kind != ARRAY) & (kind != NULL)]
    node, owner = np.r_[kids, lists[alone]], np.r_[arrays[of], alone]
    place = np.r_[nodes.place[kids], np.ones(len(alone), np.int64)]
    by = np.lexsort((place, owner))
    return node[by], owner[by], place[by]


def _integer(text: str) -> int | None:
    try:
        number = float(text)
        return int(number) if number == int(number) and abs(number) < 2**31 else None
    except (ValueError, OverflowError):
        return None


def _page_lists(nodes: Nodes) -> np.ndarray:
    """The node that holds the pages of each text, in any order."""
    root = nodes.parent == -1
    lists = {int(nodes.text[i]): int(i) for i in np.flatnonzero(root & (nodes.kind == ARRAY))}
    level = np.flatnonzero(root & (nodes.kind == OBJECT))
    while len(level):
        found = nodes.member(level, "pages")
        found = found[(found >= 0)]
        for i in found[nodes.kind[found] != NULL]:
            lists.setdefault(int(nodes.text[i]), int(i))
        kids, _ = nodes.children(level)
        kids = kids[nodes.kind[kids] == OBJECT]
        level = np.array([i for i in kids if int(nodes.text[i]) not in lists], np.int64)
    return np.array(list(lists.values()), np.int64)


def _pages(nodes: Nodes) -> tuple[np.ndarray, np.ndarray]:
    """Page nodes and their numbers."""
    lists = _page_lists(nodes)
    keys = np.array([_integer(k) is not None for k in nodes.keys] or [False])
    maps = lists[nodes.kind[lists] == OBJECT]
    kids, of = nodes.children(maps)
    numbered = np.zeros(len(maps), bool)
    numbered[of[keys[nodes.key[kids]]]] = True
    in_maps = kids[numbered[of]]
    node, _, place = _entries(nodes, np.setdiff1d(lists, maps[numbered]))
    node, place = np.r_[node, in_maps], np.r_[place, nodes.place[in_maps]]
    kept = nodes.kind[node] != NULL
    node, place = node[kept], place[kept]
    own = nodes.member(node, "pagenumber")
    number = np.zeros(len(node), np.int64)
    for i, (p, m) in enumerate(zip(node, own)):
        found = _integer(nodes.string(m)) if m >= 0 and nodes.kind[m] != NULL else None
        if found is None and nodes.key[p] >= 0 and nodes.kind[nodes.parent[p]] == OBJECT:
            found = _integer(nodes.keys[nodes.key[p]])
        number[i] = place[i] if found is None else found
    return node, number


def _cells(nodes: Nodes, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells of elements: node, index in ``elements``, row place, cell place."""
    tables = nodes.member(elements, "rows")
    row, owner, row_place = _entries(nodes, tables)
    # A table of scalars alone is one row without its enclosing list.
    nested = np.zeros(len(elements), bool)
    nested[owner[nodes.kind[row] <= ARRAY]] = True
    flat = np.zeros(len(elements), bool)
    known = tables >= 0
    flat[known] = nodes.kind[tables[known]] == ARRAY
    flat &= ~nested
    # The rest: each row is a list, the list in an object, or a scalar by itself.
    rest = ~flat[owner]
    lists, of, place = row[rest].copy(), owner[rest], row_place[rest]
    objects = np.flatnonzero(nodes.kind[lists] == OBJECT)
    kids, kid_of = nodes.children(lists[objects])
    inner = nodes.kind[kids] == ARRAY
    lists[objects] = -1
    lists[objects[kid_of[inner]][::-1]] = kids[inner][::-1]  # the first list in the object stays
    cell, at, cell_place = _entries(nodes, lists)
    cell = np.r_[cell, row[~rest]]
    of = np.r_[of[at], owner[~rest]]
    rows = np.r_[place[at], np.ones((~rest).sum(), np.int64)]
    places = np.r_[cell_place, row_place[~rest]]
    kept = nodes.kind[cell] != NULL
    return cell[kept], of[kept], rows[kept], places[kept]


def _texts(nodes: Nodes, of: np.ndarray) -> list[str | None]:
    kind = nodes.kind[of]
    return [None if i < 0 or k == NULL else nodes.string(i) for i, k in zip(of, kind)]


def _flatten(texts: list[bytes], values: bool) -> tuple[np.ndarray, pa.Table]:
    """Flat rows of some texts; the number of each row's text, and the other columns."""
    nodes, _ = index(texts)
    nodes.keys = _plain(nodes.keys)
    nodes = _graft(nodes)
    pages, numbers = _pages(nodes)
    item, item_page, item_no = _entries(nodes, nodes.member(pages, "elements"))
    kept = nodes.kind[item] != NULL
    item, item_page, item_no = item[kept], item_page[kept], item_no[kept]
    region, region_page, region_no = _entries(nodes, nodes.member(pages, "excludedregions"))
    kept = nodes.kind[region] != NULL
    region, region_page, region_no = region[kept], region_page[kept], region_no[kept]
    cell, cell_item, row_no, cell_no = _cells(nodes, item)
    node = np.r_[pages, item, cell, region]
    parts = [len(pages), len(item), len(cell), len(region)]
    zero = [np.zeros(p, np.int64) for p in parts]
    columns = {
        "page_no": np.r_[numbers, numbers[item_page], numbers[item_page[cell_item]], numbers[region_page]],
        "item_no": np.r_[zero[0], item_no, item_no[cell_item], region_no],
        "row_no": np.r_[zero[0], zero[1], row_no, zero[3]],
        "cell_no": np.r_[zero[0], zero[1], cell_no, zero[3]],
    }
    of = nodes.text[node]
    out = {"kind": pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(4), parts), pa.int8()), list(_KINDS)).cast(pa.string())}
    out |= {name: pa.array(columns[name].astype(np.int32)) for name, _ in _LINKS}
    if values:
        # Numbers within the record: its pages, elements, cells and regions, each in their order.
        on_page = np.r_[np.arange(parts[0]), item_page, item_page[cell_item], region_page]
        order = np.lexsort((columns["cell_no"], columns["row_no"], columns["item_no"], on_page, np.repeat(np.arange(4), parts), of))
        number = np.empty(len(node), np.int64)
        number[order] = np.arange(len(node)) - np.searchsorted(of[order], of[order]) + 1
        parent = np.r_[np.full(parts[0], -1), item_page, parts[0] + cell_item, region_page].astype(np.int64)
        out["row_id"] = pa.array(number)
        out["parent_id"] = pa.array(number[parent] if len(node) else number, mask=parent < 0)
        out["value"] = pa.array([None] * (len(node) - parts[2] - parts[3]) + _texts(nodes, cell) + [None] * parts[3], pa.string())
        starts = np.cumsum([0, *parts])
        for f in _ALL:
            text: list[str | None] = [None] * len(node)
            for k, name in enumerate(_KINDS):
                if f in FIELDS[name]:
                    text[starts[k] : starts[k + 1]] = _texts(nodes, nodes.member(node[starts[k] : starts[k + 1]], f))
            out[_NAMES.get(f, f if f != "kind" else "image_kind")] = pa.array(text, pa.string())
    return of, pa.table(out)


def _blocks(sizes: np.ndarray) -> Iterator[slice]:
    start = total = 0
    for i, s in enumerate(sizes):
        if total and total + s > BLOCK_BYTES:
            yield slice(start, i)
            start, total = i, 0
        total += s
    if len(sizes) > start:
        yield slice(start, len(sizes))


def flat_rows(records: DataFrame, id_column: str = "record_id", payload: str = "payload", values: bool = True) -> DataFrame:
    """One row per page, element, table cell and excluded region of every record.

    Columns: the id, ``kind``, ``page_no``, ``item_no``, ``row_no`` and ``cell_no``, 0 where they
    don't apply; with ``values`` also ``row_id``, which numbers the record's pages, then its elements,
    cells and regions, and ``parent_id``, null for pages, a cell's ``value`` and the text fields of :data:`FIELDS`.
    No shuffle: a record is flattened where it is read. An empty table gives an empty one.
    """
    id_type = records.schema[id_column].dataType
    fields = [T.StructField(id_column, id_type), T.StructField("kind", T.StringType())]
    fields += [T.StructField(n, T.IntegerType()) for n, _ in _LINKS]
    if values:
        fields += [T.StructField("row_id", T.LongType()), T.StructField("parent_id", T.LongType()), T.StructField("value", T.StringType())]
        fields += [T.StructField(_NAMES.get(f, f if f != "kind" else "image_kind"), T.StringType()) for f in _ALL]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            keep = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
            texts = texts.take(pa.array(keep)).cast(pa.large_binary())
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)) if len(texts) else np.zeros(0)
            for part in _blocks(sizes):
                of, rows = _flatten(texts[part].to_pylist(), values)
                rows = rows.add_column(0, id_column, ids.take(pa.array(keep[part][of])))
                yield from rows.select(names).combine_chunks().to_batches()

    return shipped(records).select(F.col(id_column), F.col(payload)).mapInArrow(run, T.StructType(fields))


def _box(c: F.Column) -> F.Column:
    """Four numbers of a list, a map with x0 .. y1 or a text of four numbers."""
    named = F.from_json(c, "struct<x0: double, y0: double, x1: double, y1: double>")
    listed = F.from_json(c, "array<double>")
    spaced = F.transform(F.split(F.trim(c), r"[\s,;]+"), lambda x: x.try_cast("double"))
    box = F.when(c.startswith("["), listed).when(c.startswith("{"), F.array(named.x0, named.y0, named.x1, named.y1)).otherwise(spaced)
    return F.when(F.size(box) == 4, box)


def flat_tables(records: DataFrame, id_column: str = "record_id", payload: str = "payload") -> dict[str, DataFrame]:
    """The flat tables ``page``, ``element``, ``cell`` and ``region``.

    Every row has the record's id, its own ``row_id`` and, but for pages, ``page_id`` or
    ``element_id``, the ``row_id`` of its parent in the same record.
    """
    rows = flat_rows(records, id_column, payload)
    key = [id_column, "row_id", "parent_id", "page_no"]

    def of(kind: str, parent: str | None, *columns: F.Column | str) -> DataFrame:
        t = rows.filter(F.col("kind") == kind).select(*key, *columns)
        return t.withColumnRenamed("parent_id", parent) if parent else t.drop("parent_id")

    integer = lambda name: F.col(name).try_cast("int").alias(name)
    return {
        PAGE: of(PAGE, None, "tier", "skipped", F.col("ocr_confidence").try_cast("double").alias("ocr_confidence")),
        ELEMENT: of(ELEMENT, "page_id", "item_no", F.lower("type").alias("type"), "text", integer("level"), "marker", "image_kind", "asset", "caption", "figure_text", _box(F.col("bbox")).alias("bbox")),
        CELL: of(CELL, "element_id", "item_no", "row_no", "cell_no", "value"),
        REGION: of(REGION, "page_id", "item_no", "reason", integer("count"), integer("filled_cells"), _box(F.col("bbox")).alias("bbox")),
    }
