"""Rows with defects that the given tables lack, added to all of ``elements`` for the queries that look for them.

The same rows are written as a frame and as SQL, so that both sides of a comparison have cases.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.tables import table

_FIRST, _AGAIN = dt.datetime(2024, 1, 1, tzinfo=dt.UTC), dt.datetime(2024, 2, 1, tzinfo=dt.UTC)
_COLUMNS = {
    "element_id": "bigint", "doc": "string", "page_number": "int", "seq": "int", "tier": "string", "type": "string", "text": "string", "level": "int", "marker": "string",
    "rows": "array<array<string>>", "bbox": "array<double>", "kind": "string", "asset": "string", "caption": "string", "figure_text": "string", "extracted_at": "timestamp",
}


def _rows() -> list[dict]:
    rows: list[dict] = []

    def add(doc: str, page: int, seq: int, type_: str, **more) -> None:
        rows.append({"element_id": -1 - len(rows), "doc": f"planted-{doc}", "page_number": page, "seq": seq, "tier": "text", "type": type_, "extracted_at": _FIRST} | more)

    for p in range(1, 6):
        add("running", p, 1, "paragraph", text=f"Handbook 7 page {p}", bbox=[50.0, 10.0 + p, 300.0, 24.0 + p])
        add("running", p, 2, "paragraph", text=f"Body of page {p}.", bbox=[50.0, 200.0, 500.0, 220.0])
        add("running", p, 3, "image", kind="path", asset="a.png", caption="Figure 1", bbox=[400.0 + 0.3 * p, 40.0, 450.0, 60.0])
    add("running", 5, 4, "image", kind="path", asset="b.png", caption="Figure 2", bbox=[100.0, 300.0, 200.0, 400.0])
    add("captions", 1, 1, "paragraph", text="Figure 3. A drawing that is gone")
    add("captions", 1, 2, "paragraph", text="Figure 4: A drawing on the next page")
    add("captions", 2, 1, "image", asset="c.png", caption="figure 4:  A drawing on the next page")
    add("captions", 2, 2, "image", asset="d.png", caption="Table 5: Values")
    add("levels", 1, 1, "heading", text="2.1 Parts", level=4)
    add("levels", 1, 2, "heading", text="2.2 Tools", level=2)
    add("levels", 1, 3, "heading", text="2.2.1 Small tools")
    add("coverage", 1, 1, "paragraph", text="alpha beta gamma delta epsilon words that nobody kept")
    add("coverage", 1, 2, "paragraph", text="alpha beta", tier="vision")
    add("coverage", 2, 1, "paragraph", text="gamma stands here", tier="vision")
    add("again", 1, 1, "paragraph", text="A sentence that the second extraction has lost altogether.")
    add("again", 1, 1, "paragraph", text="A sentence.", extracted_at=_AGAIN)
    add("again", 1, 2, "paragraph", text="A sentence that both of the extractions have.")
    add("again", 1, 2, "paragraph", text="A  sentence that both of the EXTRACTIONS have.", extracted_at=_AGAIN)
    add("errors", 1, 1, "heading", text="No level")
    add("errors", 1, 2, "heading", level=1)
    add("errors", 1, 3, "heading", text="Deep", level=7)
    add("errors", 1, 4, "sketch", text="Unknown")
    add("errors", 1, 5, "list_item", text="No marker", level=1)
    add("errors", 1, 6, "list_item", text="Level none", marker="-", level=0)
    add("errors", 1, 7, "table")
    add("errors", 1, 8, "table", rows=[])
    add("errors", 1, 9, "image")
    add("errors", 1, 10, "paragraph")
    head = ["part", "size"]
    for p, cells, box in ((1, [["a", "1"]], [50.0, 600.0, 500.0, 780.0]), (2, [["b", "2"], ["c", "3"]], [50.5, 20.0, 500.5, 780.0]), (3, [["d", "4"]], [50.0, 20.0, 500.0, 90.0])):
        add("chain", p, 1, "table", rows=[head, *cells], bbox=box)
    add("chain", 3, 2, "paragraph", text="After the table.")
    add("chain", 5, 1, "table", rows=[head], bbox=[50.0, 600.0, 500.0, 780.0])
    add("chain", 6, 1, "table", rows=[["three", "columns", "here"]], bbox=[50.0, 20.0, 500.0, 90.0])
    add("native", 1, 1, "table", rows=[head, ["a", "1"]])
    add("native", 1, 1, "table", rows=[head, ["a", "1"], ["b", "2"]], extracted_at=_AGAIN)
    add("native", 1, 2, "table", rows=[head, ["a", "1"]])
    add("native", 1, 2, "table", rows=[head, ["a"]], extracted_at=_AGAIN)
    add("native", 1, 3, "image", asset="e.png", caption="Figure 6: Pump")
    add("native", 1, 3, "paragraph", text="Figure 6: Pump", extracted_at=_AGAIN)
    add("native", 2, 1, "image", asset="f.png", caption="Figure 7: Valve")
    add("native", 2, 1, "image", asset="g.png", caption=" Figure ", extracted_at=_AGAIN)
    add("native", 2, 2, "heading", text="Scope of it", level=1)
    add("native", 2, 2, "heading", text="Scope of it", level=2, extracted_at=_AGAIN)
    add("native", 3, 1, "image", asset="h.png", caption="Figure 8", tier="vision")
    add("native", 3, 1, "paragraph", text="Figure 8", extracted_at=_AGAIN)
    add("native", 3, 2, "table", rows=[head], tier="vision")
    return rows


def elements(spark: SparkSession, folder: str) -> DataFrame:
    """All elements and the planted rows."""
    planted = spark.createDataFrame([tuple(r.get(c) for c in _COLUMNS) for r in _rows()], ", ".join(f"{c} {t}" for c, t in _COLUMNS.items()))
    given = table(spark, folder, "elements")
    return given.unionByName(planted.withColumn("extracted_at", F.col("extracted_at").cast(given.schema["extracted_at"].dataType)), allowMissingColumns=True)


def _literal(value: object, kind: str) -> str:
    if value is None:
        text = "null"
    elif isinstance(value, list):
        text = "[" + ", ".join(_literal(v, "")[0:] for v in value) + "]"
    elif isinstance(value, dt.datetime):
        text = f"'{value.isoformat(sep=' ')}'"
    else:
        text = f"'{value}'" if isinstance(value, str) else str(value)
    types = {"string": "varchar", "timestamp": "timestamptz", "array<double>": "double[]", "array<array<string>>": "varchar[][]", "int": "integer"}
    return f"cast({text} as {types.get(kind, kind)})" if kind else text


#: ``elements_and_planted`` as the first of a query's common tables.
CTE = (
    "elements_and_planted as (select * from elements union all by name select * from (values "
    + ", ".join("(" + ", ".join(_literal(r.get(c), t) for c, t in _COLUMNS.items()) + ")" for r in _rows())
    + f") as p({', '.join(_COLUMNS)}))"
)


def sql(text: str) -> str:
    """A query on elements as one on elements and the planted rows."""
    moved = text.replace("from elements", "from elements_and_planted")
    return f"with {CTE}, {moved.removeprefix('with ')}"
