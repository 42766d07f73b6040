import datetime as dt
import random

import pytest

from quire.operators import elements as ops
from quire.operators import page_breaks
from quire.operators.scan import BLOCK_PAGES, scan

SCHEMA = "element_id bigint, doc string, page_number int, seq int, type string, text string, level int, marker string, rows array<array<string>>, bbox array<double>, tier string, extracted_at timestamp"
T0 = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    """rows: (doc, page, seq, type, text, level[, bbox[, rows]])"""
    full = []
    for i, r in enumerate(rows, 1):
        doc, page, seq, kind, text, level, *more = r
        full.append((i, doc, page, seq, kind, text, level, "•", more[1] if len(more) > 1 else None, more[0] if more else None, "text", T0))
    random.Random(1).shuffle(full)
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def random_rows():
    rnd = random.Random(11)
    rows = []
    for d in range(25):
        page = 1
        for seq in range(60):
            page += rnd.random() < 0.1 and rnd.choice([1, 1, 2, BLOCK_PAGES])
            kind = rnd.choice(["heading", "list_item", "list_item", "paragraph"])
            rows.append((f"d{d}", page, seq, kind, f"t{seq}", rnd.choice([1, 2, 3, 4, None, 9])))
    return rows


def clamp(level):
    return min(max(level or 1, 1), ops.LEVELS)


def test_open_headings_equal_a_stack(spark, random_rows):
    got = {r.element_id: (list(r.path), r.parent_id) for r in ops.open_headings(frame(spark, random_rows)).collect()}
    stack, doc = [], None
    for i, (d, _, _, kind, text, level) in enumerate(random_rows, 1):
        if d != doc:
            stack, doc = [], d
        if kind == "heading":
            stack = [s for s in stack if s[0] < clamp(level)]
        assert got[i] == ([s[1] for s in stack], stack[-1][2] if stack else None)
        if kind == "heading":
            stack.append((clamp(level), text, i))


def test_list_depths_equal_a_stack(spark, random_rows):
    got = {r.element_id: r.depth for r in ops.list_depths(frame(spark, random_rows)).collect()}
    stack, doc = [], None
    for i, (d, _, _, kind, _, level) in enumerate(random_rows, 1):
        if d != doc or kind != "list_item":
            stack, doc = [], d
        if kind != "list_item":
            assert got[i] is None
            continue
        while stack and stack[-1] >= clamp(level):
            stack.pop()
        assert got[i] == len(stack)
        stack.append(clamp(level))


def test_scan_runs_over_blocks(spark, random_rows):
    from pyspark.sql import functions as F

    df = scan(frame(spark, random_rows), {"last": F.when(F.col("level") == 2, F.col("text"))}, {"n": F.lit(1)})
    got = {r.element_id: (r["last"], r.n) for r in df.collect()}
    last, n, doc = None, 0, None
    for i, (d, _, _, _, text, level) in enumerate(random_rows, 1):
        if d != doc:
            last, n, doc = None, 0, d
        n += 1
        assert got[i] == (last, n)
        last = text if level == 2 else last


def test_latest_and_tiers(spark):
    rows = [(1, "d", 1, 1, "paragraph", "old", None, None, None, None, "text", T0), (2, "d", 1, 1, "paragraph", "new", None, None, None, None, "ocr", T0 + dt.timedelta(1)), (3, "d", 1, 2, "paragraph", "a", None, None, None, None, "text", None), (4, "d", 1, 2, "paragraph", "b", None, None, None, None, "text", None), (5, "d", 1, 3, "image", None, None, None, None, None, "text", T0), (6, None, 1, 1, "paragraph", "x", None, None, None, None, "text", T0), (7, "d", 2, 1, "paragraph", "y", None, None, None, None, "odd", T0)]
    now = ops.latest(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.element_id for r in now.collect()) == [2, 4, 5, 7]
    assert sorted(r.element_id for r in ops.best_tier(now).collect()) == [2, 5, 7]


def test_sub_headings_take_the_level_below(spark):
    rows = [("d", 1, 1, "heading", "s", None), ("d", 1, 2, "heading", "a", 2), ("d", 1, 3, "heading", "b", None), ("d", 2, 1, "heading", "c", 6), ("d", 3, 1, "heading", "e", None)]
    got = {r.text: r.level for r in ops.sub_heading_levels(frame(spark, rows)).collect()}
    assert got == {"s": 1, "a": 2, "b": 3, "c": 6, "e": 6}


def joins_by_hand(rows):
    """The rule, page by page, on lists that lose what was joined away."""
    pages = {}
    for i, (_, page, _, kind, text, _, box) in enumerate(rows, 1):
        pages.setdefault(page, []).append({"id": i, "type": kind, "text": text, "box": box})
    out = {}
    for n in sorted(pages):
        a, b = [e for e in pages[n] if e["type"] != "image"], [e for e in pages.get(n + 1, []) if e["type"] != "image"]
        if not a or not b:
            continue
        x, y = a[-1], b[0]
        if x["type"] not in ("paragraph", "list_item") or y["type"] != "paragraph" or x["text"].rstrip()[-1:] in tuple(".!?:;"):
            continue
        if x["box"] and y["box"]:
            if abs(x["box"][0] - y["box"][0]) > 3:
                continue
        elif not y["text"][:1].islower():
            continue
        out[x["id"]] = y["id"]
        pages[n + 1].remove(y)
    return out


def test_page_breaks_equal_a_pass_over_the_pages(spark):
    rnd = random.Random(3)
    rows, want, base = [], {}, 0
    for d in range(60):
        own = []
        for page in range(1, 12):
            for seq in range(rnd.choice([0, 1, 1, 1, 2, 3])):
                box = rnd.choice([None, [10.0, 0.0, 50.0, 9.0], [12.0, 0.0, 50.0, 9.0], [40.0, 0.0, 60.0, 9.0]])
                own.append((f"d{d}", page, seq, rnd.choice(["paragraph"] * 4 + ["list_item", "image", "heading"]), rnd.choice(["ends.", "cut", "cut-", "Big", ""]), None, box))
        want |= {base + a: base + b for a, b in joins_by_hand(own).items()}
        base += len(own)
        rows += own
    got = {r.element_id: r.joined_id for r in page_breaks.page_break_joins(frame(spark, rows)).collect()}
    assert got == want


def test_table_chains(spark):
    box = [10.0, 0.0, 90.0, 9.0]
    head = ["a", "b"]
    rows = [("d", 1, 1, "paragraph", "x", None), ("d", 1, 2, "table", None, None, box, [head, ["1", "2"]]), ("d", 2, 1, "table", None, None, box, [head, ["3", "4"]]), ("d", 3, 1, "table", None, None, [11.0, 0.0, 91.0, 9.0], [["5", "6"]]), ("d", 3, 2, "paragraph", "y", None)]
    rows += [("e", 1, 1, "table", None, None, box, [head]), ("e", 2, 1, "table", None, None, [20.0, 0.0, 90.0, 9.0], [head]), ("f", 1, 1, "table", None, None, box, [head]), ("f", 3, 1, "table", None, None, box, [head]), ("g", 1, 1, "table", None, None, box, [head]), ("g", 2, 1, "table", None, None, box, [["1", "2", "3"]])]
    got = page_breaks.table_chains(frame(spark, rows)).collect()
    assert [(r.element_id, list(r.parts), r.rows) for r in got] == [(2, [2, 3, 4], 4)]
