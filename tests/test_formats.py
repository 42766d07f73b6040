from pyspark.sql import functions as F

from quire.operators import formats, furniture, gates, toc
from quire.sources import markdown

E = "element_id bigint, doc string, page_number int, seq int, type string, text string, rows array<array<string>>, caption string, asset string, bbox array<double>, tier string, source_shape_id string, cells int"


def frame(spark, rows):
    names = [c.split()[0] for c in E.split(", ")]
    return spark.createDataFrame([tuple({"element_id": i, "doc": "d", "page_number": 1, "seq": i, "type": "paragraph", "cells": 0}.get(n) if n not in r else r[n] for n in names) for i, r in enumerate(rows, 1)], E)


def tables(*shapes):
    return [{"type": "table", "rows": s} for s in shapes]


def test_tables_are_compared_in_order(spark):
    a, b = [["x", "y"], ["1", "2"]], [["x"], ["1", "2"]]
    bad = lambda s, o, exact=False: [(r.page_number, r.tables) for r in formats.table_corruption(frame(spark, s), frame(spark, o), exact).collect()]
    assert bad(tables(a, a), tables(a, a)) == []
    assert bad(tables(a), tables(b)) == [] and bad(tables(a), tables(b), exact=True) == [(1, 1)]
    assert bad(tables(a, b), tables(a)) == [(1, 1)] and bad(tables(), tables(a)) == [(1, 1)]
    assert bad(tables(a), tables(a[:1])) == [(1, 1)]
    assert bad(tables(None, []), tables([], None)) == [] and bad(tables(), tables()) == []


def test_images_and_captions(spark):
    s = frame(spark, [{"type": "image", "caption": "Figure"}, {"type": "image", "caption": None, "asset": "a"}])
    o = frame(spark, [{"type": "image", "caption": " PICTURE ", "asset": "b"}, {}])
    assert [(r.page_number, r.lost) for r in formats.lost_images(s, o).collect()] == [(1, 1)]
    assert formats.lost_images(o, s).collect() == []
    assert [r.element_id for r in formats.generic_captions(o).collect()] == [1]
    files = spark.createDataFrame([("d", "a"), ("d", "a"), ("e", "b")], "doc string, path string")
    assert [r.element_id for r in gates.missing_assets(s, files).collect()] == [1]
    assert [r.element_id for r in gates.missing_assets(o, files).collect()] == [1]


def test_figures_of_the_census(spark):
    census = spark.createDataFrame([("d", 1, "s1", None, "picture"), ("d", 1, "s2", ["g1", "g2"], "group"), ("d", 1, "s3", [], "chart"), ("d", 2, "s4", [], "picture"), ("d", 3, "s5", [], "picture"), ("d", 3, "s6", [], "picture")], "doc string, page_number int, shape_id string, groups array<string>, kind string")
    out = frame(spark, [{"type": "image", "source_shape_id": "s1"}, {"type": "table", "source_shape_id": "g2"}, {"source_shape_id": "s3"}, {"page_number": 2, "type": "image", "tier": "vision"}, {"page_number": 3, "type": "image", "tier": "vision"}])
    assert sorted(r.shape_id for r in gates.uncovered_figures(census, out).collect()) == ["s3", "s5", "s6"]
    assert gates.uncovered_figures(census.limit(0), out).collect() == []


def test_outputs_are_complete(spark):
    rows = [("a", "a/index.md", "# Contents\n[One](./01.md)\n[Two](two/02.md)"), ("a", "a/01.md", "x"), ("a", "a/two/02.md", "y"), ("b", "b/01.md", "x"), ("c", "c/index.md", "short"), ("d", "d/index.md", "no links in this index"), ("e", "e/index.md", "one that is dead [x](gone.md)")]
    got = {r.doc: r.reason for r in gates.incomplete_outputs(spark.createDataFrame(rows, "doc string, path string, content string")).collect()}
    assert got == {"b": "no index", "c": "index too short", "d": "no links", "e": "dead links"}


def test_warnings_only_where_all_entries_met(spark):
    lines = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("c", None)], "doc string, unparsed string")
    got = gates.unparsed_warnings(lines, spark.createDataFrame([("b",)], "doc string")).collect()
    assert [(r.doc, r.lines, r.first) for r in got] == [("a", 2, "x")]


def test_running_lines_by_place(spark):
    patterns = spark.createDataFrame([("d", "Page#"), ("d", "#")], "doc string, key string")
    rows = [{"text": "Page 3", "bbox": [0.0, 5.0, 9.0, 15.0]}, {"text": "Page 3", "bbox": [0.0, 300.0, 9.0, 315.0]}, {"text": "Page 3\nbody"}, {"text": "12"}, {"text": "12", "bbox": [0.0, 780.0, 9.0, 790.0]}, {"text": None}]
    got = {r.element_id: (r.text, r.removed) for r in furniture.strip_banded(frame(spark, rows), patterns, F.lit(792.0)).collect()}
    assert {k: v for k, v in got.items() if v[1]} == {1: ("", 1), 3: ("body", 1), 5: ("", 1)}
    lines = spark.createDataFrame([("a", [0.0, 1.0], [5.0, 100.0, 20.0, 400.0]), ("b", [1.0, 0.0], [5.0, 100.0, 20.0, 110.0]), ("c", [0.0, -1.0], [5.0, 100.0, 200.0, 400.0]), ("e", [0.0, -1.0], [590.0, 1.0, 600.0, 90.0])], "id string, dir array<double>, bbox array<double>")
    assert sorted(r.id for r in furniture.side_margin_lines(lines, F.lit(612.0)).collect()) == ["a", "e"]


def test_repeated_images(spark):
    top, mid, full = [10.0, 5.0, 60.0, 40.0], [10.0, 300.0, 60.0, 340.0], [0.0, 0.0, 612.0, 780.0]
    rows = [{"page_number": p, "type": "image", "asset": a, "bbox": b} for p in (1, 2, 3) for a, b in (("logo", top), ("shot", mid), ("back", full))] + [{"page_number": 2, "type": "image", "asset": "logo", "bbox": mid}, {"page_number": 4, "type": "image", "asset": "none", "bbox": None}]
    df = frame(spark, rows)
    got = {r.asset: r.pages for r in furniture.repeated_images(df, F.lit(792.0), F.lit(612.0 * 792.0), df).collect()}
    assert got == {"logo": 2, "back": 3}


def test_grids_of_charts(spark):
    cells = [[10.0 * x, 10.0 * y, 10.0 * x + 10, 10.0 * y + 10] for x in range(3) for y in range(3)]
    t = [("d", 1, i, [0.0, 0.0, 30.0, 30.0], cells, filled) for i, filled in ((1, 0.9), (2, 0.05))]
    table = spark.createDataFrame(t, "doc string, page_number int, table_id int, bbox array<double>, cells array<array<double>>, filled double")
    rule, shade, tick, bar = ("line", [0.0, 10.0, 30.0, 10.0]), ("rect", [0.0, 0.0, 10.0, 10.0]), ("other", [2.0, 2.0, 7.0, 7.0]), ("rect", [5.0, 4.0, 8.0, 28.0])
    corner, curve = ("curve", [-1.0, -1.0, 6.0, 6.0]), ("curve", [1.0, 1.0, 28.0, 26.0])

    def why(*drawings):
        items = spark.createDataFrame([("d", 1, k, op, box) for k, d in enumerate(drawings) for op, box in d], "doc string, page_number int, drawing_id int, op string, bbox array<double>")
        return {r.table_id: r.why for r in formats.grid_tables(table, items).collect()}

    assert why([rule, shade, tick, corner]) == {2: "empty"}
    assert why([rule, bar])[1] == "series" and why([curve])[1] == "series" and why([("line", [0.0, 0.0, 30.0, 30.0])])[1] == "series"
    assert why([tick], [("other", [22.0, 22.0, 28.0, 28.0])]) == {2: "empty"}
    assert why([tick, ("other", [22.0, 22.0, 28.0, 28.0])])[1] == "series"


def test_outlines_win(spark):
    outline = toc.outline_entries(spark.createDataFrame([("a", "2.1 Parts", 4, 1), ("a", "Preface", 1, 1), ("a", "2000.1 Year", 5, 3)], "doc string, title string, page int, level int"))
    printed = spark.createDataFrame([("a", "9", "Nine", 9, 1), ("b", "1", "One", 2, 1)], "doc string, number string, title string, page int, level int")
    got = sorted((r.doc, r.number or "", r.title, r.level) for r in toc.contents(outline, printed).collect())
    assert got == [("a", "", "Preface", 1), ("a", "2.1", "Parts", 2), ("a", "2000.1", "Year", 3), ("b", "1", "One", 1)]


MD = "# Title\n\nBody of *it* here\n\n- One item\n2. Two items\n\n| A | B |\n| --- | :-: |\n| 1 |  |\n![x](y)\n> quoted\n---\n## Part  \n"


def test_markdown_is_read_back(spark):
    df = spark.createDataFrame([(1, MD), (2, ""), (3, None), (4, "| a |\n")], "id int, md string")
    got = {r.id: (r.words, r.headings, r.cells) for r in markdown.markdown_parts(df, "id", "md").collect()}
    assert set(got) == {1, 4}
    assert got[1] == ("title body of *it* here one item two items a b 1 part".split(), ["1 title", "2 part"], ["a", "b", "1"])


def test_scores_of_markdown(spark):
    a = spark.createDataFrame([(1, MD), (2, "# A\ntext"), (3, "plain words")], "id int, md string")
    b = spark.createDataFrame([(1, MD), (2, "# B\ntext\n| x |"), (3, "plain")], "id int, md string")
    got = {r.id: (r.text, r.headings, r.tables) for r in markdown.markdown_scores(*(markdown.markdown_parts(d, "id", "md") for d in (a, b)), "id").collect()}
    assert got == {1: (1.0, 1.0, 1.0), 2: (0.4, 0.0, 0.0), 3: (0.667, 1.0, 1.0)}
