from pyspark.sql import functions as F

from quire.operators import blocks, figures, records

L = "doc string, page_number int, block int, line int, text string, bbox array<double>, size double, bold boolean, accent boolean"


def lines(spark, rows, **more):
    """rows: (block, line, text, x0, y0, x1[, size, bold])"""
    out = []
    for b, n, text, x0, y0, x1, *rest in rows:
        size, bold = (*rest, 10.0, False)[:2] if len(rest) < 2 else rest[:2]
        out.append(("d", 1, b, n, text, [float(x0), float(y0), float(x1), y0 + 10.0], float(size), bool(bold), False))
    return spark.createDataFrame(out, L)


def texts(df):
    return [(r.type, r.text) for r in df.orderBy("page_number", "seq").collect()]


def test_wrapped_lines_and_hard_breaks(spark):
    df = lines(spark, [(1, 1, "A full line of text that goes on with", 0, 0, 400), (1, 2, "a short end.", 0, 12, 120), (1, 3, "Next paragraph ends early.", 0, 24, 250), (2, 1, "Another block with a full line that has no", 0, 60, 398), (3, 1, "end and goes on in a block of its own", 0, 73, 395)])
    assert texts(blocks.text_elements(df)) == [("paragraph", "A full line of text that goes on with a short end."), ("paragraph", "Next paragraph ends early."), ("paragraph", "Another block with a full line that has no end and goes on in a block of its own")]


def test_lists(spark):
    df = lines(spark, [(1, 1, "• first item that is long enough to wrap at", 10, 0, 400), (1, 2, "the edge of the page", 10, 12, 180), (1, 3, "• second", 10, 24, 80), (1, 4, "Not of the list", 60, 40, 160), (2, 1, "1) step", 10, 80, 80), (2, 2, "a) sub", 30, 92, 80)])
    got = blocks.text_elements(df).orderBy("seq").collect()
    assert [(r.type, r.marker, r.text) for r in got] == [("list_item", "•", "first item that is long enough to wrap at the edge of the page"), ("list_item", "•", "second"), ("paragraph", None, "Not of the list"), ("list_item", "1)", "step"), ("list_item", "a)", "sub")]


def test_label_rows_and_columns(spark):
    df = lines(spark, [(1, 1, "Label:", 0, 0, 50), (1, 2, "To be", 100, 0, 150), (1, 3, "selected", 100, 12, 160), (1, 4, "Body text at the left edge of the block here", 0, 24, 400)])
    got = blocks.text_elements(df).orderBy("seq").collect()
    assert [(r.text, r.value_x) for r in got] == [("Label: To be selected", 100.0), ("Body text at the left edge of the block here", None)]
    cols = lines(spark, [(1, 1, "right one", 220, 0, 400), (1, 2, "right two", 220, 12, 400), (2, 1, "left one", 0, 0, 190), (2, 2, "left two", 0, 12, 190)])
    assert [t for _, t in texts(blocks.text_elements(cols))][0].startswith("left one")


def test_headings_from_contents_and_sizes(spark):
    rows = [(1, 1, "1 Scope", 0, 0, 80, 14, True), (2, 1, "1.1 Deeper title", 0, 20, 90, 12, False), (3, 1, "Bold label", 0, 40, 90, 12, True), (4, 1, "Plain text of the page that is no title.", 0, 60, 400), (5, 1, "•", 0, 80, 5, 30, True)]
    df = lines(spark, rows)
    body = spark.createDataFrame([("d", 10.0)], "doc string, body_size double")
    toc = spark.createDataFrame([("d", "1", "Scope", 1)], "doc string, number string, title string, level int")
    got = {r.block: (r.level, r.sub_heading) for r in blocks.heading_levels(df, body, toc).collect()}
    assert got == {1: (1, False), 2: (2, False), 3: (None, True)}
    free = {r.block: r.level for r in blocks.heading_levels(df, body, toc.limit(0)).collect()}
    assert free == {1: 1, 3: 2}
    e = blocks.text_elements(df, blocks.heading_levels(df, body, toc)).orderBy("seq").collect()
    assert [(r.type, r.level) for r in e][:3] == [("heading", 1), ("heading", 2), ("heading", None)] and e[3].type == "paragraph"


def test_underlines_and_regions(spark):
    df = lines(spark, [(1, 1, "Under", 10, 0, 60), (2, 1, "Free", 10, 100, 60)])
    rules = spark.createDataFrame([("d", 1, [9.0, 11.0, 62.0, 11.5]), ("d", 1, [9.0, 111.0, 400.0, 111.5])], "doc string, page_number int, bbox array<double>")
    assert {r.text for r in blocks.underlined(df, rules).filter("underlined").collect()} == {"Under"}
    inside = spark.createDataFrame([("d", 1, [0.0, 90.0, 100.0, 120.0])], "doc string, page_number int, bbox array<double>")
    assert [r.text for r in blocks.without_inside(df, inside).collect()] == ["Under"]


D = "doc string, page_number int, drawing_id bigint, kind string, bbox array<double>, fill array<double>, stroked boolean"
B = "doc string, page_number int, bbox array<double>"


def test_regions_say_why(spark):
    rows = [(1, "path", [100, 300, 200, 400], None), (2, "path", [195, 350, 260, 420], None), (3, "rect", [0, 0, 600, 780], None), (4, "path", [400, 300, 402, 302], None), (5, "rect", [300, 500, 500, 560], None), (6, "path", [50, 5, 550, 60], None), (7, "path", [100, 600, 300, 700], None), (8, "path", [400, 200, 500, 290], [1.0, 1.0, 1.0]), (9, "path", [520, 200, 600, 280], None)]
    drawings = spark.createDataFrame([("d", 1, i, k, list(map(float, b)), f, False) for i, k, b, f in rows], D)
    tables = spark.createDataFrame([("d", 1, [90.0, 590.0, 310.0, 710.0])], B)
    text = spark.createDataFrame([("d", 1, [310.0, 510.0, 400.0, 520.0])], B)
    again = spark.createDataFrame([("d", [521.0, 201.0, 600.0, 280.0])], "doc string, bbox array<double>")
    got = {r.region: (r.reason, r.drawings, list(r.bbox)) for r in figures.regions(drawings, tables, text, again, 612.0, 792.0).collect()}
    assert got[1] == (None, 2, [90.0, 290.0, 270.0, 430.0])
    assert {k: v[0] for k, v in got.items() if k != 1} == {3: "frame_drawing", 4: "tiny", 5: "text_box", 6: "furniture_band", 7: "table_overlap", 8: "invisible_drawing", 9: "repeated_drawing"}


def test_labels_panels_captions(spark):
    fig = spark.createDataFrame([("d", 1, 1, [100.0, 100.0, 200.0, 200.0]), ("d", 1, 2, [300.0, 100.0, 400.0, 200.0])], "doc string, page_number int, region bigint, bbox array<double>")
    lab = spark.createDataFrame([("d", 1, 1, "x axis", [120.0, 203.0, 160.0, 212.0]), ("d", 1, 2, "A long sentence beside it", [205.0, 120.0, 290.0, 130.0]), ("d", 1, 3, "far", [100.0, 300.0, 120.0, 310.0]), ("d", 1, 4, "Figure 3:", [100.0, 400.0, 150.0, 410.0]), ("d", 1, 5, "The pump", [155.0, 401.0, 220.0, 411.0]), ("d", 1, 6, "Elsewhere", [400.0, 400.0, 450.0, 410.0])], "doc string, page_number int, line_id bigint, text string, bbox array<double>")
    got = {r.region: list(r.bbox) for r in figures.absorb_labels(fig, lab).collect()}
    assert got == {1: [100.0, 100.0, 200.0, 212.0], 2: [300.0, 100.0, 400.0, 200.0]}
    assert [(r.line_id, r.title_id, r.text) for r in figures.split_captions(lab).collect()] == [(4, 5, "Figure 3: The pump")]
    bits = spark.createDataFrame([("d", 1, i, [float(x), 10.0, x + 5.0, 20.0]) for i, x in enumerate((10, 20, 90))], "doc string, page_number int, bitmap_id bigint, bbox array<double>")
    pans = spark.createDataFrame([("d", 1, 7, [5.0, 5.0, 50.0, 50.0]), ("d", 1, 8, [0.0, 0.0, 100.0, 100.0]), ("d", 1, 9, [0.0, 0.0, 600.0, 700.0])], "doc string, page_number int, drawing_id bigint, bbox array<double>")
    assert [(r.panel, r.bitmaps) for r in figures.bitmap_panels(bits, pans, 612.0 * 792.0).collect()] == [(7, 2)]


def test_frames_and_limits(spark):
    frame = [20.0, 60.0, 590.0, 740.0]
    text = spark.createDataFrame([("d", p, b) for p in range(1, 5) for b in ([100.0, 100.0, 200.0, 110.0], [100.0, 20.0, 200.0, 30.0])], B)
    frames = spark.createDataFrame([("d", frame, 4), ("d", [0.0, 0.0, 612.0, 792.0], 4), ("d", [0.0, 0.0, 50.0, 50.0], 4)], "doc string, bbox array<double>, pages bigint")
    pages = spark.createDataFrame([("d", 4)], "doc string, page_count bigint")
    assert [list(r.bbox) for r in figures.content_rects(frames, text, pages, 612.0 * 792.0).collect()] == [frame]
    parts = spark.createDataFrame([("d", [20.0, 20.0, 300.0, 60.0]), ("d", [300.0, 30.0, 590.0, 110.0]), ("d", [20.0, 300.0, 40.0, 320.0]), ("e", [0.0, 0.0, 30.0, 30.0])], "doc string, bbox array<double>")
    got = {r.doc: (r.top, r.bottom) for r in figures.header_limits(parts, 612.0, 792.0).collect()}
    assert got["d"] == (110.0, None) and got["e"] == (None, None)
    limits = figures.band_limits(F.lit(800.0), F.lit(None).cast("array<double>"), F.lit(110.0), F.lit(None).cast("double"))
    assert tuple(spark.range(1).select(*limits).first()) == (110.0, 704.0)


def test_outside_records(spark):
    e = "type string, text string, level int, marker string, rows array<array<string>>, asset string"
    rows = [("heading", "a", 2, None, None, None), ("heading", "a", 7, None, None, None), ("heading", None, 1, None, None, None), ("odd", None, None, None, None, None), (None,) * 6, ("table", None, None, None, [], None), ("list_item", "x", 1, "-", None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, e).select(records.element_error()).collect()]
    assert got == [None, "heading level out of range", "heading without text", "unknown type: odd", "unknown type: none", "table without rows", None]
    src = ["flowchart TD\nA-->B", "---\ntitle: x\n---\n%% note\n\n  pie title y", "graphic x", "", None, "stateDiagram-v2"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in src], "s string").select(records.diagram_error(F.col("s"))).collect()]
    assert got[0] is None and got[1] is None and got[5] is None and all(got[2:5])
    images = spark.createDataFrame([("d", 1, "a", None, None), ("d", 1, "b", "Cap", "read"), ("d", 1, "c", None, None)], "doc string, page_number int, asset string, caption string, figure_text string")
    notes = spark.createDataFrame([("d", 1, "a", "A pump", "label", False), ("d", 1, "b", "B", "other", True), ("d", 1, "c", "C", None, True), ("d", 1, "c", "", None, False)], "doc string, page_number int, asset string, description string, figure_text string, no_visible_text boolean")
    got = {r.asset: (r.figure_text, r.description, r.no_visible_text, r.refused) for r in records.describe(images, notes).collect()}
    assert got == {"a": ("label", "A pump", False, None), "b": ("read", "B", False, "figure_text is there; image has text"), "c": (None, "C", True, None)}


def test_batches(spark):
    df = spark.createDataFrame([("d", i, e) for i, e in enumerate([3, 3, 3, 20, 1, 1, 1, 1], 1)], "doc string, page_number int, effort int")
    got = [(r.batch, r.oversize) for r in records.batches(df, 6, 3).orderBy("page_number").collect()]
    assert got == [(0, False), (0, False), (1, False), (2, True), (3, False), (3, False), (3, False), (4, False)]
