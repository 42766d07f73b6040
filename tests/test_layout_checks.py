import random

from pyspark.sql import functions as F

from quire.functions import glyphs, text
from quire.operators import furniture, gates, grades, layout, toc

E = "element_id bigint, doc string, page_number int, seq int, type string, text string, level int, rows array<array<string>>, bbox array<double>, caption string, figure_text string, asset string, tier string"


def el(spark, rows):
    """rows of dicts"""
    names = [c.split()[0] for c in E.split(", ")]
    return spark.createDataFrame([tuple({"element_id": i, "doc": "d", "page_number": 1, "seq": i, "type": "paragraph"} .get(n) if n not in r else r[n] for n in names) for i, r in enumerate(rows, 1)], E)


CONTENTS = {
    "leaders": (["1 Introduction ..... 4", "2", "Scope .... 5"], None, None, [("1", "Introduction", 4), ("2", "Scope", 5)], []),
    "wrapped": (["3 A title that", "goes on and", "ends ... 9"], None, None, [("3", "A title that goes on and ends", 9)], []),
    "wrapped bare": (["3", "A title", "goes on", "and on", "ends ... 9"], None, None, [("3", "A title goes on and on ends", 9)], []),
    "wrapped too far": (["3 One", "a", "b", "c", "d", "e .. 9"], None, None, [], ["3 One", "e .. 9"]),
    "next entry closes nothing": (["3 One", "4 Two .. 9"], None, None, [("4", "Two", 9)], ["3 One"]),
    "last numbers": (["8 TITLE 58", "9 OTHER 40", "10 MORE 58", "11 Part ... 3", "12 LOW 2", "13 HIGH 7", "14 LOW 6"], None, None, [("8", "TITLE", 58), ("10", "MORE", 58), ("11", "Part", 3), ("13", "HIGH", 7)], ["9 OTHER 40", "12 LOW 2", "14 LOW 6"]),
    "pages end": (["8 TITLE 58"], None, 20, [], ["8 TITLE 58"]),
    "lone page": (["5", "TITLE", "53"], [10.0, 11.0, 30.0], None, [("5", "TITLE", 53)], []),
    "lone page of a titled line": (["5 TITLE", "53", "6 NEXT .. 60"], [10.0, 20.0, 30.0], None, [("5", "TITLE", 53), ("6", "NEXT", 60)], []),
    "lone page opens nothing": (["5 TITLE", "53", "Scope .... 5"], [10.0, 20.0, 30.0], None, [("5", "TITLE", 53)], ["Scope .... 5"]),
    "page not alone": (["5", "TITLE", "53"], [10.0, 11.0, 11.0], None, [], ["5", "53"]),
    "beside": (["8", "TITLE 58"], [10.0, 11.0], None, [("8", "TITLE", 58)], []),
    "beside, heights unknown": (["8", "TITLE 58"], None, None, [], []),
    "loose": (["Loose end ..... 7", "4.1 Numbered", "2 ( 1 2 )", "", "1234 Document"], None, None, [], ["Loose end ..... 7", "4.1 Numbered"]),
    "trailing dots": (["2. Scope .... 5", "2.1. More .... 6"], None, None, [("2.", "Scope", 5), ("2.1.", "More", 6)], []),
    "nothing": ([], None, None, [], []),
    "numbers beyond any page": (["1 A ..... 99999999999", "2 B 99999999999"], None, None, [], ["1 A ..... 99999999999", "2 B 99999999999"]),
}


def test_contents_lines(spark):
    rows = [(doc, 1, i, x, ys[i] if ys else None, count) for doc, (lines, ys, count, _, _) in CONTENTS.items() for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc string, page_number int, line_no int, line string, y double, page_count int")
    got = toc.parse_toc(df).collect()
    for doc, (_, _, _, entries, unparsed) in CONTENTS.items():
        mine = [r for r in got if r.doc == doc]
        assert sorted((r.number, r.title, r.page) for r in mine if r.number) == sorted(entries), doc
        assert sorted(r.unparsed for r in mine if r.unparsed) == sorted(unparsed), doc
    assert {r.level for r in got if r.doc == "trailing dots"} == {1, 2}


def test_contents_pages_go_on(spark):
    """The page before counts on the next page; nothing else does."""
    rows = [("d", 1, 0, "1 FIRST 9"), ("d", 1, 1, "2 Open"), ("d", 2, 0, "ends ... 12"), ("d", 2, 1, "3 BACK 8"), ("d", 2, 2, "4 ON 9"), ("d", 30, 0, "5 Far ... 9"), ("e", 1, 0, "3 BACK 8"), (None, 1, 0, "1 A ... 2")]
    df = spark.createDataFrame(rows, "doc string, page_number int, line_no int, line string").withColumn("y", F.lit(None).cast("double"))
    got = [(r.doc, r.number, r.page, r.unparsed) for r in toc.parse_toc(df).collect()]
    assert sorted(got, key=str) == sorted([("d", "1", 9, None), ("d", None, None, "2 Open"), ("d", None, None, "ends ... 12"), ("d", None, None, "3 BACK 8"), ("d", "4", 9, None), ("e", "3", 8, None), (None, "1", 2, None)], key=str)
    assert toc.parse_toc(df.limit(0)).collect() == []


def test_contents_pages(spark):
    lead = [f"{i} Part ..... {i}" for i in range(1, 16)]
    pages = {1: ["Cover"], 2: lead, 3: lead[:3] + ["note"] * 3, 4: ["text"] * 9, 5: lead, 30: lead}
    lines = [("d", p, i, x) for p, xs in pages.items() for i, x in enumerate(xs)] + [("e", 1, 0, "no"), ("f", 25, 0, "1 x .... 2")]
    df = spark.createDataFrame(lines, "doc string, page_number int, line_no int, line string")
    assert sorted((r.doc, r.page_number) for r in toc.toc_pages(df).collect()) == [("d", 2), ("d", 3)]
    got = toc.parse_toc(df.filter("page_number in (2, 3)").withColumn("y", F.lit(None).cast("double"))).collect()
    assert len([r for r in got if r.number]) == 18 and {r.level for r in got if r.number} == {1}


def test_closest_heading_is_taken_once(spark):
    entries = spark.createDataFrame([(1, "d", "1", "A", 5, 1), (2, "d", "1", "A", 2, 1), (3, "d", None, "Lone", 3, 2), (4, "d", "9", "Gone", 1, 1), (5, None, "1", "A", 1, 1)], "entry_id bigint, doc string, number string, title string, page int, level int")
    heads = spark.createDataFrame([(11, "d", "1 a:", 2, 1), (12, "d", "1  A", 9, 1), (13, "d", "LONE", 3, 1)], "element_id bigint, doc string, text string, page_number int, level int")
    got = {r.entry_id: (r.element_id, r.state) for r in toc.match_headings(entries, heads).collect()}
    assert got == {1: (11, "page"), 2: (12, "page"), 3: (13, "level"), 4: (None, "missing")}


def test_headings_are_taken_in_turn_like_by_hand(spark):
    rnd = random.Random(7)
    entries = [(i, "d", None, rnd.choice("abc"), rnd.choice([None, *range(1, 9)]), 1) for i in range(40)]
    heads = [(100 + i, "d", rnd.choice("abc"), rnd.randrange(1, 9), 1) for i in range(40)]
    got = toc.match_headings(spark.createDataFrame(entries, "entry_id bigint, doc string, number string, title string, page int, level int"), spark.createDataFrame(heads, "element_id bigint, doc string, text string, page_number int, level int"))
    want, free = {}, sorted(heads, key=lambda h: (h[3], h[0]))
    for e in entries:
        best = min((h for h in free if h[2] == e[3]), key=lambda h: abs(h[3] - (e[4] or 0)), default=None)
        want[e[0]] = best and best[0]
        if best:
            free.remove(best)
    assert {r.entry_id: r.element_id for r in got.collect()} == want


def test_running_lines_and_strip(spark):
    rows = []
    for p in range(1, 11):
        rows += [{"page_number": p, "seq": 1, "text": f"Doc 7{p} page {p} ", "bbox": [0.0, 10.0, 9.0, 20.0]}, {"page_number": p, "seq": 2, "text": f"body {p}" if p % 2 else "Doc 1 page 2\nrest", "bbox": [0.0, 300.0, 9.0, 320.0]}]
    df = el(spark, rows)
    lines = furniture.text_lines(df)
    got = furniture.repeated_lines(lines, F.lit(792.0)).collect()
    assert [(r.key, r.edge, r.pages, r.y_min, r.y_max) for r in got] == [("Doc#page#", "top", 10, 10.0, 20.0)]
    stripped = {r.element_id: (r.text, r.removed) for r in furniture.strip_lines(df, spark.createDataFrame([("d", "Doc#page#")], "doc string, key string")).collect()}
    assert stripped[1] == ("", 1) and stripped[2] == ("body 1", 0) and stripped[4] == ("rest", 1)


def test_box_groups_and_components(spark):
    rows = [{"page_number": p, "type": "image", "bbox": [10.0 + p * 0.4, 10.0, 50.0, 20.0]} for p in range(1, 5)] + [{"page_number": 1, "type": "image", "bbox": [300.0, 300.0, 320.0, 310.0]}, {"page_number": 1, "type": "image", "bbox": [330.0, 300.0, 340.0, 310.0]}, {"page_number": 1, "type": "image", "bbox": None}]
    df = el(spark, rows)
    got = furniture.box_groups(df.withColumn("kind", F.lit("bitmap"))).collect()
    assert [(r.pages, r.x0) for r in got] == [(4, 11.0)]
    comp = {r.element_id: (r.component, r.x0, r.x1) for r in layout.box_components(df).collect()}
    assert comp[5] == comp[6] == (5, 300.0, 340.0) and comp[1][0] == 1


def test_indent_levels_are_the_nearest_cluster(spark):
    rnd = random.Random(2)
    rows = [("d", float(rnd.choice([10, 11, 12.9, 13.2, 30, 32, 50]))) for _ in range(50)] + [("e", None)]
    got = {r.x: r.level for r in layout.x_levels(spark.createDataFrame(rows, "doc string, x double")).collect()}
    assert got == {10.0: 1, 11.0: 1, 12.9: 2, 13.2: 2, 30.0: 3, 32.0: 3, 50.0: 4}


def test_coverage_lends_between_neighbours(spark):
    src = [("d", 1, "alpha", 4), ("d", 1, "beta", 2), ("d", 2, "gamma", 5), ("d", 5, "delta", 2)]
    out = [("d", 1, "alpha", 1), ("d", 2, "alpha", 1), ("d", 2, "gamma", 5)]
    s = "doc string, page_number int, word string, n bigint"
    got = gates.coverage(spark.createDataFrame(src, s), spark.createDataFrame(out, s)).collect()
    assert [(r.page_number, r.missing, r.total) for r in got] == [(1, 4, 6)]


def test_captions_and_figures(spark):
    rows = [{"type": "image", "page_number": 2, "caption": "Figure  3: Pump"}, {"page_number": 1, "text": "figure 3: pump"}, {"page_number": 3, "text": "Figure 3: Pump"}, {"type": "image", "caption": "Table 2 Sizes"}, {"type": "image", "caption": " ", "figure_text": None}, {"text": "Fig. 9"}, {"text": "Figures 9"}]
    df = el(spark, rows)
    assert sorted(r.element_id for r in gates.orphan_captions(df).collect()) == [3, 6]
    assert [r.element_id for r in gates.tables_as_figures(df).collect()] == [4]
    assert [r.element_id for r in gates.incomplete_figures(df).collect()] == [5]


def test_number_levels_and_tables(spark):
    df = el(spark, [{"type": "heading", "text": "1.2 A", "level": 2}, {"type": "heading", "text": "1.2.3. B", "level": 2}, {"type": "heading", "text": "2024 Plan", "level": 1}, {"type": "heading", "text": "1 C", "level": None}, {"type": "table", "rows": [["a" * 150, ""], ["", ""], [None]]}, {"type": "table", "rows": []}])
    assert sorted(r.element_id for r in gates.number_levels(df).collect()) == [2, 4]
    assert [(r.element_id, r.widest, r.narrowest) for r in gates.ragged_tables(df).collect()] == [(5, 2, 1)]
    assert [r.element_id for r in gates.layout_tables(df).collect()] == [5]


def test_sequence_ratio(spark):
    df = spark.createDataFrame([(1, "a b c d", "a b x d"), (2, None, None), (3, "", "q")], "k int, a string, b string")
    assert {r.k: r.ratio for r in grades.sequence_ratio(df, "k", "a", "b").collect()} == {1: 0.75, 2: 1.0, 3: 0.0}


def test_paragraphs_from_words(spark):
    words = [("d", 1, 1, 1, 1, 1, "ten-", 90.0), ("d", 1, 1, 1, 2, 1, "fold", 70.0), ("d", 1, 1, 1, 2, 2, "rise", -1.0), ("d", 1, 1, 2, 1, 1, "x", -1.0), ("d", 1, 1, 2, 1, 2, " ", 50.0)]
    df = layout.paragraphs(spark.createDataFrame(words, "doc string, page_number int, block int, par int, line int, word_no int, text string, conf double"))
    assert sorted((r.text, r.confidence) for r in df.collect()) == [("ten-fold rise", 0.8), ("x", None)]


def test_text_functions(spark):
    rows = [("1.2 Über Grüße –",), ("",), (None,), ("3D view",), ("2024 Plan",), ("a-",)]
    df = spark.createDataFrame(rows, "t string")
    t = F.col("t")
    got = df.select(text.heading_key(t), text.heading_slug(t), text.section_number(t), text.furniture_key(t)).collect()
    assert tuple(got[0]) == ("1.2 über grüsse", "1-2", "1.2", "#.#ÜberGrüße–")
    assert tuple(got[1]) == ("", "section", None, "") and got[2][3] is None and got[3][1] == "3" and got[4][2] is None
    joined = spark.range(1).select(text.join_texts(F.array(F.lit("ab-"), F.lit("cd"), F.lit(""), F.lit("–"), F.lit("e"))).alias("x")).first().x
    assert joined == "ab-cd – e"
    fixed = spark.createDataFrame([("oﬃce naƟon Ɵ SoŌware",), ("abௗc",), ("q",)], "t string").select(glyphs.repair(t).alias("x"), glyphs.decode_symbol(F.lit("b")).alias("s")).collect()
    assert [r.x for r in fixed] == ["office nation Ɵ Software", "ab c", "q"] and fixed[0].s == "αβ"


def test_box_groups_against_one_group_a_document(spark):
    rnd = random.Random(3)
    rows = [{"element_id": i, "page_number": rnd.randrange(1, 12), "seq": i, "type": "image", "bbox": [x, y, x + 50, y + 20]} for i in range(300) for x, y in [(rnd.choice([10.0, 200.0]) + rnd.randrange(0, 12) * 0.7, rnd.choice([5.0, 400.0]) + rnd.randrange(0, 4))]]
    got = furniture.box_groups(el(spark, rows).withColumn("kind", F.lit(None).cast("string")), 1, 0.0).collect()
    firsts, members = [], []
    for page, *box in sorted({(r["page_number"], *r["bbox"]) for r in rows}):
        hit = next((k for k, f in enumerate(firsts) if all(abs(a - b) <= furniture.GROUP_TOLERANCE for a, b in zip(f, box))), len(firsts))
        if hit == len(firsts):
            firsts.append(box)
            members.append([])
        members[hit].append((page, *box))
    want = sorted((*(round(sum(m[k] for m in ms) / len(ms), 2) for k in range(1, 5)), len({m[0] for m in ms})) for ms in members)
    assert len(want) > 5
    assert all(abs(a - b) < 0.02 for g, w in zip(sorted((r.x0, r.y0, r.x1, r.y1, r.pages) for r in got), want, strict=True) for a, b in zip(g, w))


def test_joined_boxes_against_all_pairs():
    rnd = random.Random(11)
    for n in (0, 1, 2, 30, 80):
        boxes = [(x, y, x + rnd.randrange(1, 30), y + rnd.randrange(1, 30)) for x, y in ((rnd.randrange(300), rnd.randrange(300)) for _ in range(n))]
        got = layout.joined(boxes, 5)
        want = list(range(n))
        for _ in range(n):
            for i, a in enumerate(boxes):
                for j, b in enumerate(boxes):
                    if max(a[0], b[0]) - min(a[2], b[2]) <= 5 and max(a[1], b[1]) - min(a[3], b[3]) <= 5:
                        want[i] = want[j] = min(want[i], want[j])
        assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(n) for j in range(n))
