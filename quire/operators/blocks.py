"""Lines of a text layer as elements: headings, list items, label rows and paragraphs.

``lines`` has ``doc``, ``page_number``, ``block``, ``line``, ``text``, ``bbox``, ``size``, ``bold`` and
``accent``. A break before a line is a condition on it and the line before; a running count of breaks
numbers the elements of a page, and an aggregation puts each together. All windows are on one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions.text import heading_key, join_texts, list_marker, number_depth, section_number

X_TOLERANCE, Y_TOLERANCE = 3.0, 3.0
SLACK, WORD_FACTOR, SHORT, GAP, FILL = 2.0, 1.5, 0.4, 0.5, 0.6
LARGE, MIN_CHARS, LEVELS, ACCENT_WORDS, HEADING_WORDS = 1.5, 3, 6, 10, 12
#: A rule at most this thick, and from mid-line to this far below, underlines; it is little wider.
RULE, RULE_GAP, RULE_WIDTH = 1.5, 3.0, 1.5


def ends_sentence(text: Column) -> Column:
    """Whether a line ends a sentence, closing brackets and quotes aside."""
    return text.rlike(r"[.!?:][)\]\"'”’]*\s*$")


def heading_shaped(text: Column) -> Column:
    """Short, no sentence, and with letters or digits enough to be a title."""
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    return (words > 0) & (words <= HEADING_WORDS) & ~ends_sentence(text) & (F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) >= MIN_CHARS)


def underlined(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``underlined``: a thin drawing (``doc``, ``page_number``, ``bbox``) runs right below the line."""
    key = [c for c in ("doc", "page_number", "block", "line") if c in lines.columns]
    r, b = F.col("_r"), F.col("bbox")
    thin = rules.select("doc", "page_number", F.col("bbox").alias("_r")).filter((g.y1(F.col("_r")) - g.y0(F.col("_r"))).between(0, RULE))
    below = (g.y0(r) > (g.y0(b) + g.y1(b)) / 2) & (g.y0(r) <= g.y1(b) + RULE_GAP)
    spans = (g.x0(r) <= g.x0(b) + 1) & (g.x1(r) >= g.x1(b) - 1) & (g.x1(r) - g.x0(r) <= RULE_WIDTH * (g.x1(b) - g.x0(b)))
    hit = lines.join(thin, ["doc", "page_number"]).filter(below & spans).select(*key).distinct().withColumn("underlined", F.lit(True))
    return lines.join(hit, key, "left").withColumn("underlined", F.coalesce("underlined", F.lit(False)))


def without_inside(lines: DataFrame, regions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Lines that are not mostly inside one of the regions (``doc``, ``page_number``, ``bbox``) of their page."""
    r = regions.select("doc", "page_number", F.col("bbox").alias("_r"))
    covered = lines.join(r, ["doc", "page_number"]).filter(g.overlap_ratio(F.col("bbox"), F.col("_r")) > threshold)
    key = ["doc", "page_number", "block", "line"]
    return lines.join(covered.select(*key).distinct(), key, "left_anti")


def heading_levels(lines: DataFrame, body: DataFrame, contents: DataFrame) -> DataFrame:
    """Blocks that are headings: ``doc``, ``page_number``, ``block``, ``level``, ``sub_heading``.

    ``body`` has ``doc`` and ``body_size``; ``contents`` has ``doc``, ``number``, ``title`` and ``level``.
    A document with contents takes its headings from there, also those numbered deeper below a listed
    number, and bold lines that stand out as sub-headings without a level. One without ranks the
    sizes of bold or large blocks; an accented line comes one level below the smallest.
    """
    listed = contents.withColumn("_key", heading_key(F.when(F.col("number").isNull(), F.col("title")).otherwise(F.concat("number", F.lit(" "), "title"))))
    toc = listed.groupBy("doc", "_key").agg(F.max("level").alias("_toc"))
    deepest = listed.groupBy("doc").agg(F.max("level").alias("_deep"), F.collect_set(F.rtrim("number", F.lit("."))).alias("_numbers"))
    order = F.array_sort(F.collect_list(F.struct("line", "text")))
    blocks = lines.groupBy("doc", "page_number", "block").agg(join_texts(F.transform(order, lambda x: x["text"])).alias("text"), F.max("size").alias("size"), F.bool_and("bold").alias("bold"), F.bool_and("accent").alias("accent"), F.bool_and("underlined").alias("underlined") if "underlined" in lines.columns else F.lit(False).alias("underlined"), F.count(F.lit(1)).alias("n"))
    df = blocks.withColumn("_key", heading_key(F.col("text"))).join(body, "doc").join(toc, ["doc", "_key"], "left").join(deepest, "doc", "left")
    one, shaped = F.col("n") == 1, heading_shaped(F.col("text"))
    number = section_number(F.col("text"))
    parts = F.split(F.rtrim(number, F.lit(".")), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    deep = one & number.isNotNull() & shaped & (F.col("size") >= F.col("body_size")) & (number_depth(number) > F.col("_deep")) & F.arrays_overlap(parents, "_numbers")
    sub = one & F.col("bold") & shaped & ((F.col("size") > F.col("body_size")) | F.col("underlined"))
    solid = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")) >= MIN_CHARS
    free = F.col("_deep").isNull()
    ranked = free & (F.col("bold") | (F.col("size") >= LARGE * F.col("body_size"))) & (F.col("size") > F.col("body_size")) & solid
    df = df.withColumn("_ranked", F.coalesce(ranked, F.lit(False)))
    sizes = df.filter("_ranked").select("doc", "size").distinct()
    ranks = sizes.withColumn("_rank", F.least(F.dense_rank().over(Window.partitionBy("doc").orderBy(F.col("size").desc())), F.lit(LEVELS)))
    lowest = ranks.groupBy("doc").agg(F.max("_rank").alias("_lowest"))
    df = df.join(ranks, ["doc", "size"], "left").join(lowest, "doc", "left")
    accented = free & one & F.col("accent") & (F.col("size") >= F.col("body_size")) & solid & (F.size(F.split(F.trim("text"), r"\s+")) <= ACCENT_WORDS) & ~ends_sentence(F.col("text"))
    level = F.coalesce("_toc", F.when(deep, F.least(number_depth(number), F.lit(LEVELS))), F.when(F.col("_ranked"), F.col("_rank")), F.when(accented, F.least(F.coalesce("_lowest", F.lit(0)) + 1, F.lit(LEVELS))))
    out = df.select("doc", "page_number", "block", level.cast("int").alias("level"), (level.isNull() & ~free & sub).alias("sub_heading"))
    return out.filter("level is not null or sub_heading")


def text_elements(lines: DataFrame, headings: DataFrame | None = None) -> DataFrame:
    """Elements of each page: ``doc``, ``page_number``, ``seq``, ``type``, ``level``, ``sub_heading``, ``marker``, ``text``, ``bbox``, ``value_x``.

    List items have no level yet: it is the rank of ``bbox[0]`` among the document's markers
    (:func:`quire.operators.layout.x_levels`). ``value_x`` is where the value of a label row begins.
    """
    known = headings.withColumn("_heading", F.lit(True)) if headings is not None else None
    df = lines.join(known, ["doc", "page_number", "block"], "left") if known is not None else lines.withColumns({"level": F.lit(None).cast("int"), "sub_heading": F.lit(False), "_heading": F.lit(None).cast("boolean")})
    df = columns_first(df)
    b = F.col("bbox")
    df = df.withColumns({"x0": g.x0(b), "y0": g.y0(b), "x1": g.x1(b), "y1": g.y1(b)})
    page = Window.partitionBy("doc", "page_number")
    block = Window.partitionBy("doc", "page_number", "block")
    order = page.orderBy("_column", "block", "line")
    marker, rest = list_marker(F.col("text"))
    df = df.withColumns({"_right": F.max("x1").over(page), "_bl": F.min("x0").over(block), "_br": F.max("x1").over(block), "_marker": marker, "_rest": rest})
    old = {n: F.lag(n).over(order) for n in ("block", "text", "bold", "x0", "y0", "x1", "y1", "_heading")}
    df = df.withColumns({f"_p_{n}": c for n, c in old.items()})
    p = lambda n: F.col(f"_p_{n}")
    first_word = F.length(F.regexp_extract("text", r"^\s*(\S*)", 1)) + 1
    word = first_word * (F.col("x1") - F.col("x0")) / F.greatest(F.length("text"), F.lit(1))
    fits = F.col("_right") - p("x1") > WORD_FACTOR * word + SLACK
    ended = ends_sentence(p("text"))
    short = F.col("_br") - p("x1") > SHORT * F.greatest(F.col("_br") - F.col("_bl"), F.lit(1.0))
    hard = (F.col("bold") != p("bold")) | (F.col("_marker").isNotNull() & (ended | fits)) | (fits & (ended | short))
    same = F.col("block") == p("block")
    beside = same & (F.abs(F.col("y0") - p("y0")) <= Y_TOLERANCE) & ((p("x1") <= F.col("x0")) | (F.col("x1") <= p("x0")))
    goes_on = ~same & (F.abs(F.col("x0") - p("x0")) <= X_TOLERANCE) & ~ended & (p("x1") - p("x0") >= FILL * (F.col("_right") - p("x0"))) & (F.col("y0") >= p("y1")) & (F.col("y0") - p("y1") <= GAP * (p("y1") - p("y0"))) & ~fits & ~hard
    # In a block with markers, lines at the last marker's x belong to its item; the first one that is not ends it.
    so_far = block.orderBy("line")
    df = df.withColumn("_at", F.last(F.when(F.col("_marker").isNotNull(), F.col("x0")), ignorenulls=True).over(so_far))
    off = F.abs(F.col("x0") - F.col("_at")) > X_TOLERANCE
    df = df.withColumns({"_off": F.coalesce(off, F.lit(False)), "_beside": F.coalesce(beside, F.lit(False))})
    left_item = same & F.col("_off") & ~F.coalesce(F.lag("_off").over(order), F.lit(False))
    lead_beside = F.coalesce(F.lead("_beside").over(order), F.lit(False))
    row_tail = same & F.coalesce(F.lag("_beside").over(order), F.lit(False)) & (F.col("x0") > F.col("_bl") + X_TOLERANCE)
    in_heading = F.col("_heading") & p("_heading") & same
    breaks = (
        F.when(p("block").isNull(), True).when(F.coalesce(in_heading, F.lit(False)), False).when(F.coalesce(F.col("_heading"), F.lit(False)) | F.coalesce(p("_heading"), F.lit(False)), True)
        .when(F.col("_beside") | row_tail, False).when(same & (lead_beside | F.coalesce(F.lag("_beside").over(order), F.lit(False))), True)
        .when(same, (F.col("_marker").isNotNull() & (F.col("_at").isNotNull())) | left_item | hard).otherwise(~goes_on)
    )
    df = df.withColumn("seq", F.sum(F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0)).over(order))
    place = F.struct("_column", "block", "line")
    head = F.min_by(F.struct("_marker", "_heading", "level", "sub_heading"), place)
    texts = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.coalesce("_rest", "text").alias("t"), F.col("text").alias("whole")))), lambda x: x)
    out = df.groupBy("doc", "page_number", "seq").agg(head.alias("h"), texts.alias("t"), F.array(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).alias("bbox"), F.min_by("x0", F.when(F.col("_beside"), place)).alias("value_x"))
    heading = F.coalesce(F.col("h._heading"), F.lit(False))
    item = ~heading & F.col("h._marker").isNotNull()
    parts = F.transform("t", lambda x, i: F.when(item & (i == 0), x["t"]).otherwise(x["whole"]))
    kind = F.when(heading, "heading").when(item, "list_item").otherwise("paragraph")
    return out.select("doc", "page_number", F.col("seq").cast("int").alias("seq"), kind.alias("type"), F.col("h.level").alias("level"), F.coalesce("h.sub_heading", F.lit(False)).alias("sub_heading"), F.when(item, F.col("h._marker")).alias("marker"), join_texts(parts).alias("text"), "bbox", F.when(kind == "paragraph", F.col("value_x")).alias("value_x"))


def columns_first(lines: DataFrame) -> DataFrame:
    """Add ``_column``: the reading place of each block's start, so that of two blocks of several lines that start side by side the left comes first."""
    b = F.col("bbox")
    blocks = lines.groupBy("doc", "page_number", "block").agg(F.min(g.x0(b)).alias("bx0"), F.min(g.y0(b)).alias("by0"), F.max(g.x1(b)).alias("bx1"), F.count(F.lit(1)).alias("bn"))
    a = blocks.filter("bn > 1")
    o = a.select("doc", "page_number", F.col("block").alias("o_block"), F.col("bx0").alias("ox0"), F.col("by0").alias("oy0"))
    beside = a.join(o, ["doc", "page_number"]).filter((F.col("block") > F.col("o_block")) & (F.abs(F.col("by0") - F.col("oy0")) <= Y_TOLERANCE) & (F.col("ox0") > F.col("bx1")))
    moved = beside.groupBy("doc", "page_number", "block").agg(F.min("o_block").alias("_to"))
    return lines.join(moved, ["doc", "page_number", "block"], "left").withColumn("_column", F.coalesce(F.col("_to") - 0.5, F.col("block").cast("double"))).drop("_to")
