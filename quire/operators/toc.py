"""Printed tables of contents: their pages, entries, and headings that answer them."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import LEADER_END, LEADER_LINE, WS, heading_key, number_depth, split_number
from quire.session import shipped

# How much of a page its leaders must be, how far contents are searched, how many lines a
# title wraps over, how near two lines of one height lie, and the shapes of lines.
MIN_LEADERS, SEARCH_PAGES, MIN_CONTINUED, MIN_SHARE = 15, 20, 3, 0.3
WRAP_LINES, SAME_Y, PAGE_TOLERANCE = 3, 3.0, 1
BARE = r"^(\d+(?:\.\d+)*\.?)$"
NUMBERED = r"^(\d+(?:\.\d+)*\.?)\s+(.+)$"
SECTION = r"^\d{1,3}(?:\.\d{1,3})*\.?$"
TRAILING = r"^(.*\S)\s+(\d+)$"
DIGITS = r"^\d+$"
LETTER = r"\p{L}"


def leader_entries(lines: DataFrame) -> DataFrame:
    """Entries printed on one line with a leader: adds ``number``, ``title``, ``page``, ``level``; others go."""
    left = F.regexp_extract("line", LEADER_LINE, 1)
    number, title = split_number(left)
    page = F.regexp_extract("line", LEADER_LINE, 2).try_cast("int")
    df = lines.filter(F.col("line").rlike(LEADER_END))
    return df.withColumns({"number": number, "title": title, "page": page, "level": number_depth(number)})


def toc_pages(lines: DataFrame, min_leaders: int = MIN_LEADERS) -> DataFrame:
    """Pages of the printed contents: the first unbroken run among the first pages of a document.

    ``lines`` has ``doc``, ``page_number`` and ``line``. The run starts at a page with enough leader
    lines and goes on over pages with enough, or with a few that make up a share of their lines. ``min_leaders`` is for
    pages that are shorter than printed ones.
    """
    stripped = F.trim("line")
    filled = lines.filter((F.col("page_number") <= SEARCH_PAGES) & (stripped != ""))
    bare = stripped.rlike(BARE)
    pages = filled.groupBy("doc", "page_number").agg(F.count_if(stripped.rlike(LEADER_END)).alias("leaders"), F.count_if(bare).alias("bare"), F.count(F.lit(1)).alias("n"))
    full = F.col("leaders") >= min_leaders
    more = full | ((F.col("leaders") >= MIN_CONTINUED) & ((F.col("leaders") + F.col("bare")) / F.col("n") >= MIN_SHARE))
    order = Window.partitionBy("doc").orderBy("page_number")
    begun = pages.withColumn("first", F.min(F.when(full, F.col("page_number"))).over(Window.partitionBy("doc"))).filter("page_number >= first")
    # Without a gap, the k-th page of the run has number first + k - 1 and qualifies.
    run = begun.withColumn("ok", more & (F.col("page_number") == F.col("first") + F.row_number().over(order) - 1))
    kept = run.withColumn("broken", F.max(F.when(~F.col("ok"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return kept.filter("broken = 0").select("doc", "page_number", "leaders")


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def line_shapes(lines: DataFrame) -> DataFrame:
    """Lines with what each is by itself and on its page; empty ones go.

    Adds ``s`` (stripped), ``leader``, ``left`` and ``target`` (the parts of a leader line), ``own`` (whether
    that has a number), ``number`` and ``title`` where the line opens an entry, ``plain`` (neither a
    leader nor an opening), ``digits``, ``level_lines`` and ``level_letters`` (lines, and such with letters, that
    start at the same height; null where a height of the page is unknown) and ``at``, its place on the page.
    """
    page = Window.partitionBy("doc", "page_number")
    near = page.orderBy(F.round(F.col("y") * 1000).cast("bigint")).rangeBetween(-int(SAME_Y * 1000), int(SAME_Y * 1000))
    rows = lines.withColumn("s", F.regexp_replace("line", f"^{WS}+|{WS}+$", "")).filter("s <> ''")
    rows = rows.withColumns({"left": F.trim(_part(F.col("s"), LEADER_LINE, 1)), "target": _part(F.col("s"), LEADER_LINE, 2).try_cast("int")})
    rows = rows.withColumn("leader", F.col("target").isNotNull())
    subject = F.when(F.col("leader"), F.col("left")).otherwise(F.col("s"))
    numbered, bare = subject.rlike(NUMBERED), ~F.col("leader") & F.col("s").rlike(BARE)
    rows = rows.withColumns(
        {
            "own": F.col("leader") & numbered,
            "number": F.when(numbered, _part(subject, NUMBERED, 1)).when(bare, F.col("s")),
            "title": F.when(numbered, F.trim(_part(subject, NUMBERED, 2))),
            "digits": F.col("s").rlike(DIGITS),
            "known": F.min(F.col("y").isNotNull() & ~F.isnan("y")).over(page),
            "at": F.row_number().over(page.orderBy("line_no")),
        }
    )
    return rows.withColumns(
        {
            "plain": ~F.col("leader") & F.col("number").isNull(),
            "level_lines": F.when(F.col("known"), F.count(F.lit(1)).over(near)),
            "level_letters": F.when(F.col("known"), F.count_if(F.col("s").rlike(LETTER)).over(near)),
        }
    )


def parse_toc(lines: DataFrame) -> DataFrame:
    """Entries, and lines that look like entries but gave none (``unparsed``), of contents pages.

    ``lines`` has ``doc``, ``page_number``, ``line_no``, ``line`` and ``y``, null if unknown, and may have
    ``page_count``. An entry is a numbered line with a leader; or a number, with or without a title, closed by
    a leader without a number after at most :data:`WRAP_LINES` plain lines; by a page number alone at its
    height right after the title; or by a number at the end of the title that can be its page. A title
    beside a bare number stands in the next line at the same height.

    Each line's closing follows from the next lines alone, but for the last kind, whose page must not lie
    before the entry before. There, only titles that end in a number stand between two entries of the
    other kinds, and one is an entry if its page is not below the page of the last other kind and of all of
    its own kind since; those that aren't are below, so that counting them changes nothing. So windows say it
    all: no state, no loop. Lines of a document are at most those of :data:`SEARCH_PAGES` pages.
    """
    rows = line_shapes(lines.filter(F.col("page_number") <= SEARCH_PAGES))
    page = Window.partitionBy("doc", "page_number").orderBy("at")
    for k in range(1, WRAP_LINES + 2):
        rows = rows.withColumn(f"n{k}", F.lead(F.struct("s", "leader", "own", "left", "target", "number", "plain", "digits", "y", "level_lines")).over(page) if k == 1 else F.lead("n1", k - 1).over(page))
    n = [None, *[F.col(f"n{k}") for k in range(1, WRAP_LINES + 2)]]
    closing = lambda title, target, size, kind: F.struct(title.alias("title"), target.alias("page"), F.lit(size).alias("lines"), F.lit(kind).alias("kind"))
    titled, opens = F.col("title").isNotNull(), ~F.col("leader") & F.col("number").isNotNull()
    wrapped = []
    for k in range(1, WRAP_LINES + 2):
        between = [n[j]["s"] for j in range(1, k)]
        fits = n[k]["leader"] & ~n[k]["own"]
        for j in range(1, k):
            fits &= n[j]["plain"]
        title = F.concat_ws(" ", F.col("title"), *between, F.nullif(n[k]["left"], F.lit("")))
        wrapped.append(F.when(opens & fits, closing(title, n[k]["target"], k + 1, "leader")))
    beside = ~titled & F.col("known") & (F.abs(F.col("y") - n[1]["y"]) <= SAME_Y)
    alone = lambda x: F.col("known") & x["digits"] & (x["level_lines"] == 1)
    number = lambda x: x["s"].try_cast("int")
    lone = [
        F.when(opens & titled & alone(n[1]) & number(n[1]).isNotNull(), closing(F.col("title"), number(n[1]), 2, "lone")),
        F.when(opens & beside & n[1]["plain"] & alone(n[2]) & number(n[2]).isNotNull(), closing(n[1]["s"], number(n[2]), 3, "lone")),
    ]
    whole = F.when(F.col("own"), closing(F.col("title"), F.col("target"), 1, "leader"))
    rows = rows.withColumn("fixed", F.coalesce(whole, *wrapped, *lone))
    # A page number that closed an entry opens none.
    closes = lambda k: F.coalesce((F.lag("fixed.kind", k).over(page) == "lone") & (F.lag("fixed.lines", k).over(page) == k + 1), F.lit(False))
    rows = rows.withColumn("taken", closes(1) | closes(2)).withColumn("fixed", F.when(~F.col("taken"), F.col("fixed")))
    ends = F.when(titled, F.col("title")).when(beside & n[1]["number"].isNull(), n[1]["s"])
    target = _part(ends, TRAILING, 2).try_cast("int")
    possible = opens & F.col("fixed").isNull() & ~F.col("taken") & target.isNotNull()
    if "page_count" in lines.columns:
        possible &= F.col("page_count").isNull() | (target <= F.col("page_count"))
    last = closing(F.trim(_part(ends, TRAILING, 1)), target, 1, "last").withField("lines", F.when(titled, 1).otherwise(2))
    order = Window.partitionBy("doc").orderBy("page_number", "at")
    rows = rows.withColumn("last", F.when(possible, last)).withColumn("part", F.count("fixed").over(order))
    since = Window.partitionBy("doc", "part").orderBy("page_number", "at").rowsBetween(Window.unboundedPreceding, -1)
    floor = F.coalesce(F.max(F.coalesce("fixed.page", "last.page")).over(since), F.lit(0))
    rows = rows.withColumn("floor", floor).withColumn("entry", F.coalesce("fixed", F.when(F.col("last.page") >= F.col("floor"), F.col("last"))))
    reach = F.max(F.col("at") + F.col("entry.lines")).over(page.rowsBetween(-WRAP_LINES - 1, 0))
    used = F.coalesce(reach > F.col("at"), F.lit(False))
    # A numbered line has a title of letters, in it or at its height.
    named = F.col("number").rlike(SECTION) & F.when(titled, F.col("title").rlike(LETTER)).otherwise(F.coalesce(F.col("level_letters") > 0, F.lit(False)))
    odd = ~used & ((F.col("leader") & ~F.col("own")) | F.coalesce(named & ~F.col("leader"), F.lit(False)))
    rows = rows.withColumn("odd", odd).filter(F.col("entry").isNotNull() | F.col("odd"))
    found = F.col("entry").isNotNull()
    return rows.select(
        "doc",
        F.when(found, F.col("number")).alias("number"),
        F.col("entry.title").alias("title"),
        F.col("entry.page").alias("page"),
        F.when(found, number_depth(F.col("number"))).alias("level"),
        F.when(~found, F.col("s")).alias("unparsed"),
    )


def outline_entries(outline: DataFrame) -> DataFrame:
    """Entries from outlines (``doc``, ``title``, ``page``, ``level``): the number is split off, and its depth wins over the level."""
    number, title = split_number(F.col("title"))
    depth = F.when(number.rlike(SECTION), number_depth(number))
    return outline.select("doc", number.alias("number"), title.alias("title"), "page", F.coalesce(depth, F.col("level")).alias("level"))


def contents(outline: DataFrame, printed: DataFrame) -> DataFrame:
    """Entries of each document: those of its outline if it has one, else the printed ones."""
    names = ["doc", "number", "title", "page", "level"]
    return outline.select(names).unionByName(printed.join(outline.select("doc").distinct(), "doc", "left_anti").select(names))


def match_headings(entries: DataFrame, headings: DataFrame) -> DataFrame:
    """Each entry with the closest unused heading that reads the same.

    ``entries``: ``entry_id``, ``doc``, ``number``, ``title``, ``page``, ``level``; ``headings``:
    ``element_id``, ``doc``, ``text``, ``page_number``, ``level``. Adds ``element_id``, null if missing,
    and ``state``: ``ok``, ``missing``, ``page`` (off by more than one) or ``level``. Keys that one
    entry and one heading have meet in a join; only the others take turns in a grouped stage.
    """
    line = F.when(F.col("number").isNull(), F.col("title")).otherwise(F.concat("number", F.lit(" "), "title"))
    e = entries.select("entry_id", "doc", heading_key(line).alias("key"), "page", F.col("level").alias("entry_level")).filter("key is not null and doc is not null")
    h = headings.select("element_id", "doc", heading_key(F.col("text")).alias("key"), F.col("page_number").alias("at"), F.col("level").alias("heading_level")).filter("key is not null")
    en = e.groupBy("doc", "key").agg(F.count(F.lit(1)).alias("en"))
    hn = h.groupBy("doc", "key").agg(F.count(F.lit(1)).alias("hn"))
    many = en.join(hn, ["doc", "key"]).filter("en > 1 or hn > 1").select("doc", "key")
    plain = e.join(many, ["doc", "key"], "left_anti").join(h, ["doc", "key"], "left")
    both = e.join(many, ["doc", "key"], "left_semi").select("doc", "key", F.lit(0).alias("side"), F.col("entry_id").alias("id"), "page", F.col("entry_level").alias("level"))
    both = both.unionAll(h.join(many, ["doc", "key"], "left_semi").select("doc", "key", F.lit(1), "element_id", "at", "heading_level"))

    def turns(part: pd.DataFrame) -> pd.DataFrame:
        free = part[part["side"] == 1].assign(page=lambda p: p["page"].fillna(0)).sort_values(["page", "id"])
        pages, left = free["page"].tolist(), list(free[["id", "page", "level"]].itertuples(index=False))
        rows = []
        for r in part[part["side"] == 0].sort_values("id").itertuples(index=False):
            at = 0 if pd.isna(r.page) else r.page
            i = bisect_left(pages, at)
            if i and (i == len(pages) or at - pages[i - 1] <= pages[i] - at):
                i = bisect_left(pages, pages[i - 1])  # the first of the page before
            if pages:
                pages.pop(i)
            rows.append((r.id, r.doc, r.key, r.page, r.level, *(left.pop(i) if left else (None, None, None))))
        return pd.DataFrame(rows, columns=["entry_id", "doc", "key", "page", "entry_level", "element_id", "at", "heading_level"]).astype({"page": "Int32", "entry_level": "Int32", "element_id": "Int64", "at": "Int32", "heading_level": "Int32"})

    shared = shipped(both).groupBy("doc", "key").applyInPandas(turns, "entry_id bigint, doc string, key string, page int, entry_level int, element_id bigint, at int, heading_level int")
    out = plain.select(shared.columns).unionByName(shared)
    state = F.when(F.col("element_id").isNull(), "missing").when(F.abs(F.col("at") - F.col("page")) > PAGE_TOLERANCE, "page").when(F.col("heading_level") != F.col("entry_level"), "level").otherwise("ok")
    return out.select("entry_id", "doc", "element_id", "page", "at", state.alias("state"))
