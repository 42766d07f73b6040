"""Queries on an output held against its source: tables, images, assets, running lines by place, outlines, Markdown.

The source of a place is what was extracted first, the output what was extracted last, planted rows included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import geometry
from quire.functions.text import NUMBER_PREFIX, heading_key
from quire.operators import elements as ops
from quire.operators import formats, furniture, gates, grades, toc
from quire.plans import checks, planted
from quire.plans.checks import FIRST
from quire.plans.texts import LATEST, LINES, PAGE_AREA, PAGE_HEIGHT, heading_key_sql, key_sql
from quire.session import stored
from quire.sources import markdown
from quire.sources.tables import table


def _source(spark: SparkSession, folder: str) -> DataFrame:
    return checks.first(spark, folder, planted.elements(spark, folder))


def _output(spark: SparkSession, folder: str) -> DataFrame:
    return ops.latest(planted.elements(spark, folder))


def native_tables(spark: SparkSession, folder: str) -> DataFrame:
    return formats.table_corruption(_source(spark, folder), _output(spark, folder))


def sheet_tables(spark: SparkSession, folder: str) -> DataFrame:
    return formats.table_corruption(_source(spark, folder), _output(spark, folder), exact=True)


def lost_images(spark: SparkSession, folder: str) -> DataFrame:
    return formats.lost_images(_source(spark, folder), _output(spark, folder))


def generic_captions(spark: SparkSession, folder: str) -> DataFrame:
    return formats.generic_captions(_output(spark, folder))


def _extractions(spark: SparkSession, folder: str) -> DataFrame:
    """Of each place the rows extracted ``first`` and ``last``, one row where both are the same; written once."""
    place = Window.partitionBy("doc", "page_number", "seq")
    nth = {"first": (F.col("extracted_at").asc_nulls_first(), F.col("element_id")), "last": (F.col("extracted_at").desc_nulls_last(), F.col("element_id").desc())}
    rows = planted.elements(spark, folder).filter("doc is not null").select("element_id", "doc", "page_number", "seq", "type", "text", "level", "rows", "caption", "extracted_at")
    rows = rows.withColumns({name: F.row_number().over(place.orderBy(*order)) == 1 for name, order in nth.items()})
    return stored(rows.filter("first or last").drop("extracted_at"))


def native_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Issues of each page, as one text. What both extractions have alike can't be missing and is compared no further."""
    both = _extractions(spark, folder)
    a, z, changed = both.filter("first"), both.filter("last"), both.filter("not (first and last)")
    lost, new = changed.filter("first"), changed.filter("last")
    key = lambda df: df.filter("type = 'heading'").select("doc", "page_number", heading_key(F.col("text")).alias("key"), F.least("level", F.lit(3)).alias("level"))
    headings = key(lost).exceptAll(key(new)).select("doc", "page_number").distinct()
    dropped = grades.dropped_units(lost.filter("text is not null"), z).select("doc", "page_number").distinct()
    issues = formats.page_issues(dropped, formats.table_corruption(a, z), formats.lost_images(lost, new), formats.generic_captions(z), headings)
    return issues.select("doc", "page_number", F.array_join("issues", ",").alias("issues"))


def missing_assets(spark: SparkSession, folder: str) -> DataFrame:
    """Images that name an asset which the first extraction of their document did not write."""
    files = _source(spark, folder).filter("type = 'image' and asset is not null").select("doc", F.col("asset").alias("path"))
    return gates.missing_assets(_output(spark, folder), files)


def uncovered_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Images and tables of the source, by their place, without one in the output."""
    shape = F.col("seq").cast("string")
    census = _source(spark, folder).filter("type in ('image', 'table')").select("doc", "page_number", shape.alias("shape_id"), F.lit(None).cast("array<string>").alias("groups"), F.col("type").alias("kind"))
    return gates.uncovered_figures(census, _output(spark, folder).withColumn("source_shape_id", shape))


def banded_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Elements that lose running lines where they stand at an edge, or have no box."""
    z = _output(spark, folder)
    running = furniture.document_lines(furniture.text_lines(z))
    return furniture.strip_banded(z, running, F.lit(PAGE_HEIGHT)).filter("removed > 0").select("element_id", "text", "removed")


def first_page_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = furniture.text_lines(_output(spark, folder))
    return furniture.first_page_text(lines, furniture.repeated_lines(lines, F.lit(PAGE_HEIGHT)))


def repeated_images(spark: SparkSession, folder: str) -> DataFrame:
    z = _output(spark, folder)
    return furniture.repeated_images(z.filter("type = 'image'"), F.lit(PAGE_HEIGHT), F.lit(PAGE_AREA), z)


def _outline(spark: SparkSession, folder: str) -> DataFrame:
    """Headings in capitals or of the first level, as an outline."""
    headings = _output(spark, folder).filter("type = 'heading' and text is not null and level = 1")
    return headings.select("doc", F.col("text").alias("title"), F.col("page_number").alias("page"), "level")


def outline_entries(spark: SparkSession, folder: str) -> DataFrame:
    return toc.outline_entries(_outline(spark, folder))


def contents_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of every document: of its outline, else the printed ones."""
    return toc.contents(toc.outline_entries(_outline(spark, folder)), table(spark, folder, "toc_entries"))


def markdown_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Body words, headings and cells of the crawled texts read as Markdown."""
    parts = markdown.markdown_parts(table(spark, folder, "documents"), "doc_id", "text")
    return parts.select("doc_id", F.size("words").alias("words"), F.md5(F.array_join("words", " ")).alias("digest"), F.array_join("headings", "|").alias("headings"), F.array_join("cells", "|").alias("cells"))


_SHAPES = """sh as (select *, row_number() over (partition by doc, page_number order by seq, element_id) as k, len(rows) as nr, coalesce(list_max(list_transform(rows, lambda r: len(r))), 0) as w, coalesce(list_min(list_transform(rows, lambda r: len(r))), 0) as mn from {0} where type = 'table')"""


def _tables_sql(extra: str) -> str:
    a, z = _SHAPES.format("earliest").replace("sh as", "a as"), _SHAPES.format("latest").replace("sh as", "z as")
    return planted.sql(f"""with {LATEST}, {FIRST}, {a}, {z}, m as (select coalesce(a.doc, z.doc) as doc, coalesce(a.page_number, z.page_number) as page_number, a.k is null or z.k is null or coalesce(a.nr, 0) <> coalesce(z.nr, 0) or a.w <> z.w {extra} as bad
  from a full join z on z.doc = a.doc and z.page_number = a.page_number and z.k = a.k) select doc, page_number, count(*) as tables from m where bad group by doc, page_number""")


_LOST = "select doc, page_number, cast(sum(n) as bigint) as lost from (select doc, page_number, case when type = 'image' then 1 else 0 end as n from earliest union all select doc, page_number, case when type = 'image' then -1 else 0 end from latest) group by doc, page_number having sum(n) > 0"
_GENERIC = f"select element_id, doc, page_number, caption from latest where type = 'image' and lower(trim(caption)) in {formats.GENERIC_CAPTIONS}"
_RUNNING = f"""{LINES}, kl as (select *, {key_sql('text')} as key, case when bbox[4] <= {geometry.BAND * PAGE_HEIGHT} then 'top' when bbox[2] >= {(1 - geometry.BAND) * PAGE_HEIGHT} then 'bottom' end as edge from lines)"""
_OUTLINE = rf"""o as (select doc, nullif(regexp_extract(trim(text), '{NUMBER_PREFIX}', 1), '') as number, page_number as page, level, trim(text) as t from latest where type = 'heading' and text is not null and level = 1),
  oe as (select doc, number, case when number is null then t else trim(regexp_extract(t, '{NUMBER_PREFIX}', 2)) end as title, page, coalesce(case when regexp_matches(number, '{toc.SECTION}') then cast(len(string_split(rtrim(number, '.'), '.')) as int) end, level) as level from o)"""
SQL = {
    "native_tables": _tables_sql(""),
    "sheet_tables": _tables_sql("or z.mn <> a.w"),
    "lost_images": planted.sql(f"with {LATEST}, {FIRST} {_LOST}"),
    "generic_captions": planted.sql(f"with {LATEST} {_GENERIC}"),
    "missing_assets": planted.sql(f"with {LATEST}, {FIRST} select element_id, doc, page_number, asset from latest l where type = 'image' and not exists (select 1 from earliest e where e.type = 'image' and e.doc = l.doc and e.asset = l.asset)"),
    "uncovered_figures": planted.sql(f"""with {LATEST}, {FIRST}, f as (select * from latest where type in ('image', 'table')), s as (select * from earliest where type in ('image', 'table')),
  x as (select doc, page_number from (select doc, page_number, count(*) as shapes from s group by all) join (select doc, page_number, count(*) as figures, bool_or(tier = 'vision') as seen from f group by all) using (doc, page_number) where seen and figures >= shapes)
  select doc, page_number, cast(seq as varchar) as shape_id, type as kind from s where not exists (select 1 from f where f.doc = s.doc and f.page_number = s.page_number and f.seq = s.seq) and not exists (select 1 from x where x.doc = s.doc and x.page_number = s.page_number)"""),
    "banded_lines": planted.sql(f"""with {_RUNNING}, d as (select k.doc, key from kl k join counts c on c.doc = k.doc where regexp_matches(key, '\\p{{L}}') group by k.doc, key having count(distinct page_number) >= 2 and count(distinct page_number) >= 0.6 * any_value(page_count)),
  m as (select k.*, d.key is not null as hit from kl k left join d on d.doc = k.doc and d.key = k.key where coalesce(len(bbox), 0) <> 4 or edge is not null)
  select element_id, coalesce(string_agg(text, chr(10) order by line_no) filter (where not hit), '') as text, count(*) filter (where hit) as removed from m group by element_id having count(*) filter (where hit) > 0"""),
    "first_page_lines": planted.sql(f"""with {_RUNNING}, r as (select k.doc, key from kl k join counts c on c.doc = k.doc where edge is not null and key <> '' group by k.doc, key, edge having count(distinct page_number) >= 2 and count(distinct page_number) >= 0.6 * any_value(page_count)),
  t as (select doc, key, bbox[2] as y, seq, line_no, trim(text) as text, row_number() over (partition by doc, key order by bbox[2], seq, line_no) as k from kl where page_number = 1 and (doc, key) in (select (doc, key) from r))
  select doc, string_agg(text, chr(10) order by y, seq, line_no) as text from t where k = 1 group by doc"""),
    "repeated_images": planted.sql(f"""with {LATEST}, i as (select doc, asset, page_number, bool_and(coalesce(bbox[4] <= {geometry.BAND * PAGE_HEIGHT} or bbox[2] >= {(1 - geometry.BAND) * PAGE_HEIGHT} or greatest(0.0, bbox[3] - bbox[1]) * greatest(0.0, bbox[4] - bbox[2]) >= {furniture.LARGEST * PAGE_AREA}, false)) as ok from latest where type = 'image' and asset is not null group by all),
  n as (select doc, count(distinct page_number) as page_count from latest group by doc) select i.doc, asset, count(*) as pages from i join n on n.doc = i.doc where ok group by i.doc, asset having count(*) >= 2 and count(*) >= 0.5 * any_value(page_count)"""),
    "outline_entries": planted.sql(f"with {LATEST}, {_OUTLINE} select * from oe"),
    "contents_entries": planted.sql(f"with {LATEST}, {_OUTLINE} select * from oe union all select doc, number, title, page, level from toc_entries t where not exists (select 1 from o where o.doc = t.doc)"),
    "native_issues": planted.sql(rf"""with {LATEST}, {FIRST}, {_SHAPES.format('earliest').replace('sh as', 'a as')}, {_SHAPES.format('latest').replace('sh as', 'z as')},
  pg as (select doc, page_number, trim(regexp_replace(lower(string_agg(text, ' ' order by seq, element_id)), '\s+', ' ', 'g')) as page from latest where text is not null group by doc, page_number),
  u as (select *, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as unit from earliest where text is not null),
  hd as (select doc, page_number, {heading_key_sql('text')} as key, least(level, 3) as level from earliest where type = 'heading' except all select doc, page_number, {heading_key_sql('text')} as key, least(level, 3) from latest where type = 'heading'),
  x as (select u.doc, u.page_number, 'dropped_text' as issue from u left join pg on pg.doc = u.doc and pg.page_number = u.page_number where length(unit) >= 15 and (page is null or not contains(page, unit))
    union all select coalesce(a.doc, z.doc), coalesce(a.page_number, z.page_number), 'table_corruption' from a full join z on z.doc = a.doc and z.page_number = a.page_number and z.k = a.k where a.k is null or z.k is null or coalesce(a.nr, 0) <> coalesce(z.nr, 0) or a.w <> z.w
    union all select doc, page_number, 'missing_image' from ({_LOST}) union all select doc, page_number, 'bad_caption' from ({_GENERIC}) union all select doc, page_number, 'wrong_heading_level' from hd)
  select doc, page_number, array_to_string(list_sort(list_distinct(list(issue))), ',') as issues from x group by doc, page_number"""),
    "markdown_parts": rf"""with l as (select doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r\x{{B}}\x{{C}}\x{{85}}\x{{2028}}\x{{2029}}]')) as line, generate_subscripts(regexp_split_to_array(text, '\r\n|[\n\r\x{{B}}\x{{C}}\x{{85}}\x{{2028}}\x{{2029}}]'), 1) as n from documents where text is not null),
  t as (select doc_id, n, trim(line) as s, starts_with(trim(line), '|') as row from l where trim(line) <> '' and not regexp_matches(trim(line), '{markdown.SKIPPED}')),
  c as (select *, list_transform(string_split(trim(s, '|'), '|'), lambda x: lower(trim(x))) as cs, case when not row and regexp_matches(s, '{markdown.HEADING}') then lower(trim(regexp_extract(s, '{markdown.HEADING}', 2))) end as heading, length(regexp_extract(s, '{markdown.HEADING}', 1)) as level from t where not (row and regexp_matches(s, '{markdown.RULE}'))),
  w as (select *, list_filter(regexp_split_to_array(case when row then array_to_string(cs, ' ') else lower(regexp_replace(coalesce(heading, s), '{markdown.ITEM}', '')) end, '\s+'), lambda x: x <> '') as ws from c)
  select doc_id, cast(sum(len(ws)) as int) as words, md5(coalesce(string_agg(array_to_string(ws, ' '), ' ' order by n) filter (where len(ws) > 0), '')) as digest, coalesce(string_agg(level || ' ' || heading, '|' order by n) filter (where heading is not null), '') as headings,
    coalesce(string_agg(array_to_string(list_filter(cs, lambda x: x <> ''), '|'), '|' order by n) filter (where row and len(list_filter(cs, lambda x: x <> '')) > 0), '') as cells from w group by doc_id""",
}
QUERIES = {
    q.__name__: q
    for q in (native_tables, sheet_tables, lost_images, generic_captions, native_issues, missing_assets, uncovered_figures, banded_lines, first_page_lines, repeated_images, outline_entries, contents_entries, markdown_parts)
}
