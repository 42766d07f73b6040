"""Queries on the structure of documents: headings, lists, sections and their rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import render
from quire.operators import elements as ops
from quire.sources.tables import table


def _current(spark: SparkSession, folder: str) -> DataFrame:
    return ops.latest(table(spark, folder, "elements"), spread=True)


def latest_elements(spark: SparkSession, folder: str) -> DataFrame:
    return _current(spark, folder).select("element_id", "doc", "page_number", "seq")


def tier_merge(spark: SparkSession, folder: str) -> DataFrame:
    return ops.best_tier(_current(spark, folder)).select("element_id", "doc", "page_number", "tier")


def heading_path(spark: SparkSession, folder: str) -> DataFrame:
    df = ops.open_headings(_current(spark, folder))
    return df.select("element_id", F.array_join("path", " > ").alias("path"), "parent_id")


def list_depths(spark: SparkSession, folder: str) -> DataFrame:
    return ops.list_depths(_current(spark, folder)).filter("type = 'list_item'").select("element_id", F.col("depth").cast("int").alias("depth"))


def h1_sections(spark: SparkSession, folder: str) -> DataFrame:
    return ops.section_titles(_current(spark, folder)).select("doc", "section", "title", "elements", "pages")


def section_nav(spark: SparkSession, folder: str) -> DataFrame:
    return ops.section_titles(_current(spark, folder)).select("doc", "section", "previous", F.col("next").alias("following"))


def sub_headings(spark: SparkSession, folder: str) -> DataFrame:
    df = _current(spark, folder).withColumn("level", F.when(~F.coalesce("sub_heading", F.lit(False)), F.col("level")))
    return ops.sub_heading_levels(df).filter("type = 'heading' and sub_heading").select("element_id", F.col("level").cast("int").alias("level"))


def element_markdown(spark: SparkSession, folder: str) -> DataFrame:
    df = ops.list_depths(_current(spark, folder))
    return df.select("element_id", render.markdown("depth").alias("markdown"))


def doc_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Length and hash of the Markdown of each document."""
    text = render.page_markdown(_current(spark, folder))
    return text.select("doc", "page_number", F.length("markdown").cast("bigint").alias("chars"), F.md5("markdown").alias("digest"))


_LATEST = """latest as (
  select * from (select *, row_number() over (partition by doc, page_number, seq order by extracted_at desc nulls last, element_id desc) as _n from elements where doc is not null) where _n = 1)"""
_LEVEL = "least(greatest(coalesce(level, 1), 1), 6)"


def _last_by_level(kind: str, extra: str) -> str:
    return ",\n".join(f"max(case when type = '{kind}' and {_LEVEL} = {k} then pos end) over w as l{k}" for k in range(1, 7)) + extra


def _still(k: int, prefix: str = "l", low: str = "-1") -> str:
    above = ", ".join(f"coalesce({prefix}{j}, -1)" for j in range(1, k))
    return f"{prefix}{k} > {low}" + (f" and {prefix}{k} > greatest({above})" if k > 2 else f" and {prefix}{k} > {above}" if k == 2 else "")


SQL = {
    "latest_elements": f"with {_LATEST} select element_id, doc, page_number, seq from latest",
    "tier_merge": f"""with {_LATEST}, ranked as (select *, case tier when 'vision' then 1 when 'ocr' then 2 when 'text' then 3 else 9 end as r from latest),
  best as (select *, min(case when type <> 'image' then r end) over (partition by doc, page_number) as b from ranked)
  select element_id, doc, page_number, tier from best where type = 'image' or r = b""",
    "heading_path": f"""with {_LATEST}, p as (select *, row_number() over (partition by doc order by page_number, seq) as pos from latest),
  s as (select *, {_last_by_level("heading", "")} from p window w as (partition by doc order by pos rows between unbounded preceding and 1 preceding)),
  o as (select *, {", ".join(f"case when {_still(k)} and (type <> 'heading' or {_LEVEL} > {k}) then l{k} end as o{k}" for k in range(1, 7))} from s)
  select o.element_id, concat_ws(' > ', {", ".join(f"t{k}.text" for k in range(1, 7))}) as path,
    coalesce({", ".join(f"t{k}.element_id" for k in range(6, 0, -1))}) as parent_id
  from o {" ".join(f"left join p t{k} on t{k}.doc = o.doc and t{k}.pos = o.o{k}" for k in range(1, 7))}""",
    "list_depths": f"""with {_LATEST}, p as (select *, row_number() over (partition by doc order by page_number, seq) as pos from latest),
  s as (select *, {_last_by_level("list_item", ", coalesce(max(case when type <> 'list_item' then pos end) over w, 0) as stop")} from p window w as (partition by doc order by pos rows between unbounded preceding and 1 preceding)),
  c as (select *, {", ".join(f"case when l{k} > stop then l{k} end as m{k}" for k in range(1, 7))} from s)
  select element_id, cast({" + ".join(f"(case when {_still(k, 'm')} and {_LEVEL} > {k} then 1 else 0 end)" for k in range(1, 7))} as int) as depth from c where type = 'list_item'""",
}
_SECTIONS = f"""with {_LATEST}, s as (select *, sum(case when type = 'heading' and level <= 1 then 1 else 0 end) over (partition by doc order by page_number, seq rows unbounded preceding) as section from latest),
  t as (select doc, section, coalesce(max(case when type = 'heading' and level = 1 then text end), 'Front Matter') as title,
    count(*) filter (where not coalesce(type = 'heading' and level = 1, false)) as elements,
    count(distinct case when not coalesce(type = 'heading' and level = 1, false) then page_number end) as pages from s group by doc, section)"""
SQL |= {
    "h1_sections": _SECTIONS + " select doc, section, title, elements, pages from t",
    "section_nav": _SECTIONS + " select doc, section, lag(title) over (partition by doc order by section) as previous, lead(title) over (partition by doc order by section) as following from t",
    "sub_headings": f"""with {_LATEST}, n as (select * replace (case when not coalesce(sub_heading, false) then level end as level) from latest),
  a as (select *, last_value(case when type = 'heading' then level end ignore nulls) over (partition by doc order by page_number, seq rows between unbounded preceding and 1 preceding) as above from n)
  select element_id, cast(coalesce(level, least(coalesce(above, 0) + 1, 6)) as int) as level from a where type = 'heading' and sub_heading""",
}
_WIDTH = "list_max(list_transform(rows, lambda r: len(r)))"
_ROW = f"'| ' || array_to_string(list_transform(range(1, cast(w as bigint) + 1), lambda i: replace(replace(coalesce(r[i], ''), '|', '\\|'), chr(10), ' ')), ' | ') || ' |'"
_TABLE = f"array_to_string(list_concat([{_ROW.replace('r[i]', 'rows[1][i]')}], ['| ' || array_to_string(list_transform(range(1, cast(w as bigint) + 1), lambda i: '---'), ' | ') || ' |'], list_transform(rows[2:], lambda r: {_ROW})), chr(10))"
_IMAGE = "array_to_string(list_filter(['![' || coalesce(caption, '') || '](' || coalesce(asset, '') || ')', nullif(caption, ''), case when coalesce(figure_text, '') <> '' then '> ' || replace(figure_text, chr(10), chr(10) || '> ') end], lambda x: x is not null), chr(10))"
_MARKDOWN = f"""case type when 'heading' then repeat('#', {_LEVEL}) || ' ' || coalesce(text, '') when 'paragraph' then coalesce(text, '')
    when 'list_item' then repeat('  ', depth) || case when length(coalesce(marker, '')) > 1 then marker else '-' end || ' ' || coalesce(text, '')
    when 'table' then case when len(rows) > 0 then {_TABLE} else '' end when 'image' then {_IMAGE} else '' end"""


def _markdown_sql() -> str:
    head, tail = SQL["list_depths"].rsplit("select element_id, ", 1)
    depth = tail.rsplit(" as depth", 1)[0]
    return f"{head.rstrip()}, m as (select *, {depth} as depth, {_WIDTH} as w, lead(type) over (partition by doc, page_number order by seq) as next_type from c), k as (select *, {_MARKDOWN} as markdown from m)"


SQL["element_markdown"] = _markdown_sql() + " select element_id, markdown from k"
SQL["doc_markdown"] = _markdown_sql() + """, j as (select doc, page_number, trim(string_agg(markdown || case when type = 'list_item' and next_type = 'list_item' then chr(10) else chr(10) || chr(10) end, '' order by seq), chr(10)) || chr(10) as t from k group by doc, page_number)
  select doc, page_number, length(t) as chars, md5(t) as digest from j"""
QUERIES = {q.__name__: q for q in (latest_elements, tier_merge, heading_path, list_depths, h1_sections, section_nav, sub_headings, element_markdown, doc_markdown)}
