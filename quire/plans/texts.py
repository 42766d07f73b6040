"""Queries on text keys, numbers, lines and repetition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry, glyphs
from quire.functions import text as t
from quire.operators import elements as ops
from quire.operators import furniture
from quire.plans import planted
from quire.sources.tables import table

PAGE_HEIGHT, PAGE_AREA = 792.0, 612.0 * 792.0


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "elements").filter("text is not null")


def _headings(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).filter("type = 'heading'")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return furniture.text_lines(ops.latest(table(spark, folder, "elements")))


def _document_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def furniture_keys(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).select("element_id", t.furniture_key(F.col("text")).alias("key"), t.has_letters(F.col("text")).alias("letters"))


def heading_keys(spark: SparkSession, folder: str) -> DataFrame:
    return _headings(spark, folder).select("element_id", t.heading_key(F.col("text")).alias("key"))


def section_numbers(spark: SparkSession, folder: str) -> DataFrame:
    number, title = t.split_number(F.col("text"))
    section = t.section_number(F.col("text"))
    return _headings(spark, folder).select("element_id", number.alias("number"), title.alias("title"), section.alias("section"), t.number_depth(section).alias("depth"))


def slugs(spark: SparkSession, folder: str) -> DataFrame:
    return _headings(spark, folder).select("element_id", t.slug(F.col("text")).alias("slug"), t.heading_slug(F.col("text")).alias("anchor"))


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of each page as one, words cut at hyphens joined."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    df = ops.latest(table(spark, folder, "elements")).filter("text is not null").groupBy("doc", "page_number").agg(t.join_texts(listed).alias("joined"))
    return df.select("doc", "page_number", F.length("joined").cast("bigint").alias("chars"), F.md5("joined").alias("digest"))


def list_markers(spark: SparkSession, folder: str) -> DataFrame:
    marker, rest = t.list_marker(F.col("line"))
    return _document_lines(spark, folder).select("doc_id", "line_no", marker.alias("marker"), rest.alias("rest")).filter("marker is not null")


def caption_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _document_lines(spark, folder).filter(t.is_caption(F.col("line"))).select("doc_id", "line_no", F.trim("line").alias("caption"))


def first_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", t.first_sentence(F.col("text")).alias("sentence"))


def garbled_share(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).select("element_id", t.garbled_fraction(F.col("text")).alias("garbled")).filter("garbled > 0")


def page_tiers(spark: SparkSession, folder: str) -> DataFrame:
    image = F.when(F.col("type") == "image", geometry.area(F.col("bbox")))
    df = ops.latest(table(spark, folder, "elements")).groupBy("doc", "page_number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("seq", "text")))), lambda x: x["text"]), "\n").alias("text"),
        F.least(F.coalesce(F.sum(image), F.lit(0.0)) / PAGE_AREA, F.lit(1.0)).alias("images"),
    )
    chars = F.length(F.trim("text"))
    return df.select("doc", "page_number", t.page_tier(F.col("text"), F.col("images")).alias("tier"), F.least(chars / 500.0, F.lit(1.0)).alias("text_ratio"), "images")


def text_languages(spark: SparkSession, folder: str) -> DataFrame:
    return furniture.language_hits(table(spark, folder, "documents"), "doc_id", "text", t.function_words())


def long_words(spark: SparkSession, folder: str) -> DataFrame:
    words = t.coverage_words(F.col("text"))
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", F.size(words).alias("words"), F.size(F.array_distinct(words)).alias("different"))


def ligatures(spark: SparkSession, folder: str) -> DataFrame:
    fixed = glyphs.fix_ligatures(F.col("text"))
    return _texts(spark, folder).select("element_id", fixed.alias("fixed")).join(_texts(spark, folder).select("element_id", "text"), "element_id").filter("fixed <> text").select("element_id", "fixed")


def running_lines(spark: SparkSession, folder: str) -> DataFrame:
    return furniture.repeated_lines(furniture.text_lines(ops.latest(planted.elements(spark, folder))), F.lit(PAGE_HEIGHT))


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    return furniture.document_lines(_lines(spark, folder))


def stripped_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder)
    current = ops.latest(table(spark, folder, "elements"))
    return furniture.strip_lines(current, furniture.document_lines(lines)).filter("removed > 0")


def output_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return furniture.output_repeats(_lines(spark, folder))


def repeated_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Image boxes that recur at one place of a document's pages."""
    return furniture.box_groups(ops.latest(planted.elements(spark, folder)).filter("type = 'image'"), 2, 0.1)


_WS = t.WS.replace("\\", "\\")
_TRIM = " \t\n\r"
LATEST = """latest as (
  select * from (select *, row_number() over (partition by doc, page_number, seq order by extracted_at desc nulls last, element_id desc) as _n from elements where doc is not null) where _n = 1)"""


def key_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '{_WS}+', '', 'g'), '\p{{Nd}}+', '#', 'g')"


def heading_key_sql(x: str) -> str:
    return f"replace(lower(regexp_replace(trim(regexp_replace({x}, '{_WS}+', ' ', 'g')), '{t.TRAILING}', '')), 'ß', 'ss')"


def join_sql(a: str, b: str) -> str:
    return rf"case when coalesce({a}, '') = '' then {b} when coalesce({b}, '') = '' then {a} when regexp_matches({a}, '[\p{{L}}\p{{N}}][-\x{{2010}}\x{{2011}}]$') then {a} || {b} else {a} || ' ' || {b} end"


def garbled_sql(x: str) -> str:
    solid = f"regexp_replace({x}, '{_WS}+', '', 'g')"
    return rf"case when length({solid}) > 0 then length(regexp_replace({solid}, '[^\x{{FFFD}}\p{{Cc}}\p{{Co}}]', '', 'g')) / length({solid}) else 0.0 end"


LINES = f"{LATEST}, lines as (select element_id, doc, page_number, seq, bbox, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\x{{B}}\\x{{C}}\\r\\x{{1C}}-\\x{{1E}}\\x{{85}}\\x{{2028}}\\x{{2029}}]')) as text, generate_subscripts(regexp_split_to_array(text, '\\r\\n|[\\n\\x{{B}}\\x{{C}}\\r\\x{{1C}}-\\x{{1E}}\\x{{85}}\\x{{2028}}\\x{{2029}}]'), 1) - 1 as line_no from latest where text is not null), counts as (select doc, count(distinct page_number) as page_count from lines group by doc)"
_DLINES = "dl as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents where text is not null)"
_TEXTS = "(select * from elements where text is not null)"
_HEADINGS = "(select * from elements where text is not null and type = 'heading')"
_DOCLINES = f"""with {LINES}, keyed as (select *, {key_sql("text")} as key from lines), d as (
  select k.doc, key, count(distinct page_number) as pages, count(*) as lines, any_value(page_count) as page_count from keyed k join counts c on c.doc = k.doc where regexp_matches(key, '\\p{{L}}') group by k.doc, key
  having count(distinct page_number) >= 2 and count(distinct page_number) >= 0.6 * any_value(page_count))"""
_WORDS = ", ".join(f"('{w}', '{lang}')" for w, lang in t.function_words())
_ALONE = r"regexp_replace(regexp_replace(regexp_replace({x}, '(\p{{Ll}})Ɵ', '\1ti', 'g'), 'Ɵ(\p{{Ll}})', 'ti\1', 'g'), '(\p{{Ll}})Ō', '\1ft', 'g')"


def _ligatures_sql(x: str) -> str:
    for a, b in glyphs.LIGATURES.items():
        x = f"replace({x}, '{a}', '{b}')"
    return rf"regexp_replace({_ALONE.format(x=x)}, '(\p{{Ll}})Ʃ', '\1tt', 'g')"


SQL = {
    "furniture_keys": rf"select element_id, {key_sql('text')} as key, regexp_matches(text, '\p{{L}}') as letters from {_TEXTS}",
    "heading_keys": f"select element_id, {heading_key_sql('text')} as key from {_HEADINGS}",
    "section_numbers": rf"""with n as (select element_id, trim(text) as x, nullif(regexp_extract(trim(text), '{t.NUMBER_PREFIX}', 1), '') as number, nullif(regexp_extract(trim(text), '{t.SECTION_NUMBER}', 1), '') as section from {_HEADINGS})
  select element_id, number, case when number is null then x else trim(regexp_extract(x, '{t.NUMBER_PREFIX}', 2)) end as title, section, cast(len(string_split(rtrim(section, '.'), '.')) as int) as depth from n""",
    "slugs": rf"""with s as (select element_id, text, coalesce(nullif(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'section') as slug, regexp_extract(text, '^\s*(\d+(?:\.\d+)*)', 1) as n from {_HEADINGS})
  select element_id, slug, case when n <> '' then replace(n, '.', '-') else slug end as anchor from s""",
    "page_texts": f"""with {LATEST}, l as (select doc, page_number, list(text order by seq) as ts from latest where text is not null group by doc, page_number),
  j as (select doc, page_number, list_reduce(ts, lambda a, b: {join_sql('a', 'b')}) as joined from l) select doc, page_number, length(joined) as chars, md5(joined) as digest from j""",
    "list_markers": f"with {_DLINES}, m as (select doc_id, line_no, nullif(regexp_extract(line, '{t.MARKER}', 1), '') as marker, trim(regexp_extract(line, '{t.MARKER}', 2)) as rest from dl) select * from m where marker is not null",
    "caption_lines": f"with {_DLINES} select doc_id, line_no, trim(line) as caption from dl where regexp_matches(trim(line), '{t.CAPTION}')",
    "first_sentences": r"""with s as (select doc_id, trim(text) as x, regexp_extract(trim(text), '(?s)^(.*?[.!?])(?:\s|$)', 1) as s from documents where text is not null)
  select doc_id, case when s <> '' then s when length(x) <= 160 then x else regexp_replace(substring(x, 1, 160), '(?s) [^ ]*$', '') || '…' end as sentence from s""",
    "garbled_share": f"with g as (select element_id, {garbled_sql('text')} as garbled from {_TEXTS}) select * from g where garbled > 0",
    "page_tiers": f"""with {LATEST}, p as (select doc, page_number, coalesce(string_agg(text, chr(10) order by seq), '') as text,
    least(coalesce(sum(case when type = 'image' then greatest(0.0, bbox[3] - bbox[1]) * greatest(0.0, bbox[4] - bbox[2]) end), 0.0) / {PAGE_AREA}, 1.0) as images from latest group by doc, page_number)
  select doc, page_number, case when length(trim(text)) < 20 then case when images > 0 then 'ocr' else 'text' end when {garbled_sql('text')} >= 0.1 then 'ocr' when length(trim(text)) < 200 and images >= 0.5 then 'ocr' else 'text' end as tier,
    least(length(trim(text)) / 500.0, 1.0) as text_ratio, images from p""",
    "text_languages": rf"""with w(word, lang) as (values {_WORDS}), x as (select doc_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) as word from documents), h as (select doc_id, lang, count(*) as hits from x join w using (word) group by doc_id, lang),
  s as (select *, hits / sum(hits) over (partition by doc_id) as share from h) select doc_id, lang, hits, share from s where hits >= 20 and share >= 0.15""",
    "long_words": rf"with w as (select doc_id, regexp_extract_all(lower(text), '{t.WORD4}') as ws from documents where text is not null) select doc_id, cast(len(ws) as int) as words, cast(len(list_distinct(ws)) as int) as different from w",
    "ligatures": f"with f as (select element_id, text, {_ligatures_sql('text')} as fixed from {_TEXTS}) select element_id, fixed from f where fixed <> text",
    "running_lines": planted.sql(f"""with {LINES}, banded as (select *, {key_sql('text')} as key, case when bbox[4] <= {geometry.BAND * PAGE_HEIGHT} then 'top' when bbox[2] >= {(1 - geometry.BAND) * PAGE_HEIGHT} then 'bottom' end as edge from lines)
  select b.doc, key, edge, count(distinct page_number) as pages, min(bbox[2]) as y_min, max(bbox[4]) as y_max from banded b join counts c on c.doc = b.doc where edge is not null and key <> '' group by b.doc, key, edge
  having count(distinct page_number) >= 2 and count(distinct page_number) >= 0.6 * any_value(page_count)"""),
    "document_lines": _DOCLINES + " select doc, key, pages, lines from d",
    "stripped_lines": _DOCLINES + """, m as (select k.*, d.key is not null as hit from keyed k left join d on d.doc = k.doc and d.key = k.key)
  select element_id, coalesce(string_agg(text, chr(10) order by line_no) filter (where not hit), '') as text, count(*) filter (where hit) as removed from m group by element_id having count(*) filter (where hit) > 0""",
    "output_repeats": f"with {LINES}, o as (select doc, trim(text) as line, count(*) as n from lines where trim(text) <> '' group by doc, trim(text)) select o.doc, line, n from o join counts c on c.doc = o.doc where n >= greatest(3, ceil(page_count * 0.1))",
}
QUERIES = {q.__name__: q for q in (furniture_keys, heading_keys, section_numbers, slugs, page_texts, list_markers, caption_lines, first_sentences, garbled_share, page_tiers, text_languages, long_words, ligatures, running_lines, document_lines, stripped_lines, output_repeats, repeated_boxes)}
