"""Queries on ``merged_records``: problem 1."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.operators.gates import BENIGN
from quire.operators.nested import flat_rows, flat_tables
from quire.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every flat row of every record, by its places."""
    return flat_rows(table(spark, folder, "merged_records"), values=False)


def _flat(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: flat_tables(table(spark, folder, "merged_records"))[kind]


QUERIES = {
    "p1_found": p1_found,
    "p1_pages": _flat("page"),
    "p1_elements": _flat("element"),
    "p1_cells": _flat("cell"),
    "p1_regions": _flat("region"),
}
#: Pages, elements, regions and cells by their places in the JSON, numbered within the record.
_PLACES = r"""with d as (select record_id, coalesce(cast(payload as json)->'pages', cast(payload as json)->'document'->'pages') as pages from merged_records where json_valid(payload)),
p0 as (select record_id, e.key, e.rowid as place, e.value as page from d, lateral json_each(d.pages) e where json_type(e.value) <> 'NULL'),
p as (select record_id, row_number() over (partition by record_id order by place) as pid, coalesce(try_cast(page->>'page_number' as int), try_cast(page->>'pageNumber' as int), try_cast(key as int)) as page_no, page from p0),
e as (select record_id, page_no, pid, row_number() over (partition by record_id order by pid, cast(x.key as int)) as eid, cast(x.key as int) + 1 as item_no, x.value as el from p, lateral json_each(case when json_type(page->'elements') = 'ARRAY' then page->'elements' else '[]' end) x where json_type(x.value) <> 'NULL'),
g0 as (select record_id, page_no, pid, coalesce(page->'excluded_regions', page->'excludedRegions') as g from p),
g as (select record_id, page_no, pid, cast(x.key as int) + 1 as item_no, x.value as gv from g0, lateral json_each(case json_type(g) when 'ARRAY' then g when 'OBJECT' then json_array(g) else '[]' end) x where json_type(x.value) <> 'NULL'),
t0 as (select record_id, page_no, item_no, eid, case json_type(el->'rows') when 'VARCHAR' then cast(el->>'rows' as json) when 'ARRAY' then el->'rows' else '[]' end as rows from e),
t as (select *, not exists (select 1 from json_each(rows) y where json_type(y.value) in ('ARRAY', 'OBJECT')) as flat from t0),
r as (select record_id, page_no, item_no, cast(x.key as int) + 1 as row_no, eid, x.value as r from t, lateral json_each(case when flat then json_array(rows) else rows end) x),
c as (select record_id, page_no, item_no, row_no, cast(x.key as int) + 1 as cell_no, eid, x.value as cv from r, lateral json_each(case json_type(r) when 'ARRAY' then r when 'OBJECT' then r->'cells' else '[]' end) x where json_type(x.value) <> 'NULL')"""
_COUNTS = """,
np as (select record_id, count(*) as pages from p group by record_id), ne as (select record_id, count(*) as items from e group by record_id), nc as (select record_id, count(*) as cells from c group by record_id)
"""


def _box(x: str) -> str:
    spaced = f"regexp_split_to_array(trim({x}->>'$'), '[\\s,;]+')"
    box = f"""case json_type({x}) when 'ARRAY' then list_transform(range(4), lambda i: try_cast(({x}->i) as double)) when 'OBJECT' then [try_cast({x}->>'x0' as double), try_cast({x}->>'y0' as double), try_cast({x}->>'x1' as double), try_cast({x}->>'y1' as double)] else list_transform({spaced}, lambda v: try_cast(v as double)) end"""
    return f"case when json_type({x}) = 'ARRAY' and json_array_length({x}) <> 4 then null when len({box}) = 4 then {box} end"


SQL = {
    "p1_found": _PLACES + """
select record_id, page_no, 'page' as kind, 0 as item_no, 0 as row_no, 0 as cell_no from p
union all select record_id, page_no, 'element', item_no, 0, 0 from e
union all select record_id, page_no, 'region', item_no, 0, 0 from g
union all select record_id, page_no, 'cell', item_no, row_no, cell_no from c""",
    "p1_pages": _PLACES + " select record_id, pid as row_id, page_no, page->>'tier' as tier, page->>'skipped' as skipped, try_cast(coalesce(page->>'ocr_confidence', page->>'ocrConfidence') as double) as ocr_confidence from p",
    "p1_elements": _PLACES + _COUNTS + f"""select e.record_id, pages + eid as row_id, pid as page_id, page_no, item_no, lower(el->>'type') as type, el->>'text' as text, try_cast(el->>'level' as int) as level, el->>'marker' as marker, el->>'kind' as image_kind, el->>'asset' as asset, el->>'caption' as caption,
  coalesce(el->>'figure_text', el->>'figureText') as figure_text, {_box("(el->'bbox')")} as bbox from e join np using (record_id)""",
    "p1_cells": _PLACES + _COUNTS + """select c.record_id, pages + items + row_number() over (partition by c.record_id order by eid, row_no, cell_no) as row_id, pages + eid as element_id, page_no, item_no, row_no, cell_no, cv->>'$' as value from c join np using (record_id) join ne using (record_id)""",
    "p1_regions": _PLACES + _COUNTS + f"""select g.record_id, pages + coalesce(items, 0) + coalesce(cells, 0) + row_number() over (partition by g.record_id order by pid, item_no) as row_id, pid as page_id, page_no, item_no, gv->>'reason' as reason, try_cast(gv->>'count' as int) as count,
  try_cast(coalesce(gv->>'filled_cells', gv->>'filledCells') as int) as filled_cells, {_box("(gv->'bbox')")} as bbox from g join np using (record_id) left join ne using (record_id) left join nc using (record_id)""",
    "confidence_floor": _PLACES + " select record_id, page_no, try_cast(coalesce(page->>'ocr_confidence', page->>'ocrConfidence') as double) as ocr_confidence from p where page->>'tier' = 'ocr' and coalesce(try_cast(coalesce(page->>'ocr_confidence', page->>'ocrConfidence') as double), 0) < 0.5",
    "large_regions": _PLACES + f""", b as (select record_id, page_no, item_no, gv->>'reason' as reason, {_box("(gv->'bbox')")} as bbox from g), s as (select *, round(greatest(0.0, bbox[3] - bbox[1]) * greatest(0.0, bbox[4] - bbox[2]) / {612.0 * 792.0}, 3) as share from b)
  select record_id, page_no, item_no, reason, share from s where share > 0.2 and coalesce(reason, '') not in {BENIGN}""",
}
