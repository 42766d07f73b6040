"""Queries on contents, page breaks, gates, grades and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import geometry
from quire.functions.text import heading_key
from quire.operators import elements as ops
from quire.operators import gates, grades, layout, nested, page_breaks, toc
from quire.plans import planted
from quire.plans.texts import LATEST, heading_key_sql, join_sql
from quire.sources.tables import table

PAGE_AREA = 612.0 * 792.0


def _now(spark: SparkSession, folder: str) -> DataFrame:
    return ops.latest(table(spark, folder, "elements"))


def _all(spark: SparkSession, folder: str) -> DataFrame:
    """Current elements, and planted ones."""
    return ops.latest(planted.elements(spark, folder))


def first(spark: SparkSession, folder: str, source: DataFrame | None = None) -> DataFrame:
    """Of each place the row extracted first."""
    source = table(spark, folder, "elements") if source is None else source
    order = Window.partitionBy("doc", "page_number", "seq").orderBy(F.col("extracted_at").asc_nulls_first(), "element_id")
    return source.filter("doc is not null").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def _toc_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the crawled texts, each block of lines as a page."""
    block = F.posexplode(F.split("text", "\n\n")).alias("b", "block")
    df = table(spark, folder, "documents").filter("text is not null").select(F.col("doc_id").alias("doc"), block)
    return df.select("doc", (F.col("b") + 1).alias("page_number"), F.posexplode(F.split("block", "\n")).alias("line_no", "line"))


def toc_entries_printed(spark: SparkSession, folder: str) -> DataFrame:
    df = toc.leader_entries(_toc_lines(spark, folder)).filter("number is not null")
    return df.select("doc", "page_number", "line_no", "number", "title", F.col("page"), "level")


#: Leaders that begin contents where pages are blocks of a crawled text, and so shorter than printed ones.
_BLOCK_LEADERS = 5


def toc_pages(spark: SparkSession, folder: str) -> DataFrame:
    return toc.toc_pages(_toc_lines(spark, folder), _BLOCK_LEADERS)


def toc_parsed(spark: SparkSession, folder: str) -> DataFrame:
    lines = _toc_lines(spark, folder).withColumn("y", F.lit(None).cast("double"))
    return toc.parse_toc(lines.join(toc.toc_pages(lines, _BLOCK_LEADERS).select("doc", "page_number"), ["doc", "page_number"], "left_semi"))


def toc_matches(spark: SparkSession, folder: str) -> DataFrame:
    return toc.match_headings(table(spark, folder, "toc_entries"), _now(spark, folder).filter("type = 'heading'"))


def toc_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Contents entries that no heading of the document answers."""
    e = table(spark, folder, "toc_entries").select("entry_id", "doc", heading_key(F.when(F.col("number").isNull(), F.col("title")).otherwise(F.concat("number", F.lit(" "), "title"))).alias("key"))
    h = _now(spark, folder).filter("type = 'heading'").select("doc", heading_key(F.col("text")).alias("key")).distinct()
    return e.join(h, ["doc", "key"], "left_anti").select("entry_id", "doc", "key")


def page_break_joins(spark: SparkSession, folder: str) -> DataFrame:
    df = page_breaks.page_break_joins(_now(spark, folder))
    return df.select("doc", "page_number", "element_id", "joined_id", F.md5("text").alias("digest"))


def table_chains(spark: SparkSession, folder: str) -> DataFrame:
    return page_breaks.table_chains(_all(spark, folder))


def empty_pages(spark: SparkSession, folder: str) -> DataFrame:
    return gates.empty_pages(table(spark, folder, "grade_shards"), table(spark, folder, "elements").filter("type <> 'image'"))


def confidence_floor(spark: SparkSession, folder: str) -> DataFrame:
    return gates.low_confidence(nested.flat_tables(table(spark, folder, "merged_records"))["page"]).select("record_id", "page_no", "ocr_confidence")


def large_regions(spark: SparkSession, folder: str) -> DataFrame:
    return gates.large_regions(nested.flat_tables(table(spark, folder, "merged_records"))["region"], F.lit(PAGE_AREA)).select("record_id", "page_no", "item_no", "reason", "share")


def orphan_captions(spark: SparkSession, folder: str) -> DataFrame:
    return gates.orphan_captions(_all(spark, folder))


def tables_as_figures(spark: SparkSession, folder: str) -> DataFrame:
    return gates.tables_as_figures(_all(spark, folder))


def figures_incomplete(spark: SparkSession, folder: str) -> DataFrame:
    return gates.incomplete_figures(_now(spark, folder)).select("element_id", "doc", "page_number", "missing")


def number_levels(spark: SparkSession, folder: str) -> DataFrame:
    return gates.number_levels(_all(spark, folder))


def coverage_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose body on its best tier lacks words that were extracted there."""
    current = ops.mark_best(ops.latest(planted.elements(spark, folder), spread=True))
    return gates.uncovered(gates.kept_words(current, "best"))


def ragged_tables(spark: SparkSession, folder: str) -> DataFrame:
    return gates.ragged_tables(_now(spark, folder))


def page_scores(spark: SparkSession, folder: str) -> DataFrame:
    return grades.page_scores(grades.current_grades(table(spark, folder, "grade_shards"))).select("doc", "page_number", "score")


def doc_scores(spark: SparkSession, folder: str) -> DataFrame:
    return grades.document_scores(grades.page_scores(grades.current_grades(table(spark, folder, "grade_shards"))))


def issue_pages(spark: SparkSession, folder: str) -> DataFrame:
    return grades.issue_pages(grades.current_grades(table(spark, folder, "grade_shards")))


def ungraded_pages(spark: SparkSession, folder: str) -> DataFrame:
    return gates.empty_pages(table(spark, folder, "elements").filter("doc is not null"), table(spark, folder, "grade_shards").filter("doc is not null"))


def grader_recall(spark: SparkSession, folder: str) -> DataFrame:
    """How many reasons of escalated pages the pages' grades name."""
    queue = table(spark, folder, "doc_queue").select("doc", F.explode("escalated_pages").alias("page_number", "e")).select("doc", "page_number", F.col("e.reason").alias("issue")).filter("issue is not null")
    given = table(spark, folder, "grade_shards").select("doc", "page_number", F.explode("issues").alias("issue"))
    return grades.recall(queue, given)


def run_report(spark: SparkSession, folder: str) -> DataFrame:
    """Pages, elements, images and tables by document and tier, with totals."""
    is_ = lambda t: F.count_if(F.col("type") == t)
    df = _now(spark, folder).rollup("doc", "tier").agg(F.countDistinct("doc", "page_number").alias("pages"), F.count(F.lit(1)).alias("elements"), is_("image").alias("images"), is_("table").alias("tables"), F.grouping_id().alias("total"))
    return df.withColumn("total", F.col("total").cast("int"))


def score_floors(spark: SparkSession, folder: str) -> DataFrame:
    """Corpus rows whose document scored below their floor for text."""
    scores = doc_scores(spark, folder).select("doc", "score")
    floors = table(spark, folder, "corpus").select("corpus_id", "doc", F.col("floor.text").alias("least"))
    return floors.join(scores, "doc").filter("score < least").select("corpus_id", "doc", "score", "least")


def cell_f1(spark: SparkSession, folder: str) -> DataFrame:
    return grades.cell_f1(first(spark, folder), _now(spark, folder))


def missing_words(spark: SparkSession, folder: str) -> DataFrame:
    return grades.missing_words(gates.page_words(first(spark, folder, planted.elements(spark, folder))), gates.page_words(_all(spark, folder)))


def dropped_units(spark: SparkSession, folder: str) -> DataFrame:
    return grades.dropped_units(first(spark, folder, planted.elements(spark, folder)).filter("text is not null"), _all(spark, folder))


def headings_missing(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "toc_entries").select("doc", heading_key(F.when(F.col("number").isNull(), F.col("title")).otherwise(F.concat("number", F.lit(" "), "title"))).alias("key"), "level")
    h = _now(spark, folder).filter("type = 'heading'").select("doc", heading_key(F.col("text")).alias("key"), "level")
    return grades.headings_missing(e, h)


def sequence_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of the first and the last text of elements that were extracted again."""
    a = first(spark, folder).select("doc", "page_number", "seq", F.col("text").alias("a"), F.col("element_id").alias("first_id"))
    b = _now(spark, folder).select("doc", "page_number", "seq", F.col("text").alias("b"), "element_id")
    return grades.sequence_ratio(a.join(b, ["doc", "page_number", "seq"]).filter("first_id <> element_id"), "element_id", "a", "b")


def _sized(df: DataFrame) -> DataFrame:
    b = F.col("bbox")
    return df.withColumn("size", F.round(geometry.y1(b) - geometry.y0(b), 1)).withColumn("weight", F.length(F.coalesce("text", F.lit(""))).cast("bigint"))


def body_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return layout.body_size(_sized(_now(spark, folder)).filter("size is not null"), "size", "weight")


def size_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return layout.size_ranks(_sized(_now(spark, folder)).filter("type = 'heading'"), "size")


def indent_levels(spark: SparkSession, folder: str) -> DataFrame:
    return layout.x_levels(_now(spark, folder).filter("type = 'list_item'").select("doc", geometry.x0(F.col("bbox")).alias("x")))


def lines_in_regions(spark: SparkSession, folder: str) -> DataFrame:
    df = _now(spark, folder).filter("size(bbox) = 4")
    return layout.inside_regions(df.filter("type <> 'image'"), df.filter("type = 'image'"))


def nearest_texts(spark: SparkSession, folder: str) -> DataFrame:
    df = _now(spark, folder).filter("size(bbox) = 4")
    return layout.nearest_text(df.filter("type = 'image'"), df.filter("type = 'paragraph'"))


def box_components(spark: SparkSession, folder: str) -> DataFrame:
    return layout.box_components(_now(spark, folder).filter("type in ('image', 'table')"))


def start_levels(spark: SparkSession, folder: str) -> DataFrame:
    return layout.start_levels(table(spark, folder, "elements").filter("doc is not null"), table(spark, folder, "toc_entries"))


FIRST = LATEST.replace("latest as", "earliest as").replace("extracted_at desc nulls last, element_id desc", "extracted_at asc nulls first, element_id")
_TLINES = "b as (select doc_id as doc, unnest(string_split(text, chr(10) || chr(10))) as block, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) as page_number from documents where text is not null), tl as (select doc, page_number, unnest(string_split(block, chr(10))) as line, generate_subscripts(string_split(block, chr(10)), 1) - 1 as line_no from b)"
_ENTRY = heading_key_sql("case when number is null then title else number || ' ' || title end")


def _words(name: str, source: str) -> str:
    return rf"{name} as (select doc, page_number, word, count(*) as n from (select doc, page_number, unnest(regexp_extract_all(lower(concat_ws(' ', text, caption, figure_text, array_to_string(flatten(rows), ' '))), '\p{{L}}{{4,}}')) as word from {source}) group by all)"


_TIERS = """ranked as (select *, case tier when 'vision' then 1 when 'ocr' then 2 when 'text' then 3 else 9 end as r from latest),
  best as (select * from (select *, min(case when type <> 'image' then r end) over (partition by doc, page_number) as m from ranked) where type = 'image' or r = m)"""
_GRADES = """g as (select * from (select *, row_number() over (partition by doc, page_number order by graded_at desc nulls last, shard_id desc) as _n from grade_shards where doc is not null) where _n = 1),
  s as (select doc, page_number, issues, round(greatest(0.0, 1 - 0.3 * len(list_distinct(coalesce(issues, [])))), 3) as score from g)"""
_DOCS = f"with {_GRADES} select doc, round(avg(score), 3) as score, count(*) as pages, array_to_string(list_sort(list_distinct(flatten(list(coalesce(issues, []))))), ',') as issues from s group by doc"
_AREA = "(greatest(0.0, {0}[3] - {0}[1]) * greatest(0.0, {0}[4] - {0}[2]))"
_TPAGES = rf"""p as (select doc, page_number, count(*) filter (where regexp_matches(trim(line), '{toc.LEADER_END}')) as leaders, count(*) filter (where regexp_matches(trim(line), '{toc.BARE}')) as bare, count(*) as n from tl where page_number <= 20 and trim(line) <> '' group by doc, page_number),
  pf as (select *, min(case when leaders >= {_BLOCK_LEADERS} then page_number end) over (partition by doc) as first from p), pr as (select *, row_number() over (partition by doc order by page_number) as k from pf where page_number >= first),
  po as (select *, (leaders >= {_BLOCK_LEADERS} or (leaders >= 3 and (leaders + bare) / n >= 0.3)) and page_number = first + k - 1 as ok from pr),
  pages as (select doc, page_number, leaders from (select *, max(case when ok then 0 else 1 end) over (partition by doc order by page_number) as broken from po) where broken = 0)"""
SQL = {
    "toc_entries_printed": rf"""with {_TLINES}, l as (select *, regexp_extract(line, '{toc.LEADER_LINE}', 1) as title_part, try_cast(regexp_extract(line, '{toc.LEADER_LINE}', 2) as int) as page from tl where regexp_matches(line, '{toc.LEADER_END}')),
  n as (select *, nullif(regexp_extract(trim(title_part), '^(\d+(?:\.\d+)*\.?)\s+(.+)$', 1), '') as number from l)
  select doc, page_number, line_no, number, trim(regexp_extract(trim(title_part), '^(\d+(?:\.\d+)*\.?)\s+(.+)$', 2)) as title, page, cast(len(string_split(rtrim(number, '.'), '.')) as int) as level from n where number is not null""",
    "toc_pages": rf"""with {_TLINES}, {_TPAGES} select doc, page_number, leaders from pages""",
    # Heights are unknown, so a closing is a leader or the last number of a title.
    "toc_parsed": rf"""with {_TLINES}, {_TPAGES},
  qa as (select tl.doc, tl.page_number, tl.line_no, trim(line) as s from tl join pages using (doc, page_number) where trim(line) <> ''),
  qb as (select *, row_number() over p as ln, regexp_matches(s, '{toc.LEADER_LINE}') as leader, trim(regexp_extract(s, '{toc.LEADER_LINE}', 1)) as lft, try_cast(regexp_extract(s, '{toc.LEADER_LINE}', 2) as int) as target from qa window p as (partition by doc, page_number order by line_no)),
  qc as (select *, case when leader then lft else s end as subject from qb),
  qd as (select *, case when regexp_matches(subject, '{toc.NUMBERED}') then regexp_extract(subject, '{toc.NUMBERED}', 1) when not leader and regexp_matches(s, '{toc.BARE}') then s end as number, case when regexp_matches(subject, '{toc.NUMBERED}') then trim(regexp_extract(subject, '{toc.NUMBERED}', 2)) end as title from qc),
  qw as (select x.*, (select arg_min(struct_pack(k := y.ln, t := y.target, l := y.lft), y.ln) from qd y where y.doc = x.doc and y.page_number = x.page_number and y.ln between x.ln + 1 and x.ln + 4 and (y.leader or y.number is not null)) as nxt from qd x),
  qe as (select *, case when leader and number is not null then struct_pack(title := title, page := target, k := 1)
    when not leader and number is not null and nxt is not null and (select leader and number is null from qd y where y.doc = w.doc and y.page_number = w.page_number and y.ln = w.nxt.k)
    then struct_pack(title := concat_ws(' ', title, (select string_agg(s, ' ' order by ln) from qd y where y.doc = w.doc and y.page_number = w.page_number and y.ln > w.ln and y.ln < w.nxt.k), nullif(nxt.l, '')), page := nxt.t, k := cast(nxt.k - ln + 1 as int)) end as fixed from qw w),
  qf as (select *, case when fixed is null and not leader and title is not null and regexp_matches(title, '{toc.TRAILING}') then try_cast(regexp_extract(title, '{toc.TRAILING}', 2) as int) end as last, count(fixed) over (partition by doc order by page_number, ln) as part from qe),
  qg as (select *, case when fixed is not null then fixed when last >= coalesce(max(coalesce(fixed.page, last)) over (partition by doc, part order by page_number, ln rows between unbounded preceding and 1 preceding), 0) then struct_pack(title := trim(regexp_extract(title, '{toc.TRAILING}', 1)), page := last, k := 1) end as entry from qf),
  qh as (select *, coalesce(max(ln + entry.k) over (partition by doc, page_number order by ln rows between 4 preceding and current row) > ln, false) as used from qg)
  select doc, case when entry is not null then number end as number, entry.title as title, entry.page as page, case when entry is not null then cast(len(string_split(rtrim(number, '.'), '.')) as int) end as level, case when entry is null then s end as unparsed
  from qh where entry is not null or (not used and ((leader and number is null) or (not leader and regexp_matches(number, '{toc.SECTION}') and regexp_matches(title, '{toc.LETTER}'))))""",
    "toc_missing": f"""with {LATEST}, e as (select entry_id, doc, {_ENTRY} as key from toc_entries), h as (select distinct doc, {heading_key_sql('text')} as key from latest where type = 'heading')
  select entry_id, doc, key from e where not exists (select 1 from h where h.doc = e.doc and h.key = e.key)""",
    "page_break_joins": rf"""with {LATEST}, body as (select * from latest where type <> 'image'),
  ends as (select doc, page_number, arg_min(element_id, seq) as fid, arg_max(element_id, seq) as lid, count(*) = 1 as single from body group by doc, page_number),
  p as (select e.*, f.type as ftype, f.text as ftext, f.bbox as fbox, l.type as ltype, l.text as ltext, l.bbox as lbox from ends e join body f on f.element_id = e.fid join body l on l.element_id = e.lid),
  n as (select *, lead(page_number) over w as np, lead(fid) over w as nid, lead(ftype) over w as ntype, lead(ftext) over w as ntext, lead(fbox) over w as nbox, lag(page_number) over w as pp from p window w as (partition by doc order by page_number)),
  a as (select *, coalesce(np = page_number + 1 and ltype in ('paragraph', 'list_item') and not regexp_matches(rtrim(coalesce(ltext, '')), '[.!?:;]$') and ntype = 'paragraph'
    and case when lbox is not null and nbox is not null then abs(nbox[1] - lbox[1]) <= 3.0 else regexp_matches(coalesce(ntext, ''), '^\p{{Ll}}') end, false) as able from n),
  c as (select *, able and single and coalesce(lag(able) over (partition by doc order by page_number), false) and coalesce(pp = page_number - 1, false) as chained from a),
  r as (select *, sum(case when chained then 0 else 1 end) over (partition by doc order by page_number) as run from c), k as (select *, row_number() over (partition by doc, run order by page_number) as k from r)
  select doc, page_number, lid as element_id, nid as joined_id, md5({join_sql('ltext', 'ntext')}) as digest from k where able and k % 2 = 1""",
    "empty_pages": "select distinct doc, page_number from grade_shards g where not exists (select 1 from elements e where e.doc = g.doc and e.page_number = g.page_number and type <> 'image') and doc is not null and page_number is not null",
    "orphan_captions": planted.sql(rf"""with {LATEST}, k as (select *, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as key, trim(regexp_replace(lower(caption), '\s+', ' ', 'g')) as ckey from latest)
  select element_id, doc, page_number, text from k where type = 'paragraph' and regexp_matches(trim(text), '(?i)^(figure|fig\.?|table)\s+\d+\.?:?(?:\s|$)') and not exists (select 1 from k i where i.type = 'image' and i.doc = k.doc and i.ckey = k.key and i.page_number - k.page_number in (0, 1))"""),
    "tables_as_figures": planted.sql(rf"with {LATEST} select element_id, doc, page_number, caption from latest where type = 'image' and regexp_matches(trim(caption), '(?i)^table\s+\d+\.?:?(\s|$)')"),
    "figures_incomplete": f"with {LATEST} select element_id, doc, page_number, 'caption or figure_text' as missing from latest where type = 'image' and trim(coalesce(caption, '')) = '' and trim(coalesce(figure_text, '')) = ''",
    "number_levels": planted.sql(rf"""with {LATEST}, d as (select *, cast(len(string_split(rtrim(nullif(regexp_extract(trim(text), '^(\d{{1,3}}(?:\.\d{{1,3}})*\.?)\s+.+$', 1), ''), '.'), '.')) as int) as depth from latest where type = 'heading')
  select element_id, doc, page_number, level, depth from d where depth <= 6 and (level is null or level <> depth)"""),
    "coverage_gate": planted.sql(f"""with {LATEST}, {_TIERS}, {_words('src', 'latest')}, {_words('outw', 'best')},
  both_ as (select coalesce(s.doc, o.doc) as doc, coalesce(s.page_number, o.page_number) as page_number, coalesce(s.word, o.word) as word, coalesce(s.n, 0) as src, coalesce(o.n, 0) as out_ from src s full join outw o on o.doc = s.doc and o.page_number = s.page_number and o.word = s.word),
  lent as (select doc, page_number, word, sum(spare) as lent from (select doc, word, greatest(out_ - src, 0) as spare, unnest([page_number - 1, page_number + 1]) as page_number from both_ where out_ > src) group by all),
  lack as (select b.doc, b.page_number, sum(greatest(src - out_ - coalesce(lent, 0), 0)) as missing, sum(src) as total from both_ b left join lent l on l.doc = b.doc and l.page_number = b.page_number and l.word = b.word where src > 0 group by all)
  select doc, page_number, cast(missing as bigint) as missing, cast(total as bigint) as total from lack where missing >= 3 and missing >= 0.05 * total"""),
    "ragged_tables": f"""with {LATEST}, r as (select element_id, doc, list_max(list_transform(rows, lambda r: len(r))) as widest, list_min(list_transform(rows, lambda r: len(r))) as narrowest, len(rows) as n_rows,
    len(list_filter(flatten(rows), lambda c: c is not null and trim(c) <> '')) / greatest(len(flatten(rows)), 1) as filled from latest where type = 'table' and len(rows) > 0) select * from r where widest <> narrowest""",
    "page_scores": f"with {_GRADES} select doc, page_number, score from s",
    "doc_scores": _DOCS,
    "issue_pages": f"with {_GRADES}, i as (select doc, page_number, unnest(list_distinct(issues)) as issue from s) select issue, count(*) as pages, count(distinct doc) as docs from i group by issue",
    "ungraded_pages": "select distinct doc, page_number from elements e where doc is not null and not exists (select 1 from grade_shards g where g.doc = e.doc and g.page_number = e.page_number)",
    "grader_recall": """with m as (select doc, unnest(map_entries(escalated_pages)) as e from doc_queue), x as (select distinct doc, e.key as page_number, e.value.reason as issue from m where e.value.reason is not null),
  g as (select distinct doc, page_number, unnest(issues) as issue from grade_shards)
  select x.issue, count(*) as expected, count(g.doc) as found, avg(case when g.doc is null then 0 else 1 end) as recall from x left join g on g.doc = x.doc and g.page_number = x.page_number and g.issue = x.issue group by x.issue""",
    "run_report": f"""with {LATEST} select doc, tier, count(distinct (doc, page_number)) as pages, count(*) as elements, count(*) filter (where type = 'image') as images, count(*) filter (where type = 'table') as tables, cast(grouping(doc, tier) as int) as total from latest group by rollup (doc, tier)""",
    "score_floors": f"with d as ({_DOCS}) select corpus_id, c.doc, score, c.floor.text as least from corpus c join d on d.doc = c.doc where score < c.floor.text",
    "cell_f1": f"""with {LATEST}, {FIRST}, a as (select doc, cell, count(*) as a from (select doc, unnest(flatten(rows)) as cell from earliest where type = 'table') where cell is not null group by all),
  b as (select doc, cell, count(*) as b from (select doc, unnest(flatten(rows)) as cell from latest where type = 'table') where cell is not null group by all),
  m as (select coalesce(a.doc, b.doc) as doc, coalesce(a, 0) as a, coalesce(b, 0) as b from a full join b on a.doc = b.doc and a.cell = b.cell)
  select doc, cast(sum(least(a, b)) as bigint) as both, 2 * sum(least(a, b)) / (sum(a) + sum(b)) as f1 from m group by doc""",
    # A chain goes on where a page opens with a table of as many columns between the same edges; one that is all of its page may go on again.
    "table_chains": planted.sql(f"""with {LATEST}, body as (select * from latest where type <> 'image'), e as (select doc, page_number, arg_min(element_id, seq) as a, arg_max(element_id, seq) as z, count(*) = 1 as single from body group by doc, page_number),
  p as (select e.doc, e.page_number, e.single, e.a, e.z, coalesce(f.type = 'table' and len(f.rows) > 0 and len(f.bbox) = 4, false) as fok, coalesce(l.type = 'table' and len(l.rows) > 0 and len(l.bbox) = 4, false) as lok, f.rows as frows, l.rows as lrows, f.bbox as fb, l.bbox as lb,
    list_max(list_transform(f.rows, lambda r: len(r))) as fw, list_max(list_transform(l.rows, lambda r: len(r))) as lw from e join body f on f.element_id = e.a join body l on l.element_id = e.z),
  n as (select *, coalesce(fok and lag(lok) over w and lag(page_number) over w = page_number - 1 and lag(lw) over w = fw and abs(lag(lb[1]) over w - fb[1]) <= {page_breaks.X_TOLERANCE} and abs(lag(lb[3]) over w - fb[3]) <= {page_breaks.X_TOLERANCE}, false) as on_ from p window w as (partition by doc order by page_number)),
  o as (select *, on_ and coalesce(lag(not on_ or single) over (partition by doc order by page_number), true) as goes from n),
  g as (select *, sum(case when goes then 0 else 1 end) over (partition by doc order by page_number) as run from o)
  select doc, arg_min(z, page_number) as element_id, list(case when goes then a else z end order by page_number) as parts,
    cast(sum(len(frows)) - sum(case when goes then 1 else 0 end) as bigint) as rows from g group by doc, run having count(*) > 1"""),
    "missing_words": planted.sql(f"""with {LATEST}, {FIRST}, {_words('src', 'earliest')}, {_words('outw', 'latest')}, l as (select s.* from src s left join outw o on o.doc = s.doc and o.page_number = s.page_number and o.word = s.word where o.doc is null)
  select doc, page_number, count(*) as missing, array_to_string(list_sort(list(word))[1:8], ',') as first from l group by doc, page_number"""),
    "dropped_units": planted.sql(rf"""with {LATEST}, {FIRST}, p as (select doc, page_number, trim(regexp_replace(lower(string_agg(text, ' ' order by seq, element_id)), '\s+', ' ', 'g')) as page from latest where text is not null group by doc, page_number),
  u as (select *, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as unit from earliest where text is not null)
  select element_id, u.doc, u.page_number from u left join p on p.doc = u.doc and p.page_number = u.page_number where length(unit) >= 15 and (page is null or not contains(page, unit))"""),
    "headings_missing": f"with {LATEST} select doc, {_ENTRY} as key, level from toc_entries except all select doc, {heading_key_sql('text')} as key, level from latest where type = 'heading'",
    "body_sizes": f"with {LATEST}, z as (select doc, round(bbox[4] - bbox[2], 1) as size, length(text) as n from latest where text is not null and bbox is not null), x as (select doc, size, unnest(range(n)) as i from z) select doc, median(size) as body_size from x group by doc",
    "size_ranks": f"with {LATEST}, z as (select distinct doc, round(bbox[4] - bbox[2], 1) as size from latest where type = 'heading' and bbox is not null) select doc, size, least(dense_rank() over (partition by doc order by size desc), 6) as level from z",
    "lines_in_regions": f"""with {LATEST}, b as (select * from latest where len(bbox) = 4), m as (select l.element_id, r.element_id as region_id,
    case when {_AREA.format('l.bbox')} > 0 then greatest(0.0, least(l.bbox[3], r.bbox[3]) - greatest(l.bbox[1], r.bbox[1])) * greatest(0.0, least(l.bbox[4], r.bbox[4]) - greatest(l.bbox[2], r.bbox[2])) / {_AREA.format('l.bbox')} else 0.0 end as ratio
    from b l join b r on r.doc = l.doc and r.page_number = l.page_number and r.type = 'image' and l.type <> 'image') select * from m where ratio > 0.5""",
    "nearest_texts": f"""with {LATEST}, b as (select * from latest where len(bbox) = 4), m as (select i.element_id as image_id, t.element_id, t.bbox[2] - i.bbox[4] as below, i.bbox[2] - t.bbox[4] as above
    from b i join b t on t.doc = i.doc and t.page_number = i.page_number and i.type = 'image' and t.type = 'paragraph' where least(i.bbox[3], t.bbox[3]) > greatest(i.bbox[1], t.bbox[1])),
  s as (select image_id, element_id, case when below between 0 and 60 then 'below' when above between 0 and 60 then 'above' end as side, case when below between 0 and 60 then below else above end as distance from m),
  r as (select *, row_number() over (partition by image_id order by side desc, distance, element_id) as k from s where side is not null) select image_id, element_id, side, distance from r where k = 1""",
    "start_levels": """with p as (select distinct doc, page_number from elements where doc is not null)
  select p.doc, p.page_number, (select arg_max(level, (t.page, t.entry_id)) from toc_entries t where t.doc = p.doc and t.page < p.page_number) as level from p""",
}
QUERIES = {
    q.__name__: q
    for q in (toc_entries_printed, toc_pages, toc_parsed, toc_matches, toc_missing, page_break_joins, table_chains, empty_pages, confidence_floor, large_regions, orphan_captions, tables_as_figures, figures_incomplete, number_levels, coverage_gate, ragged_tables, page_scores, doc_scores, issue_pages, ungraded_pages, grader_recall, run_report, score_floors, cell_f1, missing_words, dropped_units, headings_missing, sequence_ratio, body_sizes, size_ranks, indent_levels, lines_in_regions, nearest_texts, box_components, start_levels)
}
