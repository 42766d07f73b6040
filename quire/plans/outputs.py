"""Queries on readers, writers, streams and defects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import WS
from quire.operators import elements as ops
from quire.operators.defects import DEFECTS
from quire.plans.structure import SQL as STRUCTURE
from quire.plans.texts import LATEST
from quire.session import checkpoint_dir, stored
from quire.sinks import bundles
from quire.sources import html
from quire.sources.tables import table
from quire.streaming import elements as streaming


def _now(spark: SparkSession, folder: str) -> DataFrame:
    return ops.latest(table(spark, folder, "elements"), spread=True)


def html_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written as HTML and read again."""
    read = html.read_html(bundles.page_html(_now(spark, folder)), ["doc", "page_number"], "html")
    text = F.when(F.col("type") == "table", F.size("rows").cast("string")).otherwise(F.col("text"))
    return read.filter("tag <> 'figcaption'").select("doc", "page_number", "tag", "level", text.alias("content"))


def html_triage(spark: SparkSession, folder: str) -> DataFrame:
    return html.triage(bundles.page_html(_now(spark, folder)), "html").select("doc", "page_number", "has_table", "image_count", "loop_size")


def html_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images of every page written as HTML and read again."""
    found = html.html_images(bundles.page_html(_now(spark, folder)), ["doc", "page_number"], "html")
    return found.select("doc", "page_number", "place", "ext", "path")


def jsonl_records(spark: SparkSession, folder: str) -> DataFrame:
    line = F.from_json("line", "id string, type string, heading_path array<string>, text string")
    df = bundles.jsonl_lines(_now(spark, folder)).withColumn("r", line)
    return df.select("doc", "page_number", "seq", "r.id", "r.type", F.array_join("r.heading_path", " > ").alias("path"), F.length("r.text").alias("chars"))


def bundle_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Files of each document's bundle: its sections and the index."""
    return bundles.bundle_files(_now(spark, folder)).groupBy("doc").agg(F.count(F.lit(1)).alias("files"))


def tree_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Files of each document's tree, all with different paths."""
    return bundles.tree_files(_now(spark, folder), 2).groupBy("doc").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("path").alias("paths"))


def output_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Characters of every whole-document output."""
    now = stored(_now(spark, folder))
    kinds = (bundles.markdown_files, bundles.html_files, bundles.jsonl_files, bundles.reqif_files)
    parts = [f(now).select("path", F.length("content").alias("chars")) for f in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stream_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Elements by day of extraction, counted as a stream over all files that are there."""
    import uuid

    source = table(spark, folder, "elements")
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{folder}/elements.parquet"
    stream = spark.readStream.schema(source.schema).parquet(path if not path.startswith("/") or _is_folder(spark, path) else f"{folder}/element[s].parquet")
    counts = streaming.window_counts(stream, "extracted_at")
    rows = counts.withColumn("day", F.date_format("start", "yyyy-MM-dd")).select("day", "type", "n")
    # All windows are written each time, so that late rows count as well.
    query = rows.writeStream.outputMode("complete").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{base}/out")).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def defect_effects(spark: SparkSession, folder: str) -> DataFrame:
    """Elements and characters before and after each defect."""
    now = stored(_now(spark, folder))
    sums = [F.count(F.lit(1)).alias("elements"), F.sum(F.length("text")).alias("chars"), F.sum("level").alias("levels"), F.sum(F.size("rows")).alias("table_rows")]
    out = now.agg(*sums).withColumn("defect", F.lit("none"))
    for name, defect in DEFECTS.items():
        out = out.unionByName(defect(now).agg(*sums).withColumn("defect", F.lit(name)))
    return out


_PLAIN = f"trim(regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g'))"
_PATHS = STRUCTURE["heading_path"].replace("select o.element_id, ", "select o.*, ").replace("as parent_id", "as parent_id", 1)
SQL = {
    "html_blocks": f"""with {LATEST}, t as (select doc, page_number, type, level, rows, {_PLAIN} as x from latest)
  select doc, page_number, case type when 'heading' then 'h' || least(greatest(coalesce(level, 1), 1), 6) when 'paragraph' then 'p' when 'list_item' then 'li' else 'table' end as tag,
    case when type = 'heading' then least(greatest(coalesce(level, 1), 1), 3) end as level, case when type = 'table' then cast(len(rows) as varchar) else x end as content
  from t where (type in ('heading', 'paragraph', 'list_item') and x <> '') or (type = 'table' and len(rows) > 0)""",
    "html_triage": f"""with {LATEST} select doc, page_number, bool_or(type = 'table') as has_table, cast(count(*) filter (where type = 'image') as int) as image_count, case when bool_or(type in ('table', 'image')) then 'tight' else 'loose' end as loop_size from latest group by doc, page_number""",
    "html_images": f"""with {LATEST}, i as (select doc, page_number, asset, row_number() over (partition by doc, page_number order by seq, element_id) as place from latest where type = 'image')
  select doc, page_number, cast(place as int) as place, regexp_extract(asset, '\\.([^./]*)$', 1) as ext, asset as path from i where asset is not null""",
    "jsonl_records": f"""select doc, page_number, seq, 'p' || page_number || '-' || row_number() over (partition by doc, page_number order by seq, element_id) as id, type, path, cast(length(nullif(text, '')) as int) as chars from ({_PATHS}) where coalesce(kind, '') <> 'furniture'""",
    "bundle_counts": STRUCTURE["h1_sections"].replace("select doc, section, title, elements, pages from t", "select doc, count(*) + 1 as files from t where title <> 'Front Matter' or elements > 0 group by doc"),
    "tree_counts": f"""with {LATEST}, s as (select *, sum(case when type = 'heading' and level <= 2 then 1 else 0 end) over (partition by doc order by page_number, seq rows unbounded preceding) as section from latest)
  select doc, count(distinct section) + 1 as files, count(distinct section) + 1 as paths from s group by doc""",
    "stream_counts": "select strftime(extracted_at, '%Y-%m-%d') as day, type, count(*) as n from elements where extracted_at is not null group by all",
}
QUERIES = {q.__name__: q for q in (html_blocks, html_triage, html_images, jsonl_records, bundle_counts, tree_counts, output_sizes, stream_counts, defect_effects)}
