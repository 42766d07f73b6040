"""Extractions as a stream: late rows, repeated rows, and the current row of each place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.operators.elements import latest
from quire.operators.scan import BLOCK_PAGES

#: Parts that the table of current rows is rewritten in.
BUCKETS = 64


def element_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def window_counts(stream: DataFrame, time: str, width: str = "1 day", late: str = "60 days") -> DataFrame:
    """Rows by window of ``time`` and type; rows later than ``late`` behind the newest are left out."""
    window = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(window.alias("w"), "type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "type", "n")


def first_deliveries(stream: DataFrame, time: str, late: str = "60 days") -> DataFrame:
    """Each ``element_id`` once, however often it is delivered within ``late``."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["element_id"])


def keep_latest(path: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the current row of each place, kept below ``path``.

    The table lies in buckets by document and block of pages. A batch rewrites only the buckets that it has
    rows of, in a folder of its own, and then writes which folder is current for each bucket. It reads what
    was current before it, so a batch that runs again gives the same; folders that neither the last nor the
    one before names are removed. Readers take the highest complete list with :func:`read_latest`.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _current(spark, path, number)
        batch = batch.persist()
        keyed = _bucketed(batch, buckets)
        changed = sorted(r[0] for r in keyed.select("_bucket").distinct().collect())  # at most the number of buckets
        old = [f"{path}/version={before[b]}/_bucket={b}" for b in changed if b in before]
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(*old)) if old else batch
        _bucketed(latest(rows), buckets).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/version={number}")
        now = before | dict.fromkeys(changed, number)
        spark.createDataFrame(sorted(now.items()), "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/current={number}")
        batch.unpersist()
        _remove(spark, path, {*before.values(), *now.values(), number}, number)

    return merge


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    block = F.floor(F.coalesce("page_number", F.lit(0)) / BLOCK_PAGES)
    return df.withColumn("_bucket", F.pmod(F.xxhash64("doc", block), F.lit(buckets)).cast("int"))


def _folders(spark: SparkSession, path: str, kind: str) -> dict[int, object]:
    """Numbers and paths of the complete folders of a kind."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return {}
    found = {int(s.getPath().getName().split("=")[1]): s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith(f"{kind}=")}
    return {n: p for n, p in found.items() if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}


def _current(spark: SparkSession, path: str, below: int | None = None) -> dict[int, int]:
    """The version of each bucket, by the last list or the last one before a batch."""
    lists = [n for n in _folders(spark, path, "current") if below is None or n < below]
    return {r.bucket: r.version for r in spark.read.parquet(f"{path}/current={max(lists)}").collect()} if lists else {}


def _remove(spark: SparkSession, path: str, kept: set[int], number: int) -> None:
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    lists = _folders(spark, path, "current")
    before = max((n for n in lists if n < number), default=number)
    for n, p in [*_folders(spark, path, "version").items(), *((n, p) for n, p in lists.items())]:
        if n < number and n not in (kept if p.getName().startswith("version") else {before}):
            fs.delete(p, True)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The table as the last complete batch left it; without any batch an error."""
    return spark.read.parquet(*[f"{path}/version={v}/_bucket={b}" for b, v in sorted(_current(spark, path).items())])
