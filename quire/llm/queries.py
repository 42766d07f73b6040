"""Queries of the training-text operators. Most have no SQL: see tests/llm for what they are tested on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import forms, garble, languages, mixing, packing, repeats, sizes, stuffing
from quire.session import cut
from quire.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Contents entries and headings of one document that read the same but are stored differently."""
    toc = table(spark, folder, "toc_entries")
    line = F.when(F.col("number").isNull(), F.col("title")).otherwise(F.concat("number", F.lit(" "), "title"))
    entries = toc.select("doc", "entry_id", line.alias("line"))
    headings = table(spark, folder, "elements").filter(F.col("type") == "heading").select("doc", "element_id", "text")
    return forms.same_reading(entries, headings, "doc", "entry_id", "element_id", "line", "text")


def p2_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every title and every element's text."""
    toc = table(spark, folder, "toc_entries").select(F.lit("toc").alias("kind"), F.col("entry_id").alias("id"), F.col("title").alias("text"))
    elements = table(spark, folder, "elements").select(F.lit("element").alias("kind"), F.col("element_id").alias("id"), "text")
    both = toc.unionAll(elements).filter(F.col("text").isNotNull())
    return both.withColumn("form", forms.consistent_form(F.col("text"))).select("kind", "id", "form", (F.col("form") != F.col("text")).alias("changed"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Elements whose text holds characters of a wrong decoding."""
    return garble.garbled(table(spark, folder, "elements"), "element_id", "text")


def p3_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The same elements with their original text as far as it can be had."""
    return garble.restored(table(spark, folder, "elements"), "element_id", "text")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in which more than a quarter of the words are repeated."""
    return repeats.repetition(table(spark, folder, "elements")).filter(F.col("share") > 0.25).select("doc")


def p4_share(spark: SparkSession, folder: str) -> DataFrame:
    """Words and exact share of repeated words of every document."""
    return repeats.repetition(table(spark, folder, "elements"), measure_all=True).select("doc", "words", "share")


def p4_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Compression ratios and band of every document."""
    return repeats.repetition(table(spark, folder, "elements")).select("doc", "bytes", "ratio", "chunk_ratio", "band")


def _judged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return languages.judged(table(spark, folder, "elements"), table(spark, folder, "corpus"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Wrong or missing labels with the true language, and elements with a foreign sentence."""
    labels, segments = _judged(spark, folder)
    wrong = labels.filter(F.col("label").isNull() | (F.col("label") != F.col("lang")))
    return wrong.select(F.lit("label").alias("scope"), F.col("corpus_id").alias("item_id"), "lang").unionAll(segments.select(F.lit("segment"), "element_id", "lang"))


def p5_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document of the corpus, with confidence, beside its label."""
    return _judged(spark, folder)[0]


def p5_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every passage in another language than its document's, with confidence."""
    return _judged(spark, folder)[1]


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    return sizes.token_sizes(table(spark, folder, "documents"), "text", ["doc_id", "source"])


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every text, or piece of one above the capacity, for each capacity."""
    return packing.pack(_sizes(spark, folder), table(spark, folder, "pack_specs"))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return packing.fill(p6_packed(spark, folder), table(spark, folder, "pack_specs"))


def p6_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of each capacity, and how many are lost, split without need, or in containers that are overfull or hold too many large ones."""
    documents, specs = cut(_sizes(spark, folder)), table(spark, folder, "pack_specs")
    return packing.checks(packing.pack(documents, specs), documents, specs)


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of the mixture, once for each time that it is taken."""
    return mixing.mix(_sizes(spark, folder), table(spark, folder, "source_weights"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The actual share of each source in the mixture beside its target."""
    return mixing.mix(_sizes(spark, folder), table(spark, folder, "source_weights"))[1]


def p7_fitting(spark: SparkSession, folder: str) -> DataFrame:
    """The shares at the largest total at which no source with texts lacks any for its cap."""
    documents, weights = cut(_sizes(spark, folder)), table(spark, folder, "source_weights")
    return mixing.mix(documents, weights, mixing.fitting_total(documents, weights))[1]


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a source has a text too often, or misses its budget though its cap allows more."""
    documents = cut(_sizes(spark, folder))
    return mixing.checks(*mixing.mix(documents, table(spark, folder, "source_weights")), documents)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents most of whose words lie in link lists, tag lists and menus."""
    return stuffing.labelled(table(spark, folder, "documents"), "doc_id", "text").filter("spam_share > 0.5").select("doc_id")


def p8_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document by the label of their line."""
    return stuffing.labelled(table(spark, folder, "documents"), "doc_id", "text")


def queries() -> dict[str, Query]:
    every = (p2_found, p2_forms, p3_found, p3_restored, p4_found, p4_share, p4_bands, p5_found, p5_labels, p5_segments, p6_packed, p6_fill, p6_checks, p7_mixture, p7_shares, p7_fitting, p7_checks, p8_found, p8_labels)
    return {q.__name__: q for q in every}


#: Words and repeated words of every document, without bands: every run of twelve words.
_P4 = """with l as (select * from (select *, row_number() over (partition by doc, coalesce(page_number, 0), coalesce(seq, 0) order by extracted_at desc nulls last, element_id desc) as k from elements where doc is not null and text is not null) where k = 1),
w as (select doc, page_number, seq, unnest(regexp_extract_all(lower(text), '\\p{L}+')) as word, generate_subscripts(regexp_extract_all(lower(text), '\\p{L}+'), 1) as i from l),
n as (select doc, word, row_number() over (partition by doc order by coalesce(page_number, 0), coalesce(seq, 0), i) as pos from w),
g as (select doc, pos, string_agg(word, ' ') over r as run, count(*) over r as c from n window r as (partition by doc order by pos rows between current row and 11 following)),
f as (select doc, pos, c = 12 and pos > min(case when c = 12 then pos end) over (partition by doc, run) as again from g),
m as (select doc, max(case when again then pos end) over (partition by doc order by pos rows between 11 preceding and current row) is not null as marked from f),
t as (select doc, count(*) as words, count(*) filter (where marked) as repeated from m group by doc)
"""
_SQL = {
    "p4_found": _P4 + "select doc from t where repeated > 0.25 * words",
    # No text is lost, split without need or taken too often, and no container overfull.
    "p6_checks": "select spec_id, capacity_tokens, (select count(*) from documents where text is not null) as texts, 0 as lost, 0 as split, 0 as overfull, 0 as crowded from pack_specs",
    "p7_checks": "select distinct source, 0 as too_often, 0 as off from source_weights where source is not null",
    "p4_share": _P4 + "select d.doc, coalesce(words, 0) as words, coalesce(repeated / words, 0.0) as share from (select distinct doc from l) d left join t using (doc)",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
