"""The queries that have SQL give the rows of their SQL, and all of them run."""

import pytest
from oracle import compare, connect

from quire.llm import queries

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    assert compare(spark, connect(FOLDER), QUERIES[name], SQL[name], FOLDER) is None


#: Columns and the least number of rows of the queries without SQL; what they hold is tested by operator.
SHAPES = {
    "p2_found": ("entry_id element_id", 1),
    "p2_forms": ("kind id form changed", 1000),
    "p3_found": ("element_id", 5),
    "p3_restored": ("element_id restored complete", 5),
    "p4_bands": ("doc bytes ratio chunk_ratio band", 30),
    "p5_found": ("scope item_id lang", 5),
    "p5_labels": ("corpus_id doc label lang confidence", 30),
    "p5_segments": ("element_id doc lang confidence", 1),
    "p6_packed": ("spec_id doc_id piece start tokens container", 300),
    "p6_fill": ("spec_id capacity_tokens containers items tokens fullest used", 3),
    "p7_mixture": ("source doc_id epoch tokens", 30),
    "p7_shares": ("source target_weight max_repeats texts available budget taken_texts taken most_repeats actual_share share_of_total missing", 33),
    "p7_fitting": ("source target_weight max_repeats texts available budget taken_texts taken most_repeats actual_share share_of_total missing", 33),
    "p8_found": ("doc_id", 1),
    "p8_labels": ("doc_id prose link_list tag_list menu apparatus words spam_share", 90),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    columns, least = SHAPES[name]
    df = QUERIES[name](spark, FOLDER)
    assert df.columns == columns.split()
    rows = df.collect()
    assert len(rows) >= least
    if name in ("p3_found", "p3_restored", "p8_found", "p8_labels", "p4_bands"):  # ids are unique in the tables
        assert len({r[0] for r in rows}) == len(rows)


def test_mixture_at_the_fitting_total_has_its_shares(spark):
    """Of the sources with texts, each has its share but for half of a text."""
    rows = [r for r in QUERIES["p7_fitting"](spark, "/root/testdata/sf0.01").collect() if r.available > 0 and r.target_weight > 0]
    assert rows and all(r.most_repeats <= r.max_repeats and r.missing <= max(r.available / r.texts * 20, 1) for r in rows)
