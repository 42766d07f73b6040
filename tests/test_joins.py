import pytest

from quire.operators.joins import join_small


@pytest.mark.parametrize("limit", [0, 100])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_same_as_a_plain_join(spark, limit, how):
    df = spark.createDataFrame([(i % 3 if i else None, i) for i in range(200)], "k int, v int")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (9, "c")], "k int, w string")
    got = join_small(df, small, "k", how, limit)
    want = df.join(small, "k", how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert join_small(df.limit(0), small, "k", how, limit).collect() == []
