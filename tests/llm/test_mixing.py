from collections import Counter

from quire.llm.mixing import fitting_total, mix
from quire.llm.sizes import FOLDER, VOCABULARY, count_tokens, token_sizes

W = "source string, target_weight double, max_repeats int"
S = "doc_id bigint, source string, tokens bigint, epoch string"


def test_shares_caps_and_repeats(spark):
    rows = [(i, "big", 10 + i % 7, "") for i in range(3000)] + [(5000 + i, "small", 20, "") for i in range(50)] + [(6000 + i, "tiny", 3, "") for i in range(4)] + [(7000 + i, "none", 9, "") for i in range(100)] + [(8000, None, 9, ""), (8001, "big", 0, ""), (9000, "unlisted", 9, "")]
    weights = [("big", 0.5, 2), ("small", 0.3, 4), ("tiny", 0.1, 3), ("absent", 0.1, 2), ("none", 0.0, 9), ("none", 0.0, 9), (None, 0.5, 1)]
    mixture, report = mix(spark.createDataFrame(rows, S), spark.createDataFrame(weights, W), total=10_000)
    taken = mixture.collect()
    times, size = Counter(), Counter()
    for r in taken:
        times[r.doc_id] += 1
        size[r.source] += r.tokens
    tokens = {i: t for i, _, t, _ in rows}
    assert all(tokens[r.doc_id] == r.tokens for r in taken)
    assert len({(r.doc_id, r.epoch) for r in taken}) == len(taken)
    assert abs(size["big"] - 5000) <= 8 and abs(size["small"] - 3000) <= 10 and size["tiny"] == 4 * 3 * 3
    assert set(size) == {"big", "small", "tiny"}
    assert max(times[i] for i in times if i < 3000) == 1 and set(times[i] for i in times if 6000 <= i < 6004) == {3}
    assert {times[5000 + i] for i in range(50)} <= {2, 3, 4}
    rep = {r.source: r for r in report.collect()}
    assert set(rep) == {"big", "small", "tiny", "absent", "none"}
    whole = sum(size.values())
    for s, r in rep.items():
        assert r.taken == size[s] and abs(r.actual_share - size[s] / whole) < 1e-12
    assert rep["absent"].missing == 1000 and rep["tiny"].missing == 1000 - 36 and rep["tiny"].most_repeats == 3


def test_largest_total_that_fits(spark):
    sizes = spark.createDataFrame([(i, "a", 10, "") for i in range(100)] + [(200 + i, "b", 10, "") for i in range(10)], S)
    weights = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 2), ("none", 0.1, 1)], W)
    assert fitting_total(sizes, weights) == 666
    loose = fitting_total(sizes, weights, 0.1)
    assert loose == 1000
    _, report = mix(sizes, weights, 666)
    got = {r.source: (r.share_of_total, r.missing) for r in report.collect()}
    assert abs(got["a"][0] - 0.6) < 0.01 and abs(got["b"][0] - 0.3) < 0.01 and got["none"] == (0.0, 67)
    assert fitting_total(sizes.limit(0), weights) == 0


def test_nothing(spark):
    empty = spark.createDataFrame([], S)
    mixture, report = mix(empty, spark.createDataFrame([("a", 1.0, None)], W))
    assert mixture.collect() == [] and [r.taken for r in report.collect()] == [0]
    mixture, report = mix(spark.createDataFrame([(1, "a", 5, ""), (1, "a", 5, "")], S), spark.createDataFrame([], W))
    assert mixture.collect() == [] and report.collect() == []
    mixture, _ = mix(spark.createDataFrame([(1, "a", 5, ""), (1, "a", 5, "")], S), spark.createDataFrame([("a", 1.0, None)], W))
    assert len(mixture.collect()) == 2


def test_sizes(spark):
    path = f"{FOLDER}/{VOCABULARY}"
    texts = ["", "The pump.", "Прокладка <|endoftext|>", "a" * 50_000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.tokens for r in token_sizes(df, "text", ["doc_id"]).collect()}
    assert got == {i: count_tokens(t, path) for i, t in enumerate(texts) if t is not None}
    assert got[0] == 0 and got[1] == 3
