import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.packing import fill, pack, plan
from quire.llm.ranks import running


def containers(p, counts):
    """Contents of every container of a plan; each item exactly once."""
    seen, content = Counter(), defaultdict(list)
    rows = sorted(p.rows)
    for size, n in counts.items():
        mine = [r for r in rows if r[0] == size]
        for rank in range(n):
            r = [m for m in mine if m[1] <= rank][-1]
            content[r[3] + (rank - r[1]) // r[2]].append(size)
            seen[size] += 1
    assert seen == Counter({s: n for s, n in counts.items() if n})
    return content


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 60), st.data())
def test_plans_hold_and_are_tight(capacity, data):
    counts = data.draw(st.dictionaries(st.integers(0, capacity), st.integers(0, 40), max_size=20))
    content = containers(plan(counts, capacity), counts)
    loads = [sum(c) for c in content.values()]
    assert all(x <= capacity for x in loads)
    assert sorted(content) == list(range(len(content)))
    assert all(sum(3 * s > capacity for s in c) <= 2 for c in content.values())
    total = sum(s * n for s, n in counts.items())
    # no two containers could be one, and no worse than first-fit's known factor
    assert sum(x <= capacity / 2 for x in loads if x) <= 1 + (total == 0) or sorted(loads)[0] + sorted(loads)[1] > capacity
    assert len([x for x in loads if x]) <= 1.7 * (total / capacity) + 1 or len(loads) <= sum(n for s, n in counts.items() if 2 * s > capacity) + 1 + 1.7 * total / capacity


def test_pack(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([0, 1, 5, 40, 99, 100, 101, 250, 1037, rnd.randrange(1, 120)]), "x") for i in range(3000)] + [(7, 50, "x")] * 3
    specs = spark.createDataFrame([(1, 100), (2, 1000), (3, 0), (None, 10)], "spec_id int, capacity_tokens int")
    sizes = spark.createDataFrame(rows, "doc_id bigint, tokens bigint, container string")
    got = pack(sizes, specs).collect()
    for spec, capacity in ((1, 100), (2, 1000)):
        mine = [r for r in got if r.spec_id == spec]
        loads = Counter()
        whole = Counter()
        for r in mine:
            loads[r.container] += r.tokens
            whole[r.doc_id] += r.tokens
            assert r.start == r.piece * capacity
        assert max(loads.values()) <= capacity
        want = Counter()
        for i, t, _ in rows:
            want[i] += t
        assert whole == want
        assert all(r.piece == 0 for r in mine if r.doc_id not in {i for i, t, _ in rows if t > capacity})
        assert sum(t for _, t, _ in rows) / (capacity * len(loads)) > 0.95
    f = {r.spec_id: r for r in fill(pack(sizes, specs), specs).collect()}
    assert f[1].fullest == 100 and 0.95 < f[1].used <= 1
    assert pack(sizes.limit(0), specs).collect() == [] and pack(sizes, specs.limit(0)).collect() == []


def test_running_sums_over_ranges(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("aab"), rnd.randrange(-(2**63), 2**63) if rnd.random() < 0.9 else 5, i, rnd.randrange(9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, k bigint, i int, v bigint")
    for ranges in (1, 2, 16):
        got = {r.i: r.before for r in running(df, ["g"], "k", "v", ranges, ["i"]).collect()}
        for g in "ab":
            total = 0
            for _, k, i, v in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
                assert got[i] == total
                total += v
