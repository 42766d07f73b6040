import json
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators.nested import flat_rows, flat_tables
from quire.operators.structural import index


def places(spark, payloads, **more):
    rows = [(i, p) for i, p in enumerate(payloads)]
    df = flat_rows(spark.createDataFrame(rows, "record_id bigint, payload string"), values=False)
    return sorted(tuple(r) for r in df.collect())


def strict(text):
    def refuse(_):
        raise ValueError

    try:
        json.loads(text, parse_constant=refuse)
        return True
    except ValueError:
        return False


VALUES = st.recursive(
    st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(),
    lambda v: st.lists(v) | st.dictionaries(st.text(), v),
    max_leaves=12,
)


@settings(max_examples=150, deadline=None)
@given(st.lists(VALUES, min_size=1, max_size=4), st.booleans(), st.randoms())
def test_validity_agrees_with_a_parser_on_damaged_texts(values, ascii_only, rnd):
    texts = []
    for v in values:
        t = json.dumps(v, ensure_ascii=ascii_only, indent=rnd.choice([None, 1]))
        texts.append(t)
        if t:
            i = rnd.randrange(len(t))
            texts.append(t[:i])
            texts.append(t[:i] + rnd.choice('{}[],:"\\ 0a\n') + t[i + 1 :])
            texts.append(t[:i] + rnd.choice('{}[],:"\\ 0-e') + t[i:])
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    nodes, good = index([t.encode() for t in texts])
    assert [bool(g) for g in good] == [strict(t) for t in texts]
    for i, t in enumerate(texts):
        if good[i]:
            root = int(np.flatnonzero((nodes.text == i) & (nodes.parent == -1))[0])
            got = json.loads(t)
            assert (json.loads(nodes.raw(root)) == got) if not isinstance(got, str) else nodes.string(root) == got


def test_layouts(spark):
    page = {"page_number": "3", "elements": [{"rows": [["a", None, ""], None, {"cells": ["x"]}]}, None, {"rows": ["p", "q"], "data_table": [[1]]}], "excluded_regions": {"bbox": [1, 2, 3, 4]}}
    want = [("cell", 3, 1, 1, 1), ("cell", 3, 1, 1, 3), ("cell", 3, 1, 3, 1), ("cell", 3, 3, 1, 1), ("cell", 3, 3, 1, 2), ("element", 3, 1, 0, 0), ("element", 3, 3, 0, 0), ("page", 3, 0, 0, 0), ("region", 3, 1, 0, 0)]
    bare = {k: v for k, v in page.items() if k != "page_number"}
    camel = {"pageNumber": 3, "elements": json.dumps(page["elements"]), "excludedRegions": [page["excluded_regions"]]}
    forms = [{"pages": [page]}, {"pages": {"3": bare}}, {"pages": page}, {"document": {"pages": [camel]}}, {"pages": json.dumps([page])}]
    got = places(spark, [json.dumps(f) for f in forms])
    for i in range(len(forms)):
        assert [r[1:] for r in got if r[0] == i] == want, forms[i]


def test_rows_as_text_and_lone_lists(spark):
    text = {"pages": [{"elements": [{"type": "table", "rows": json.dumps([["a"], ["b", None]])}, {"rows": [None, "x", 1.5]}, {"rows": None}, {"rows": []}, "plain", ""]}]}
    got = [r[1:] for r in places(spark, [json.dumps(text)])]
    assert [r for r in got if r[0] == "cell"] == [("cell", 1, 1, 1, 1), ("cell", 1, 1, 2, 1), ("cell", 1, 2, 1, 2), ("cell", 1, 2, 1, 3)]
    assert len([r for r in got if r[0] == "element"]) == 6


def test_nothing_from_unusable_payloads(spark):
    assert places(spark, [None, "", " ", "{", '{"pages": [', "[]", "null", "3", '{"pages": null}', '{"pages": [null]}', '{"other": 1}', "{'pages': []}", '{"pages": [NaN]}']) == []
    assert places(spark, []) == []


def test_repeats_ids_and_other_columns(spark):
    p = '{"pages": [{"elements": [{}]}]}'
    df = spark.createDataFrame([(1, p, "k", 9), (1, p, "k", 9), (None, p, "k", 9)], "record_id bigint, payload string, kind string, page_no int")
    rows = [tuple(r) for r in flat_rows(df, values=False).collect()]
    assert rows.count((1, "page", 1, 0, 0, 0)) == 2 and rows.count((None, "element", 1, 1, 0, 0)) == 1


def test_long_text_and_many_blocks(spark):
    big = json.dumps({"pages": [{"elements": [{"text": "x\\\"{[" * 200_000, "rows": [["c"] * 500] * 40}]}]})
    got = places(spark, [big, big])
    assert len(got) == 2 * (1 + 1 + 20_000)


def test_tables_link_parents(spark):
    rnd = random.Random(1)
    texts = []
    for _ in range(20):
        pages = [{"page_number": n, "elements": [{"type": "Table", "level": "2", "bbox": rnd.choice([[1, 2, 3, 4], "1 2 3 4", {"x0": 1, "y0": 2, "x1": 3, "y1": 4}, None, [1]]), "rows": [["é\n", 2]]}], "excluded_regions": [{"reason": "r", "count": 1}]} for n in (1, 2)]
        texts.append(json.dumps({"pages": pages}))
    t = flat_tables(spark.createDataFrame(list(enumerate(texts)), "record_id bigint, payload string"))
    e = t["element"].join(t["page"].select("record_id", "page_no", t["page"].row_id.alias("page_id")), ["record_id", "page_id", "page_no"])
    assert e.count() == 40
    c = t["cell"].withColumnRenamed("row_id", "cell_id").join(t["element"].select("record_id", t["element"].row_id.alias("element_id")), ["record_id", "element_id"]).collect()
    assert len(c) == 80 and {r.value for r in c} == {"é\n", "2"}
    boxes = {tuple(r.bbox) if r.bbox else None for r in e.select("bbox").collect()}
    assert boxes <= {(1.0, 2.0, 3.0, 4.0), None}
    assert {(r.reason, r["count"]) for r in t["region"].collect()} == {("r", 1)}
