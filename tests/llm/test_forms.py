import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import forms
from quire.llm.forms import consistent, consistent_form, same_reading


def test_each_kind_of_difference():
    same = [
        ("Ｃｏｏｌａｎｔ　１．２", "Coolant 1.2"),
        ("Kühlung", "Kühlung"),
        ("Kühlung", "Ku​̈h­lung"),
        ("Fault Finding", "Fault Finding"),
        ("pоsitiоn", "position"),
        ("Τermes", "Termes"),
        ("Раcxoд вoздуxа", "Расход воздуха"),
        ("приёмка", "приëмка"),
        ("ﬁlter oﬀ", "filter off"),
        ("kick‑off", "kick-off"),
        ("ĳzer", "ijzer"),
        ("о чём", "o чём"),
        ("Å", "Å"),
        ("ｅ́", "é"),
    ]
    for a, b in same:
        assert consistent(a) == consistent(b), (a, b)
    for a, b in [("Fault", "fault"), ("Resultats", "Résultats"), ("10", "l0"), ("a–b", "a-b"), ("второй", "второи"), ("m²", "m2"), ("note:", "note"), ("doesn’t", "doesn't")]:
        assert consistent(a) != consistent(b), (a, b)


def test_words_keep_their_script():
    assert consistent("Раcход воздуxа AH-227") == "Расход воздуха AH-227"
    assert consistent("сooling") == "cooling"
    assert consistent("Ω 3 µm") == "Ω 3 µm"


TEXT = st.text(st.sampled_from("aeoxсорхеѕνοΑTtТzйиé́̈̆   ​­͏-‐ａＥ１ﬁĳ1.ß\nжд"), max_size=20)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_one_pass_is_final_and_normal_forms_meet(text):
    once = consistent(text)
    assert consistent(once) == once
    assert consistent(unicodedata.normalize("NFD", text)) == consistent(unicodedata.normalize("NFC", text))


def test_rules_in_conflict_are_refused():
    machine = forms.Transducer("Latin")
    machine.rules = {"a": "b"}
    try:
        machine._add("a", "c")
    except ValueError:
        return
    raise AssertionError


def test_column(spark):
    df = spark.createDataFrame([(None,), ("",), ("ａ" * 200_000,)], "t string")
    assert [r[0] for r in df.select(consistent_form("t")).collect()] == [None, "", "a" * 200_000]
    assert df.limit(0).select(consistent_form("t")).collect() == []


def test_pairs(spark):
    left = spark.createDataFrame([(1, "d", "1 Cооling", 0), (2, "d", "1 Cooling", 0), (2, "d", "1 Cooling", 0), (3, "e", "1 Cooling", 0), (4, "d", None, 0), (5, None, "1 Cooling", 0)], "entry_id int, doc string, line string, text int")
    right = spark.createDataFrame([(7, "d", "1 Cooling", 1), (8, "d", "1 Cooling", 1), (8, "d", "1 Cooling", 1), (9, "d", "1 cooling", 1), (9, None, "1 Cooling", 1)], "element_id int, doc string, text string, line int")
    got = sorted(map(tuple, same_reading(left, right, "doc", "entry_id", "element_id", "line", "text").collect()))
    assert got == [(1, 7), (1, 8), (1, 8)] + [(2, 8)] * 4
    assert same_reading(left.limit(0), right, "doc", "entry_id", "element_id", "line", "text").collect() == []
