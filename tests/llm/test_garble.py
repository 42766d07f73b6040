import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import garble
from quire.llm.garble import CHAINS, garbled, restored

WORDS = ["Prüfung", "Gehäuse", "größer", "résiste", "première", "doesn’t", "±", "µm", "°C", "“open", "zgłasza", "północnej", "протокол", "испытаний", "насос", "à"]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcäöüßéèàçñłąężśпротклиё’“±µ°–"), min_size=1, max_size=12), st.sampled_from(CHAINS))
def test_chains_are_undone(word, chain):
    g = garble.garble(word, chain)
    if g is not None and chain[0] == "utf-8":
        assert garble.restore(g, chain) == word


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [" ".join([w, "plain", v]) for w in WORDS for v in WORDS] * 3
    traps = ["See the ñ key and the Ã key", "├── A1\n└── B2 ║ ═ ╬", "12 m² ≤ 3·10³ N/m² (§ 7, ¶ 4)", "£ 40 / ¥ 300 / ¢ 5 / ¤ 1", "ATENÇÃO: NÃO ABRIR", "ШКАФ УПРАВЛЕНИЯ В КОНЦЕ", "", None, "plain"]
    cyrillic = [garble.garble(w, c) for w, c in (("протокол", ("utf-8", "cp1252")), ("протокол испытаний", ("cp1251", "koi8-r")))]
    bad = ["PrÃ¼fung one", "GehÃƒÂ¤use two", "rÈsiste three", "premi�re four", cyrillic[0] + " five", cyrillic[1], "zg│asza", "width ▒7 ╡m", "unknÃ¶wn wÃ¶rd"]
    rows += traps
    first_bad = len(rows)
    rows += bad + ["grün können"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "element_id bigint, text string, token string")
    return df, first_bad, len(bad)


def test_found(corpus):
    df, first, n = corpus
    got = sorted(r[0] for r in garbled(df, "element_id", "text").collect())
    assert got == list(range(first, first + n))


def test_restored(corpus):
    df, first, _ = corpus
    got = {r.element_id - first: (r.restored, r.complete) for r in restored(df, "element_id", "text").collect()}
    assert got[0] == ("Prüfung one", True)
    assert got[1] == ("Gehäuse two", True)
    assert got[2] == ("résiste three", True)
    assert not got[3][1]
    assert got[4] == ("протокол five", True)
    assert got[5] == ("протокол испытаний", True)
    assert got[7] == ("width ±7 µm", True)
    assert got[8][0] == "unknöwn wörd"


def test_empty_and_repeated(spark):
    schema = "element_id bigint, text string"
    assert garbled(spark.createDataFrame([], schema), "element_id", "text").collect() == []
    rows = [(1, "für"), (1, "für"), (2, "f�r"), (2, "f�r"), (3, "a" * 300_000 + " ü")]
    assert [r[0] for r in garbled(spark.createDataFrame(rows, schema), "element_id", "text").collect()] == [2, 2]


SENTENCE = {("cp1252", "cp437"): "Prüfung größer Gehäuse", ("cp1252", "mac_roman"): "première éléments résiste", ("cp1250", "cp1252"): "usterkę się występuje", ("cp1251", "koi8-r"): "протокол испытаний насос"}


@pytest.mark.parametrize("clean, bad", [(6, 4), (2, 1), (3, 2)])
def test_byte_chains_are_found_however_common_they_are(spark, clean, bad):
    rows, want = [], {}
    for chain, text in SENTENCE.items():
        for k in range(clean + bad):
            if k >= clean:
                want[len(rows)] = text
            rows.append((len(rows), text if k < clean else garble.garble(text, chain)))
    df = spark.createDataFrame(rows, "element_id bigint, text string")
    assert sorted(r[0] for r in garbled(df, "element_id", "text").collect()) == sorted(want)
    assert {r.element_id: r.restored for r in restored(df, "element_id", "text").collect()} == want


def test_lone_tokens_with_signs_are_found_and_symbols_are_not(spark):
    rows = [(1, "die Füllung"), (2, "die Fⁿllung"), (3, "die Fⁿllung"), (4, "≈ √ und ≥ Ω"), (5, "— – und ³ ½"), (5, "— – und ³ ½"), (6, "się"), (7, "siê"), (8, "ZНIH ХDGZ"), (9, "Н"), (10, "Х"), (11, "о"), (12, "о"), (13, "о"), (14, "и"), (15, "и"), (16, "и")]
    df = spark.createDataFrame(rows, "element_id bigint, text string")
    assert sorted(r[0] for r in garbled(df, "element_id", "text").collect()) == [2, 3]


TRAPS = ["Ra ¾ µm — Ω ≥ 10 kΩ ± 1 ‰", "12 m² ≤ 3·10³ N/m² (§ 7, ¶ 4)", "├── A1\n└── B2 ║ ═ ╬", "√2 · Ø 30 mm ÷ 4 ≈ 5 ½ mm", "£ 40 / ¥ 300 / ¢ 5 / ¤ 1", "Å 1,5 · ∆t = 20 °C · ∑ = 3 · ∞", "angle α and Θ", "keys ü and ý", "® or ¯"]
LETTERS = [chr(c) for c in [*range(0xA1, 0x180), *range(0x391, 0x3CA), *range(0x410, 0x450), *range(0x2550, 0x256D), 0x2013, 0x2014, 0x2019, 0x221A, 0x2248, 0x2264]]
ODD = {
    "lone letter": ["El valor ó su medida."],
    "list of letters": ["Letters: " + " ".join(LETTERS[:120])],
    "all letters": ["Letters: " + " ".join(LETTERS), "Signs " + " / ".join(LETTERS)],
    "keys": [f"See the {c} key of the panel." for c in LETTERS for _ in range(12)],
}


@pytest.mark.parametrize("odd", sorted(ODD))
def test_odd_clean_rows_change_nothing(spark, odd):
    """Rows with lone letters lend no frequency to those letters: no other row is found for them."""
    clean = [f"{w} und {v} à la valeur" for w in WORDS for v in WORDS] * 8 + TRAPS * 60
    bad = ["PrÃ¼fung one", "rÈsiste three", "zg│asza", "und ‡ la valeur"]
    texts = clean + bad + ["und à la valeur"] * 20 + ODD[odd]
    df = spark.createDataFrame(list(enumerate(texts)), "element_id bigint, text string")
    got = sorted(r[0] for r in garbled(df, "element_id", "text").collect())
    assert got == list(range(len(clean), len(clean) + len(bad)))


def test_short_tokens_are_settled_by_what_is_around_them(spark):
    texts = [f"frames, Ø {k} mm" for k in range(40)] + ["frames, ÿ 7 mm", "see the ÿ key", "10 × 5"] + ["em 3 é 5"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "element_id bigint, text string")
    assert [r[0] for r in garbled(df, "element_id", "text").collect()] == [40]
    assert [tuple(r) for r in restored(df, "element_id", "text").collect()] == [(40, "frames, Ø 7 mm", True)]
