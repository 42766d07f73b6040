import pytest
from pyspark.sql import functions as F

from quire.llm import languages
from quire.llm.languages import Profiles, judged, language_code, sentences_of

TEXTS = {
    "eng": ["The pump must be checked every week by trained staff.", "This valve should not be opened during normal operation.", "All parts of the cooling circuit were measured twice before delivery.", "Please read the safety notes before you start with the work."],
    "deu": ["Die Pumpe muss jede Woche von geschultem Personal geprüft werden.", "Dieses Ventil darf während des Betriebs nicht geöffnet werden.", "Alle Teile des Kühlkreislaufs wurden vor der Lieferung zweimal gemessen.", "Bitte lesen Sie die Sicherheitshinweise vor dem Beginn der Arbeit."],
    "fra": ["La pompe doit être contrôlée chaque semaine par le personnel formé.", "Cette soupape ne doit pas être ouverte pendant le fonctionnement.", "Toutes les pièces du circuit ont été mesurées deux fois avant la livraison.", "Veuillez lire les consignes de sécurité avant de commencer le travail."],
    "rus": ["Насос должен проверяться каждую неделю обученным персоналом.", "Этот клапан нельзя открывать во время нормальной работы.", "Все части контура охлаждения измерены дважды перед поставкой.", "Прочитайте указания по безопасности перед началом работы."],
}
E_SCHEMA = "element_id bigint, doc string, text string, lang string, label string"
C_SCHEMA = "corpus_id bigint, doc string, lang string, main string"


@pytest.fixture(scope="module")
def result(spark):
    elements, corpus, n = [], [], 0
    for k, (lang, texts) in enumerate(TEXTS.items()):
        for d in range(4):
            doc = f"{lang}{d}"
            corpus.append((k * 10 + d, doc, [lang, lang.upper(), "eng", None][d] if d else lang, "x"))
            for t in texts * 2:
                n += 1
                elements.append((n, doc, t, "zzz", "y"))
    elements += [(901, "deu0", TEXTS["fra"][0] + " " + TEXTS["deu"][1] + " " + TEXTS["eng"][0], "", ""), (902, "deu0", "pressure gauge", "", ""), (903, "deu0", None, "", ""), (904, None, TEXTS["eng"][0], "", ""), (905, "eng0", "AB-12 XY-99 (ZK3) 17.", "", ""), (906, "eng0", "", "", ""), (901, "deu0", TEXTS["fra"][0], "", "")]
    corpus += [(77, "nowhere", None, ""), (0, "eng0", "eng", "again"), (78, None, "eng", "")]
    labels, segments = judged(spark.createDataFrame(elements, E_SCHEMA), spark.createDataFrame(corpus, C_SCHEMA))
    return labels.collect(), segments.collect()


def test_labels(result):
    labels, _ = result
    assert all(r.doc.startswith(r.lang) for r in labels)
    assert len(labels) == 4 * len(TEXTS) + 1 and sum(r.corpus_id == 0 for r in labels) == 2
    assert all(0.5 < r.confidence <= 1 for r in labels)
    assert {r.label for r in labels if r.doc == "deu3"} == {None} and {r.label for r in labels if r.doc == "deu2"} == {"eng"}


def test_segments(result):
    _, segments = result
    assert sorted((r.element_id, r.lang) for r in segments) == [(901, "eng"), (901, "fra"), (901, "fra")]


def test_spellings(spark):
    rows = [("eng", "eng"), ("en-GB", "eng"), (" ENG ", "eng"), ("German", "deu"), ("fre", "fra"), ("pt_BR", "por"), ("und", None), ("", None), (None, None), ("русский", "rus")]
    got = spark.createDataFrame(rows, "a string, b string").select(language_code(F.col("a")).alias("x"), "b").collect()
    assert all(r.x == r.b for r in got)


def test_held_out_sentences():
    grams = {}
    for lang, texts in TEXTS.items():
        counts = languages.Counter()
        for t in texts[:3]:
            for w, _ in sentences_of(t):
                for x in w:
                    counts.update(languages._grams(x))
        grams[lang] = languages._ordered(counts)[: languages.PROFILE]
    judge = Profiles(grams)
    for lang, texts in TEXTS.items():
        words = judge.numbers(sentences_of(texts[3])[0][0])
        counts = judge.counts(words)
        some = languages.np.flatnonzero(counts)
        for d in (judge.passage(words), judge.distance(some, counts[some], languages.TOP, languages.SIZE), judge.sums([words])[0]):
            assert judge.languages[d.argmin()] == lang


def test_distance_is_out_of_place():
    judge = Profiles({"a": ["x", "y", "z"], "b": ["z", "y"]})
    order = [judge._gram[g] for g in "xyz"]
    n = languages.np.array([5, 9, 1])
    got = judge.distance(languages.np.array(order), n, 10, 3)  # y, x, z
    assert got.tolist() == pytest.approx([(1 + 1 + 0) / 9, (1 + 3 + 2) / 9])


def test_large_documents_are_judged_like_small_ones(spark, monkeypatch):
    """The same rows with documents of one group, and with counts that are summed."""
    elements, corpus, n = [], [], 0
    for lang, texts in TEXTS.items():
        corpus.append((n, lang, lang, ""))
        for k in range(12):
            n += 1
            other = TEXTS["fra" if lang != "fra" else "eng"][k % 4] if k % 5 == 0 else ""
            elements.append((n, lang, texts[k % 4] + " " + other, "", ""))
    e, c = spark.createDataFrame(elements, E_SCHEMA), spark.createDataFrame(corpus, C_SCHEMA)
    one = [sorted(map(tuple, d.collect())) for d in judged(e, c)]
    monkeypatch.setattr(languages, "GROUP_ROWS", 5)
    two = [sorted(map(tuple, d.collect())) for d in judged(e, c)]
    assert one == two and len(one[1]) == 12


def test_mixed_documents_are_in_the_language_of_most_words(spark):
    elements = [(k, f"{lang}{d}", t, "", "") for d in range(3) for lang, ts in TEXTS.items() for k, t in enumerate(ts)]
    elements += [(100 + k, "mixed", t, "", "") for k, t in enumerate(TEXTS["deu"][:3] + TEXTS["eng"][:4])]
    corpus = [(k, f"{lang}{d}", lang, "") for d in range(3) for k, lang in enumerate(TEXTS)] + [(99, "mixed", None, "")]
    labels, segments = judged(spark.createDataFrame(elements, E_SCHEMA), spark.createDataFrame(corpus, C_SCHEMA))
    assert [r.lang for r in labels.collect() if r.doc == "mixed"] == ["eng"]
    assert sorted(r.element_id for r in segments.collect() if r.doc == "mixed") == [100, 101, 102]


def test_empty_tables(spark):
    labels, segments = judged(spark.createDataFrame([], E_SCHEMA), spark.createDataFrame([], C_SCHEMA))
    assert labels.collect() == [] and segments.collect() == []


def test_very_long_text_is_read_whole():
    s = sentences_of("word " * 100_000 + ". " + "The end is here now. " * 3)
    assert len(s) == 4 and len(s[0][0]) == 100_000
