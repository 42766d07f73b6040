import random
from itertools import chain

from quire.llm import stuffing
from quire.llm.stuffing import LABELS, Model, labelled, observe

WORDS = "the pump was checked by staff before each start and its valve stays within limits while a sensor reports any fault to our control room during normal work so that no residue enters this pipe again after long breaks".split()
PROSE = "The pump must be checked every week by trained staff before the first start. The valve may only be opened when the main switch is off."


def sentence(rnd):
    return " ".join(rnd.sample(WORDS, rnd.randrange(8, 20))).capitalize() + "."


def pages(rnd):
    goods = ["gear motor", "pump seal", "valve kit"]
    word = lambda: rnd.choice(goods) + rnd.choice(["", " cheap", " best price", " discount"])
    url = lambda: f"https://shop{rnd.randrange(99)}.example/{rnd.randrange(9999)}"
    n = rnd.randrange(15, 40)
    prose = "\n\n".join(sentence(rnd) for _ in range(n))
    spam = {
        "words": ", ".join(word() for _ in range(n)),
        "soup": " ".join(word() for _ in range(n)),
        "sentences": " ".join((word() + " " + word() + " " + word()).capitalize() + rnd.choice(".!?") for _ in range(n)),
        "lines": "\n".join(word() for _ in range(n)),
        "tags": " ".join("#" + word().replace(" ", "_") for _ in range(n)),
        "links": "\n".join(f"[{word()}]({url()})" for _ in range(n)),
        "bare": "\n".join(f"- {url()}" for _ in range(n)),
        "html": " ".join(f'<a href="{url()}">{word()}</a>' for _ in range(n)),
        "menu": "\n".join(f"Home > Shop > {word()} > {word()}" for _ in range(n)),
        "opening": PROSE + "\n\n" + "\n".join(word() for _ in range(60)),
    }
    fine = {
        "prose": prose,
        "contents": "\n".join(f"{i} Spare parts {i} ........ {i * 3}" for i in range(1, n)) + "\n\n" + prose[:200] + ".",
        "index": "\n".join(f"Spare {w}, {i}, {i + 9}" for i, w in enumerate(rnd.sample(WORDS, 12))),
        "glossary": "\n".join(f"{w}: {sentence(rnd)}" for w in rnd.sample(WORDS, 12)),
        "table": "\n".join(f"| {i} | {rnd.choice(goods)} | {i * 7 % 5} |" for i in range(n)),
        "references": "\n".join(f"[{i}] Test results. {sentence(rnd)} {url()}" for i in range(1, n)),
        "tagged": prose + "\n\nTags: " + ", ".join(word() for _ in range(6)),
        "linked": prose + "\n\n" + "\n".join(f"Spare parts: {url()}" for _ in range(4)),
        "short": "Spare Parts\n\n" + PROSE,
    }
    return spam, fine


def test_held_out_kinds(spark):
    rnd = random.Random(6)
    rows, want = [], set()
    for k in range(12):
        spam, fine = pages(rnd)
        for kind, text in [*spam.items(), *fine.items()]:
            rows.append((len(rows), text, kind, 0))
            if kind in spam:
                want.add(rows[-1][0])
    got = labelled(spark.createDataFrame(rows, "doc_id bigint, text string, kind string, words int"), "doc_id", "text").collect()
    found = {r.doc_id for r in got if r.spam_share > 0.5}
    wrong = [(rows[i][2]) for i in found ^ want]
    assert len(wrong) <= 0.02 * len(rows), sorted(wrong)


def test_nothing_to_judge(spark):
    rows = [(1, None), (2, ""), (3, " \n 12 34 "), (4, PROSE), (4, PROSE), (5, "x " * 100_000)]
    got = [(r.doc_id, r.words, r.spam_share > 0.5) for r in labelled(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect()]
    assert sorted(got) == [(2, 0, False), (3, 0, False), (4, 26, False), (4, 26, False), (5, 100_000, True)]
    assert labelled(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").collect() == []


def test_labels_are_the_likeliest_path():
    from collections import Counter
    from itertools import product

    import numpy as np

    rnd = np.random.default_rng(1)
    draw = lambda n: [int(x) for x in rnd.integers(0, len(stuffing.SHAPES), n)]
    m = Model().fit(Counter(bytes(draw(n % 12 + 1)) for n in range(20)), 2)
    texts = [(draw(n), [int(x) for x in rnd.integers(0, 40, n)]) for n in (5, 1, 0, 3, 5, 4)]

    def score(path, seq, sizes):
        s = np.log(m.start[path[0]])
        for t, (a, o, n) in enumerate(zip(path, seq, sizes)):
            s += np.log(m.emit[a, o]) * (1 + n // stuffing.UNIT) + (np.log(m.move[path[t - 1], a]) if t else 0)
        return s

    want = np.zeros((len(texts), len(LABELS)), int)
    for i, (seq, sizes) in enumerate(texts):
        if seq:
            best = max(product(range(len(LABELS)), repeat=len(seq)), key=lambda path: score(path, seq, sizes))
            np.add.at(want[i], list(best), sizes)
    assert m.words(texts).tolist() == want.tolist()
    assert abs(m.emit.sum(1) - 1).max() < 1e-9 and abs(m.move.sum(1) - 1).max() < 1e-9


def test_fit_is_the_textbook_one():
    """One round on two sequences against sums over all paths."""
    from itertools import product

    import numpy as np

    texts = {bytes([0, 2, 5]): 3, bytes([1, 4]): 1}
    m, k = Model(), len(LABELS)
    emit, move, start = m.prior * stuffing.PRIOR_WEIGHT, m.move0 * stuffing.PRIOR_WEIGHT, np.ones(k)
    for t, n in texts.items():
        paths = {q: np.prod([m.start[q[0]] * m.emit[q[0], t[0]], *[m.move[q[i - 1], q[i]] * m.emit[q[i], t[i]] for i in range(1, len(t))]]) for q in product(range(k), repeat=len(t))}
        total = sum(paths.values())
        for q, w in paths.items():
            w *= n / total
            start[q[0]] += w
            for i, (a, o) in enumerate(zip(q, t)):
                emit[a, o] += w
                if i:
                    move[q[i - 1], a] += w
    got = Model().fit(texts, 1)
    assert np.allclose(got.emit, emit / emit.sum(1, keepdims=True)) and np.allclose(got.move, move / move.sum(1, keepdims=True)) and np.allclose(got.start, start / start.sum())


GOODS = "pump valve seal gear motor kit cheap price online best discount filter hose clamp".split()


def test_stuffing_with_full_stops(spark):
    """A full stop does not make a sentence of keywords, in lines of their own or in one long line."""
    rnd = random.Random(8)
    line = lambda n: " ".join(rnd.sample(GOODS, n)).capitalize()
    spam = ["\n".join(line(14) + "." for _ in range(60)), "\n".join(["Buy cheap pump valve seal online at best price today."] * 80), " ".join(line(12) + "." for _ in range(60)), "\n".join(line(14) for _ in range(60))]
    fine = ["\n\n".join(sentence(rnd) for _ in range(40)), " ".join(sentence(rnd) for _ in range(40)), PROSE + "\n\n" + line(8) + "."]
    df = spark.createDataFrame(list(enumerate(spam + fine)), "doc_id bigint, text string")
    got = {r.doc_id: r.spam_share for r in labelled(df, "doc_id", "text").collect()}
    assert all(got[i] > 0.5 for i in range(4)) and all(got[i] < 0.5 for i in range(4, 7)), got


def test_observe_counts_links_as_words():
    shapes, sizes = observe("see https://a.example/x/y\n\n[cheap pump](https://b.example/z)")
    assert sizes == [2, 3]


def listed(rnd):
    """Five words that hardly occur elsewhere."""
    return ", ".join("".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(5)) for _ in range(5))


def judged(spark, texts):
    """The share of spam of a page of nothing but lists, beside ``texts``."""
    rows = [*enumerate(texts, 1), (0, "\n".join(listed(random.Random(i)) for i in range(4)))]
    return labelled(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").filter("doc_id = 0").first().spam_share


def test_all_units_of_a_text_count(spark):
    """What lists look like in prose is learnt wherever they stand in a long text."""
    rnd = random.Random(4)
    plain = [sentence(rnd) for _ in range(400)]
    mixed = list(chain.from_iterable((sentence(rnd), listed(rnd)) for _ in range(4000)))
    assert judged(spark, ["\n".join(plain)]) == 1
    assert judged(spark, ["\n".join(plain), *("\n".join(mixed[i : i + 400]) for i in range(0, len(mixed), 400))]) == 0
    assert judged(spark, ["\n".join(plain + mixed)]) == 0


def test_all_texts_count(spark):
    """The texts with the largest hashes of their ids teach as much as the others."""
    from pyspark.sql import functions as F

    rnd = random.Random(5)
    ids = [r.id for r in spark.range(1, 5101).orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 40))).collect()]
    texts = dict.fromkeys(ids, PROSE)
    for i in ids[-60:]:
        texts[i] = "\n".join(chain.from_iterable((sentence(rnd), listed(rnd)) for _ in range(190)))
    assert judged(spark, [texts[i] for i in sorted(ids)]) == 0


def test_the_fit_of_many_tasks_is_that_of_all_texts(spark, monkeypatch):
    """Also where the prior grows with the texts, and texts are handled in parts."""
    from collections import Counter

    import numpy as np

    monkeypatch.setattr(stuffing, "PRIOR_TEXTS", 7)
    rnd = random.Random(7)
    texts = [t for _ in range(3) for kind in pages(rnd) for t in kind.values()] + ["", " 12 ", PROSE, PROSE]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = stuffing.train(stuffing.observed(df, "doc_id", "text"))
    want = Model().fit(Counter(bytes(observe(t)[0]) for t in texts))
    assert np.allclose(got.emit, want.emit, 1e-9, 0) and np.allclose(got.move, want.move, 1e-9, 0) and np.allclose(got.start, want.start, 1e-9, 0)
    twice = stuffing.train(stuffing.observed(df.unionAll(df), "doc_id", "text"))
    assert np.allclose(got.emit, twice.emit, 1e-6, 0) and np.allclose(got.move, twice.move, 1e-6, 0)
