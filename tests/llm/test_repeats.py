import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import repeats
from quire.llm.repeats import RUN, repeated_share, repetition, words_of

SCHEMA = "element_id bigint, doc string, page_number int, seq int, text string, extracted_at timestamp, block int, words string"
T0 = dt.datetime(2024, 1, 1)


def brute(texts):
    w = [x for t in texts for x in words_of(t)]
    seen, marked = set(), set()
    for i in range(len(w) - RUN + 1):
        k = tuple(w[i : i + RUN])
        if k in seen:
            marked |= set(range(i, i + RUN))
        seen.add(k)
    return len(marked) / max(len(w), 1)


def table(spark, docs):
    """docs: name -> list of (page, text)."""
    rows, n = [], 0
    for doc, parts in docs.items():
        for seq, (page, text) in enumerate(parts):
            n += 1
            rows.append((n, doc, page, seq, text, T0, 7, "x"))
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def sentence(rnd, n=20, vocabulary=500):
    return " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in (rnd.randrange(vocabulary) for _ in range(n)))


def test_against_brute_force(spark):
    rnd = random.Random(5)
    docs = {}
    for d in range(30):
        pool = [sentence(rnd) for _ in range(3)]
        last = rnd.choice([3, 3, 200])
        parts = [(rnd.choice(range(1, last)), rnd.choice(pool) if rnd.random() < d / 40 else sentence(rnd, rnd.choice([1, 5, 30]))) for _ in range(rnd.choice([1, 10, 60]))]
        docs[f"d{d}"] = sorted(parts, key=lambda p: p[0])
    got = {r.doc: r.share for r in repetition(table(spark, docs), measure_all=True).collect()}
    assert set(got) == set(docs)
    for d, parts in docs.items():
        assert abs(got[d] - brute([t for _, t in parts])) < 1e-9, d
    banded = {r.doc: r.share for r in repetition(table(spark, docs)).collect()}
    assert {d for d, s in got.items() if s > 0.25} == {d for d, s in banded.items() if s is not None and s > 0.25}


def test_runs_across_many_tiny_blocks(spark):
    w = "one two three four five six seven eight nine ten eleven twelve".split()
    parts = [(i * repeats.BLOCK_PAGES, x) for i, x in enumerate(w + ["stop"] + w + ["end"])]
    got = repetition(table(spark, {"d": parts})).collect()
    assert len(got) == 1 and abs(got[0].share - 12 / 26) < 1e-9


def test_latest_row_counts_and_order(spark):
    later = T0 + dt.timedelta(days=1)
    s = "a b c d e f g h i j k l m"
    rows = [(1, "d", 1, 1, s, T0, 0, ""), (2, "d", 1, 2, s, T0, 0, ""), (3, "d", 1, 2, "quite different", later, 0, ""), (4, None, 1, 1, s, T0, 0, ""), (5, "e", None, None, None, None, 0, ""), (6, "f", None, None, "x", None, 0, ""), (7, "f", None, None, "x", None, 0, ""), (8, "g", 1, 1, "", T0, 0, "")]
    got = {r.doc: (r.words, r.share) for r in repetition(spark.createDataFrame(rows, SCHEMA), measure_all=True).collect()}
    assert got == {"d": (15, 0.0), "f": (1, 0.0), "g": (0, 0.0)}
    assert repetition(spark.createDataFrame([], SCHEMA)).collect() == []


def band(text):
    return repeats.compression(repeats._hash_words(words_of(text), repeats._Hashes()), repeats.packer())[4]


def test_bands():
    rnd = random.Random(1)
    noise = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzäöüßéèабвгдежзик") for _ in range(9)) for _ in range(3000)]
    assert band(" ".join(noise)) == repeats.DENSE
    assert band(" ".join(noise[:300] * 10)) == repeats.REPETITIVE
    assert band("") == band("a b c d e f g h i j k l") == repeats.PLAIN


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from([60, 200, 1000, 6000, 40_000]), st.sampled_from([3, 9, 40]), st.sampled_from([40, 3000, 10**9]), st.sampled_from([12, 13, 20, 300]))
def test_no_repetitive_text_is_passed_as_plain(seed, n, length, vocabulary, run):
    """The limits lose nothing: runs from anywhere before, as short as they count, in words of any kind."""
    rnd = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzабвгдежзийклмнопрстуфхцчшщъыьэюя"
    known = {}

    def word():
        k = rnd.randrange(vocabulary)
        return known.setdefault(k, "".join(rnd.choice(letters) for _ in range(length)))

    words = [word() for _ in range(30)]
    while len(words) < n:  # a little more than a quarter is repeated
        at = rnd.randrange(max(len(words) - run, 1))
        words += words[at : at + run]
        words += [word() for _ in range(int(run * rnd.uniform(2, 3)))]
    text = " ".join(words)
    if repeated_share(text) > repeats.SHARE:
        assert band(text) == repeats.REPETITIVE


def test_repeated_blocks_among_rare_words(spark):
    """A third or so of such texts is repeated, although their characters hardly compress."""
    rnd = random.Random(9)
    docs = {}
    for k, (n, share) in enumerate([(1000, 0.3), (2600, 0.4), (7000, 0.4), (900, 0.27), (900, 0.2)]):
        words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(20_000)]
        block = [rnd.choice(words) for _ in range(60)]
        text = [w for i in range(n // 60) for w in (block if i == 0 or rnd.random() < share + 0.03 else [rnd.choice(words) for _ in range(60)])]
        docs[f"d{k}"] = [(1, " ".join(text))]
    got = {r.doc: r.share for r in repetition(table(spark, docs)).collect()}
    for d, parts in docs.items():
        want = brute([t for _, t in parts])
        assert got[d] == pytest.approx(want) if want > 0.25 else got[d] is None or got[d] == pytest.approx(want)


def test_one_page_with_very_many_places(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_PLACES", 4)
    rnd = random.Random(2)
    docs = {"one": [(None, sentence(rnd, 15, 60)) for _ in range(30)], "two": [(1 + i // 20, sentence(rnd, 15, 60)) for i in range(40)], "three": [(1, "a b c")]}
    docs["one"][20:24] = docs["one"][3:7]
    docs["two"][25:32] = docs["two"][1:8]
    got = {r.doc: r.share for r in repetition(table(spark, docs), measure_all=True).collect()}
    assert set(got) == set(docs)
    for d, parts in docs.items():
        assert got[d] == pytest.approx(brute([t for _, t in parts])), d


def test_very_long_text():
    assert repeated_share("tick tock " * 300_000) > 0.99
    assert repeated_share("ONE two THREE four " * 3) == 0.0


@pytest.mark.parametrize("segment", [1 << 18, 100])
def test_the_number_of_pages_decides_nothing(spark, monkeypatch, segment):
    """All figures and the band of a document are those of its words, however many blocks it is handled in."""
    rnd = random.Random(11)
    fresh = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(n))
    pool = [fresh(14) for _ in range(4)]
    docs = {
        "noise": [(i, fresh(15)) for i in range(160)],
        "little": [(i, pool[0] if i % 20 == 3 else fresh(20)) for i in range(160)],
        "much": [(i, rnd.choice(pool) if i % 2 else fresh(9)) for i in range(160)],
        "far": [(i, t) for i, t in enumerate([fresh(15) for _ in range(60)] * 2)],
        "few": [(i * 70, "a b c d") for i in range(3)],
        "short": [(i * 70, "a b c d e") for i in range(3)],
        "none": [(1, "12"), (99, "")],
        "page": [(1, fresh(30))],
    }
    monkeypatch.setattr(repeats, "SEGMENT", segment, raising=False)
    for measure_all in (False, True):
        got = []
        for pages in (64, 10**6) if measure_all else (64, 3, 10**6):
            monkeypatch.setattr(repeats, "BLOCK_PAGES", pages)
            got.append(sorted(repetition(table(spark, docs), measure_all).collect()))
        assert got[0] == got[1] == got[-1] and [r.doc for r in got[0]] == sorted(docs)
    monkeypatch.setattr(repeats, "BLOCK_PAGES", 64)
    found = {r.doc: (r.band, r.share) for r in repetition(table(spark, docs)).collect()}
    if segment > 100:
        assert found["noise"] == (repeats.DENSE, None) and found["little"] == (repeats.PLAIN, None)
    assert found["much"][0] == found["far"][0] == repeats.REPETITIVE and found["far"][1] == pytest.approx(0.5)


@pytest.mark.parametrize("seed", range(12))
def test_repetition_across_segments_is_seen(seed):
    """The whole ratio alone is at the limit, though what is repeated lies segments apart or over a seam."""
    rnd = random.Random(seed)
    segment, run = 4096, (12, 13, 40, 5000)[seed % 4]
    words = [rnd.randrange(10**12) for _ in range(20_000)]
    while len(words) < 40_000:
        at = rnd.randrange(15_000 if seed % 3 else len(words) - run)
        words += words[at : at + run] + [rnd.randrange(10**12) for _ in range(run * rnd.randrange(2) // 2)]
    seen, marked = set(), set()
    for i in range(len(words) - RUN + 1):
        k = tuple(words[i : i + RUN])
        if k in seen:
            marked.update(range(i, i + RUN))
        seen.add(k)
    n = len(words) - repeats.CODED + 1
    hashes = repeats._hash_words([f"w{w}" for w in words], repeats._Hashes())
    _, _, ratio, _, band = repeats.compression(hashes, repeats.packer(), segment)
    assert len(marked) > 0.25 * len(words) and ratio >= repeats.limit(n, -(-n // segment)) and band == repeats.REPETITIVE
    noise = repeats._hash_words([f"n{rnd.randrange(10**12)}" for _ in range(40_000)], repeats._Hashes())
    assert repeats.compression(noise, repeats.packer(), segment)[2] <= 1
