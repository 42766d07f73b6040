"""Language of documents and of passages, by rank-order profiles.

Each language has a profile: its most frequent character n-grams, of words with their ends marked, by
rank. A document's own profile is its :data:`TOP` most frequent n-grams by rank, counted over the whole
document; its language is that with the least out-of-place distance, the mean of how far the ranks lie
apart, n-grams that the language's first :data:`SIZE` lack at the end. A passage, a full sentence with
its end mark and at least :data:`MIN_WORDS` words, is judged by the same distance of its own n-grams
by rank; n-grams that are equally frequent in it go by how common they are in any language.

Documents whose first two languages lie near each other, mixed ones, are in that of the two which has
most words, by sentences. Only candidates are ranked as passages: sentences that a sum over their
words, each looked up once, puts in another language, which the ranks must confirm. Passages that fit no profile or no single one, such as codes and
garbled text, have no language. Confidence is the distance of the second language as a share of the
distances of the first two; from 0.5, as near to both, to 1.

A document is one task's group if it has at most :data:`GROUP_ROWS` rows. The n-grams of larger ones
are counted where the rows lie and summed; their passages are judged beside the document's language.

Profiles are fitted on a bounded sample of labelled rows: :data:`TRAIN_ROWS` elements by the hash of
their id, of a document at most :data:`TRAIN_PER_DOC`; labels may be wrong in a minority. Everything
else covers all rows. Rows without document or text have no part; a document without any known text has
no language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.forms import consistent
from quire.operators.joins import join_small
from quire.session import cut, shipped, stored

# Spellings of the languages, by code, first part of a tag, or name.
SPELLINGS = {
    "eng": "eng en english anglais englisch",
    "deu": "deu ger de german deutsch allemand",
    "fra": "fra fre fr french français francais französisch",
    "spa": "spa es spanish español espanol castellano spanisch",
    "por": "por pt portuguese português portugues portugiesisch",
    "nld": "nld dut nl dutch nederlands flemish vlaams niederländisch",
    "swe": "swe sv swedish svenska schwedisch",
    "pol": "pol pl polish polski polnisch",
    "rus": "rus ru russian русский russisch",
}
LANGUAGES = tuple(SPELLINGS)
#: Elements that the profiles are fitted on, over all languages.
TRAIN_ROWS = 60_000
TRAIN_PER_DOC = 64
#: N-grams of a profile, and their greatest length.
PROFILE = 3000
LONGEST = 5
#: Most frequent n-grams of a document, ranks of a profile that they are held against, and n-grams of a passage.
TOP, SIZE, PASSAGE = 400, 1000, 300
#: Greatest distance of a document's and of a passage's language, and a passage's least lead over the second.
DOC_FIT, PASSAGE_FIT, PASSAGE_LEAD = 0.75, 0.4, 0.03
#: Greatest mean depth of the words of a candidate, as a share of the profile.
SUM_FIT = 0.36
#: Rows of a document up to which it is one group.
GROUP_ROWS = 1024
MIN_WORDS = 4
#: Share of the first two distances that belongs to the second from which a document is clearly in one language.
ONE = 0.6
_LETTERS = regex.compile(r"\p{L}+")
_CODE = regex.compile(r"(?<!\p{L})\p{Lu}{2,}(?!\p{L})")
_BREAK = regex.compile(r"(?<=[.!?])[\"”»“’)]*\s+|\n")
_FULL = regex.compile(r"[.!?][\"”»“’)]*$")


def language_code(label: F.Column) -> F.Column:
    """The language that a label names, in any spelling; null if none of the known ones."""
    pairs = [F.lit(x) for code, names in SPELLINGS.items() for n in names.split() for x in (n, code)]
    plain = F.lower(F.trim(label))
    return F.coalesce(F.element_at(F.create_map(*pairs), plain), F.element_at(F.create_map(*pairs), F.split(plain, "[-_ ]")[0]))


def _grams(word: str) -> list[str]:
    w = f"_{word}_"
    return [w[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(w) - n + 1)]


def _ordered(counts: Counter) -> list[str]:
    return sorted(counts, key=lambda g: (-counts[g], g))


def fit_profiles(rows: DataFrame) -> dict[str, list[str]]:
    """Profiles from a bounded frame of ``lang`` and ``text``; one task a language."""

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        words: Counter = Counter()
        for t in part["text"]:
            words.update(_LETTERS.findall(consistent(t).lower()))
        counts: Counter = Counter()
        for w, n in words.items():
            for g in _grams(w):
                counts[g] += n
        return pd.DataFrame({"lang": part["lang"].iloc[0], "grams": [_ordered(counts)[:PROFILE]]})

    return {r.lang: list(r.grams) for r in shipped(rows).groupBy("lang").applyInPandas(fit, "lang string, grams array<string>").collect()}


class Profiles:
    """Out-of-place distances to a set of profiles."""

    def __init__(self, profiles: dict[str, list[str]]) -> None:
        self.languages = sorted(profiles)
        grams = sorted({g for p in profiles.values() for g in p})
        self._gram = {g: i for i, g in enumerate(grams)}
        self._ranks = np.full((len(grams), len(self.languages)), PROFILE, np.int32)
        for k, lang in enumerate(self.languages):
            for rank, g in enumerate(profiles[lang]):
                self._ranks[self._gram[g], k] = rank
        self._common = self._ranks.min(1) if self.languages else np.zeros(0, np.int32)
        self._numbers: dict[str, int] = {}
        self._grams: list[np.ndarray] = []
        self._table = np.zeros((1 << 12, len(self.languages)), np.float32)

    def numbers(self, words: list[str]) -> list[int]:
        """Numbers of words, valid until :meth:`renew`."""
        known = self._numbers
        return [known[w] if w in known else self._word(w) for w in words]

    def renew(self) -> None:
        """Forget the words if they have become many, so that the look-up stays bounded."""
        if len(self._numbers) > 500_000:
            self._numbers.clear()
            self._grams.clear()

    def _word(self, word: str) -> int:
        number = self._numbers[word] = len(self._grams)
        if number >= len(self._table):
            self._table = np.r_[self._table, np.zeros_like(self._table)]
        every = _grams(word)
        self._grams.append(np.array([self._gram[g] for g in every if g in self._gram], np.int64))
        ranks = self._ranks[self._grams[number]]
        self._table[number] = (ranks.sum(0) + PROFILE * (len(every) - len(ranks))) / (PROFILE * len(every))
        return number

    def counts(self, numbers: list[int]) -> np.ndarray:
        """How often each n-gram of the profiles occurs in the words."""
        words, n = np.unique(np.array(numbers, np.int64), return_counts=True)
        grams = [self._grams[w] for w in words]
        if not grams:
            return np.zeros(len(self._gram), np.int64)
        return np.bincount(np.concatenate(grams), np.repeat(n, [len(g) for g in grams]), len(self._gram)).astype(np.int64)

    def distance(self, grams: np.ndarray, n: np.ndarray, top: int, size: int) -> np.ndarray:
        """Out-of-place distance of n-grams with their counts to every language, from 0 to 1."""
        grams = grams[np.lexsort((grams, self._common[grams], -n))[:top]]
        ranks = self._ranks[grams]
        return np.where(ranks < size, np.minimum(np.abs(ranks - np.arange(len(grams))[:, None]), size), size).mean(0) / size if len(grams) else np.ones(len(self.languages))

    def passage(self, numbers: list[int]) -> np.ndarray:
        grams, n = np.unique(np.concatenate([self._grams[i] for i in numbers]), return_counts=True)
        return self.distance(grams, n, PASSAGE, PROFILE)

    def sums(self, passages: list[list[int]]) -> np.ndarray:
        """The mean over the words of each passage of how deep in the profiles their n-grams lie; for choosing candidates."""
        starts = np.cumsum([0, *map(len, passages)])[:-1]
        total = np.add.reduceat(self._table[np.concatenate(passages)], starts)
        return total / np.array([[len(p)] for p in passages])


def sentences_of(text: str) -> list[tuple[list[str], bool]]:
    """Words of each sentence or line in lower case, and whether it is a full sentence.

    Words in capitals, of two letters or more, are codes and left out, unless all of it is in capitals.
    """
    out = []
    for s in _BREAK.split(consistent(text)):
        words = _LETTERS.findall((s if s.isupper() else _CODE.sub(" ", s)).lower())
        if words:
            out.append((words, len(words) >= MIN_WORDS and _FULL.search(s) is not None))
    return out


def _best(distances: np.ndarray, fit: float) -> tuple[int, float] | None:
    """The nearest language and the confidence in it."""
    order = np.argsort(distances, kind="stable")
    one = distances[order[0]]
    if one > fit:
        return None
    two = distances[order[1]] if len(order) > 1 else 1.0
    return int(order[0]), float(two / (one + two)) if one + two else 0.5


def _foreign(judge: Profiles, main: int, passages: list[list[int]], whole: list[bool], sums: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """Of full sentences in another language than ``main``: their place, language and confidence."""
    nearest = sums.argmin(1)
    for i in np.flatnonzero((nearest != main) & (sums.min(1) <= SUM_FIT) & np.array(whole, bool)):
        d = judge.passage(passages[i])
        best = _best(d, PASSAGE_FIT)
        if best and best[0] == nearest[i] and np.partition(d, 1)[1] - d[best[0]] >= PASSAGE_LEAD:
            yield int(i), best[0], best[1]


def _rows(judge: Profiles, texts: list[str]) -> tuple[list[int], list[list[int]], list[bool]]:
    """The sentences of texts: the place of their text, their words, and whether they are full."""
    row, passages, whole = [], [], []
    for i, text in enumerate(texts):
        for words, full in sentences_of(text):
            row.append(i)
            passages.append(judge.numbers(words))
            whole.append(full)
    return row, passages, whole


def _votes(judge: Profiles, passages: list[list[int]], sums: np.ndarray) -> np.ndarray:
    """Words of the sentences that lie nearest to each language."""
    return np.bincount(sums.argmin(1), [len(p) for p in passages], len(judge.languages))


def _main(judge: Profiles, grams: np.ndarray, n: np.ndarray, votes: np.ndarray) -> tuple[int, float] | None:
    """The language of a document and the confidence in it."""
    distances = judge.distance(grams, n, TOP, SIZE)
    best = _best(distances, DOC_FIT)
    if best and best[1] < ONE and len(distances) > 1:
        two = np.argsort(distances, kind="stable")[:2]
        return int(two[votes[two].argmax()]), best[1]
    return best


_OUT = "doc string, id bigint, lang string, confidence double"


def _documents(profiles: dict[str, list[str]]):
    """Of whole documents: a row without id for the document, and one for each element and foreign language."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Profiles(profiles)
        for part in parts:
            out = []
            for doc, rows in zip(part["doc"], part["rows"]):
                judge.renew()
                row, passages, whole = _rows(judge, [r["text"] for r in rows])
                if not passages or not judge.languages:
                    continue
                sums, counts = judge.sums(passages), judge.counts(list(chain.from_iterable(passages)))
                grams = np.flatnonzero(counts)
                best = _main(judge, grams, counts[grams], _votes(judge, passages, sums))
                if best:
                    out.append((doc, None, judge.languages[best[0]], best[1]))
                    found: dict[tuple[int, int], float] = {}
                    for i, k, c in _foreign(judge, best[0], passages, whole, sums):
                        found[row[i], k] = max(found.get((row[i], k), 0.0), c)
                    out += [(doc, rows[i]["id"], judge.languages[k], c) for (i, k), c in found.items()]
            yield pd.DataFrame(out, columns=["doc", "id", "lang", "confidence"]).astype({"id": "Int64"})

    return run


def _counted(profiles: dict[str, list[str]]):
    """N-grams of each document in a batch of rows; below zero, the words of the sentences nearest to each language."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Profiles(profiles)
        for part in parts:
            for doc, texts in part.groupby("doc")["text"]:
                judge.renew()
                _, passages, _ = _rows(judge, list(texts))
                if not passages or not judge.languages:
                    continue
                counts, votes = judge.counts(list(chain.from_iterable(passages))), _votes(judge, passages, judge.sums(passages))
                grams = np.flatnonzero(counts)
                yield pd.DataFrame({"doc": doc, "gram": np.r_[grams, -1 - np.arange(len(votes))], "n": np.r_[counts[grams], votes.astype(np.int64)]})

    return run


def _settled(profiles: dict[str, list[str]]):
    """The language of documents whose n-grams have been summed."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Profiles(profiles)
        for part in parts:
            out = []
            for doc, grams, n in zip(part["doc"], part["grams"], part["n"]):
                grams, n = np.asarray(grams, np.int64), np.asarray(n)
                votes = np.zeros(len(judge.languages))
                votes[-1 - grams[grams < 0]] = n[grams < 0]
                best = _main(judge, grams[grams >= 0], n[grams >= 0], votes) if judge.languages else None
                if best:
                    out.append((doc, judge.languages[best[0]], best[1]))
            yield pd.DataFrame(out, columns=["doc", "main", "confidence"])

    return run


def _beside(profiles: dict[str, list[str]]):
    """Foreign passages of rows that carry their document's language."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Profiles(profiles)
        for part in parts:
            out = []
            for doc, i, text, main in zip(part["doc"], part["id"], part["text"], part["main"]):
                judge.renew()
                _, passages, whole = _rows(judge, [text])
                found: dict[int, float] = {}
                for _, k, c in _foreign(judge, judge.languages.index(main), passages, whole, judge.sums(passages)) if passages else ():
                    found[k] = max(found.get(k, 0.0), c)
                out += [(doc, i, judge.languages[k], c) for k, c in found.items()]
            yield pd.DataFrame(out, columns=["doc", "id", "lang", "confidence"]).astype({"id": "Int64"})

    return run


def fitted(rows: DataFrame, labels: DataFrame) -> dict[str, list[str]]:
    """Profiles from the labelled ones of ``rows`` (``doc``, ``id``, ``text``); bounded by rows and by rows of a document."""
    share = min(1.0, TRAIN_ROWS / max(rows.count(), 1))
    key = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    named = labels.select("doc", language_code(F.col("lang")).alias("lang")).filter(F.col("lang").isNotNull()).dropDuplicates(["doc"])
    chosen = rows.filter(key < int(share * (1 << 40))).join(named, "doc")
    place = F.row_number().over(Window.partitionBy("doc").orderBy(key, "text"))
    return fit_profiles(chosen.withColumn("_place", place).filter(F.col("_place") <= TRAIN_PER_DOC).select("lang", "text"))


def judged(elements: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Label rows and segment rows.

    Labels: ``corpus_id``, ``doc``, ``label`` (the language it names or null), ``lang`` and
    ``confidence``; one for each corpus row whose document has a language, repeated rows too.
    Segments: ``element_id``, ``doc``, ``lang`` and ``confidence``; one for each element and language
    with a full sentence in another language than the document's.
    """
    rows = elements.filter(F.col("doc").isNotNull() & F.col("text").isNotNull()).select("doc", F.col("element_id").alias("id"), "text")
    profiles = fitted(rows, corpus)
    large = cut(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP_ROWS).select("doc"))
    groups = join_small(rows, large, "doc", "left_anti").groupBy("doc").agg(F.collect_list(F.struct("id", "text")).alias("rows"))
    small = stored(shipped(groups).mapInPandas(_documents(profiles), _OUT))
    spread = join_small(rows, large, "doc", "left_semi")
    grams = shipped(spread).mapInPandas(_counted(profiles), "doc string, gram bigint, n bigint").groupBy("doc", "gram").agg(F.sum("n").alias("n"))
    # At most as many n-grams as the profiles have.
    listed = grams.groupBy("doc").agg(F.collect_list("gram").alias("grams"), F.collect_list("n").alias("n"))
    mains = cut(listed.mapInPandas(_settled(profiles), "doc string, main string, confidence double"))
    beside = join_small(rows, mains.select("doc", "main"), "doc").mapInPandas(_beside(profiles), _OUT)
    main = small.filter("id is null").select("doc", F.col("lang").alias("main"), "confidence").unionByName(mains)
    found = small.filter("id is not null").unionByName(beside)
    label = corpus.select("corpus_id", "doc", language_code(F.col("lang")).alias("label")).join(main, "doc")
    labels = label.select("corpus_id", "doc", "label", F.col("main").alias("lang"), "confidence")
    return labels, found.select(F.col("id").alias("element_id"), "doc", "lang", "confidence")
