"""Pages of repeated keywords, link lists and product tags.

Each line of a text, or each sentence of a line that has several, is observed as one of a few shapes:
sentences, stuffed words, links, hashtags, paths, lists, short lines, tables, leaders and so on. A full
stop makes no sentence by itself: how the words of each unit recur *elsewhere on the page* is measured,
as the chance that a word of it equals one of the page's other words, with and without the page's three
commonest words (the function words of prose). Running text, even from templates, stays below
:data:`HIGH`; shuffled keywords and one line said over and over lie above. Between :data:`SOME` and
that a sentence counts as recurring, which many in a row must confirm. Words outside sentences that
recur tell keyword lists from headings.

A hidden Markov model labels the units as prose, link list, tag list, menu or apparatus, the last for
what a document has besides sentences in good faith: contents, indexes, tables, captions, reference
lists. A page is flagged if more than half of its words lie in link lists, tag lists and menus. A word
is a token with a letter; a link is one word.

The model starts from :data:`PRIOR`, counts that state what each label looks like, and is fitted by
expectation maximisation on all units of all texts, equal sequences once with their number: every task
adds up what it expects of its own, and only these sums reach the driver. The prior grows with the texts
beyond :data:`PRIOR_TEXTS`, so that a larger table of like texts has the same model. Units without words
have no label; null and empty texts are never flagged; repeated rows stay repeated.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut, shipped, stored

PROSE, LINKS, TAGS, MENU, APPARATUS = LABELS = ("prose", "link list", "tag list", "menu", "apparatus")
SPAM = (1, 2, 3)
SHAPES = ("sentence", "recurring", "stuffed", "link", "linked sentence", "hashtags", "path", "list", "known list", "short", "known short", "plain", "known plain", "heading", "table", "leader", "reference")
#: Rounds of the fit.
ROUNDS = 4
#: Units that a task of the fit handles at once; a longer text is handled by itself.
TOGETHER = 1 << 18
#: Decimals of the expected counts that the model is made from, so that the order of sums makes no difference.
DECIMALS = 6
#: What each label looks like: shapes by label, in counts out of a hundred.
PRIOR = {
    PROSE: {"sentence": 79, "recurring": 1, "short": 8, "plain": 4, "heading": 5, "known short": 1, "known plain": 1, "linked sentence": 1},
    LINKS: {"link": 90, "known short": 4, "short": 3, "known list": 1, "path": 1, "linked sentence": 1},
    TAGS: {"stuffed": 25, "recurring": 10, "hashtags": 15, "known list": 28, "known short": 20, "list": 5, "known plain": 5, "short": 1, "link": 1},
    MENU: {"path": 90, "known short": 4, "known list": 4, "short": 2},
    APPARATUS: {"table": 30, "leader": 25, "reference": 20, "heading": 12, "short": 6, "plain": 4, "linked sentence": 3},
}
#: Weight of the prior against the counts of the texts, and of staying with a label.
PRIOR_WEIGHT, STAY = 2000.0, 0.85
#: Texts up to which the prior has that weight; beyond, it has this share of theirs.
PRIOR_TEXTS = 5_000
#: Least mean number of times that a line's words occur outside sentences for the line to be known.
KNOWN = 3.0
#: Chance that two words of running text are the same, at most: below 10 words, below 30, below
#: :data:`WINDOW`, from there on, and the last for long lines with few different words.
SAME = (0.2, 0.115, 0.085, 0.066, 0.045)
#: Least different words of n in running text, as multiples of ``n ** GROWTH`` within a window:
#: in any case, and where the chance of same words is high.
VARIED, GROWTH, WINDOW = (0.6, 0.9), 0.85, 60
#: Chance that a word recurs elsewhere on the page, without the page's three commonest words: from
#: which a sentence counts as recurring and as stuffed; and the latter with those words. On few words
#: chance is coarse, so :data:`COARSE` over their number is added; below :data:`LEAST` it says nothing.
SOME, HIGH, HIGH_ALL, COARSE, COARSE_ALL, LEAST, COMMONEST = 0.025, 0.055, 0.09, 1.5, 0.3, 20, 3
#: Words of a unit that count as one observation.
UNIT = 8

_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+")
_MARKUP = re.compile(r"</?a\b[^>]*>|\]\(\s*(?:https?://|www\.)[^)]*\)|href=")
_WORD = re.compile(r"[^\W\d_][\w\u0300-\u036f’'-]*")
_CLOSERS, _ENDS = "\"”»“’)] ", tuple(".!?:;…")
_SEPARATORS = re.compile(r"[,;|·•/]|\s[–—-]\s")
_LEADER = re.compile(r"(?:\.{3,}|…|(?:\. ){3,})\s*\d+$|(?:,\s*\d+)+$|\s\d+\s*-\s*\d+$")
_HEADING = re.compile(r"^(?:#{1,6}\s|\d+(?:\.\d+)*\.?\s|[^\W\d_]{2,5}\.?\s\d+\s*[:.])")
_PATH = re.compile(r"\s[>›»]\s")
_NEXT = re.compile(r"(?<=[.!?])[\"”»“’)\]]*\s+")
_HASH = re.compile(r"(?:^|\s)#[^\W\d]")
_NUMBER = {s: i for i, s in enumerate(SHAPES)}


def _squares(words: list[str]) -> int:
    """The sum of the squares of how often each word occurs."""
    n = len(words)
    more = n - len(set(words))
    if more < 2:
        return n + 2 * more  # no word twice, or one
    counts: dict[str, int] = {}
    total = 0
    for w in words:
        k = counts.get(w, 0)
        total += 2 * k + 1
        counts[w] = k + 1
    return total


def _varied(words: list[str]) -> bool:
    """Whether words recur no more than in running text.

    Judged by the chance that two words of the line are the same, which hardly depends on length,
    and in long lines also by the number of different words.
    """
    n = len(words)
    if (different := len(set(words))) == n:
        return True
    if n < 6:
        return n < 3 or different >= 0.5 * n
    same = (_squares(words) - n) / (n * (n - 1))
    if n < 10:
        return same < SAME[0]
    if n < 30:
        return same < SAME[1]
    if same >= SAME[2 if n < WINDOW else 3]:
        return False
    parts = [words[i : i + WINDOW] for i in range(0, max(n - WINDOW // 2, 1), WINDOW)]
    different = sum(len(set(p)) / len(p) ** GROWTH for p in parts) / len(parts)
    return different >= VARIED[0] and (same < SAME[4] or different >= VARIED[1])


def _recurrence(units: list[list[str]]) -> list[int]:
    """0, 1 or 2 for each unit: whether its words recur elsewhere on the page no more than in prose, more, or far more."""
    page = Counter(chain.from_iterable(units))
    total = page.total()
    low = dict(page)  # without the commonest
    for w, _ in page.most_common(COMMONEST):
        low[w] = 0
    low_total = sum(low.values())
    every_count, low_count = page.__getitem__, low.__getitem__
    out = []
    for words in units:
        n = len(words)
        rest = total - n
        if rest < LEAST or n < 4:
            out.append(0)
            continue
        every = (sum(map(every_count, words)) - _squares(words)) / (n * rest)
        rare = [w for w in words if low[w]]
        m = len(rare)
        others = low_total - m
        part = (sum(map(low_count, rare)) - _squares(rare)) / (m * others) if m and others else float(not m)
        coarse = COARSE / max(others, LEAST)
        out.append(2 if part >= HIGH + coarse or every >= HIGH_ALL + COARSE_ALL / rest else 1 if part >= SOME + coarse else 0)
    return out


def observe(text: str) -> tuple[list[int], list[int]]:
    """The shape and the number of words of every unit that has words."""
    units: list[tuple[str, list[str], int, bool, bool]] = []
    for line in text.splitlines():
        s = line.strip()
        if not s:
            continue
        if s[0] in "|[" or "//" in s or "www." in s or "<a" in s:
            links, bare = len(_URL.findall(s)), _MARKUP.sub(" ", _URL.sub(" ", s)).strip()
            pieces = [(s, bare)]
        else:
            links, pieces = 0, [(p, p) for p in _NEXT.split(s) if p]
        for p, bare in pieces:
            words = _WORD.findall(bare.lower())
            if words or links:
                units.append((p, words, links, _varied(words), bare.rstrip(_CLOSERS).endswith(_ENDS)))
    seen: Counter = Counter()  # words outside sentences
    for _, words, _, varied, ends in units:
        if not (varied and ends):
            seen.update(words)
    shapes, sizes = [], []
    for (s, words, links, varied, ends), recurs in zip(units, _recurrence([u[1] for u in units])):
        n = len(words)
        first = s[0]
        if first == "[" and re.match(r"\[\d+\]", s):
            shape = "reference"
        elif first == "|":
            shape = "table"
        elif links or "<a" in s:
            shape = "linked sentence" if n >= 8 and ends and varied and recurs < 2 else "link"
        elif "#" in s and len(_HASH.findall(s)) >= 2:
            shape = "hashtags"
        elif n >= 4 and ends and varied:
            shape = ("sentence", "recurring", "stuffed")[recurs]
        elif not ends and (k := len(_PATH.findall(s))) >= 2 and n <= 6 * (k + 1):
            shape = "path"
        elif s[-1].isdigit() and _LEADER.search(s):
            shape = "leader"
        elif n >= 6 and not varied:
            shape = "stuffed"
        else:
            known = n > 0 and sum(map(seen.__getitem__, words)) >= (KNOWN if n < 12 else 2.0) * n
            if (k := len(_SEPARATORS.findall(s))) >= 2 and n <= 5 * (k + 1):
                shape = "known list" if known else "list"
            elif _HEADING.match(s):
                shape = "heading" if not known else "known short"
            elif n <= 5:
                shape = "known short" if known else "short"
            else:
                shape = ("stuffed" if n >= 12 else "known plain") if known else "plain"
        shapes.append(_NUMBER[shape])
        sizes.append(n + links)
    return shapes, sizes


def _advance(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sequences laid end to end, the longest first: lengths, starts, and how many are longer than each step."""
    lengths = np.array([len(t) for t in texts])
    return lengths, np.r_[0, np.cumsum(lengths)[:-1]], len(texts) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")


class Model:
    """Start, transition and emission probabilities."""

    def __init__(self) -> None:
        k = len(LABELS)
        prior = np.full((k, len(SHAPES)), 0.2)
        for i, label in enumerate(LABELS):
            for shape, n in PRIOR[label].items():
                prior[i, _NUMBER[shape]] += n
        self.prior = prior / prior.sum(1, keepdims=True)
        self.emit = self.prior.copy()
        self.move = np.full((k, k), (1 - STAY) / (k - 1))
        np.fill_diagonal(self.move, STAY)
        self.move0 = self.move.copy()
        self.start = np.full(k, 1 / k)

    def fit(self, texts: dict[bytes, int], rounds: int = ROUNDS) -> Model:
        """Expectation maximisation on sequences of shapes with their numbers, held to the prior by its weight."""
        for _ in range(rounds if texts else 0):
            self.renew(self.expected(texts))
        return self

    def expected(self, texts: dict[bytes, int]) -> np.ndarray:
        """How often each label emits each shape, follows each label (the column is the later one) and starts, side by side.

        All sequences advance together, the longest first, so that a step is one matrix product.
        """
        k = len(LABELS)
        order = sorted(filter(None, texts), key=lambda t: (-len(t), t))
        if not order:
            return np.zeros((k, len(SHAPES) + k + 1))
        weight = np.array([texts[t] for t in order], float)[:, None]
        lengths, starts, live = _advance(order)
        shapes = np.frombuffer(b"".join(order), np.uint8)
        at = [shapes[starts[:n] + t] for t, n in enumerate(live)]
        ahead, scales, shares, move = [], [], [], np.zeros((k, k))
        for t, seen in enumerate(at):
            x = (ahead[-1][: len(seen)] @ self.move if t else self.start) * self.emit.T[seen]
            scales.append(x.sum(1, keepdims=True))
            ahead.append(x / scales[-1])
        later = np.ones_like(ahead[-1])
        for t in range(lengths[0] - 1, -1, -1):
            shares.append(ahead[t] * later * weight[: len(later)])
            if t:
                inner = self.emit.T[at[t]] * later / scales[t]
                move += self.move * ((ahead[t - 1][: len(inner)] * weight[: len(inner)]).T @ inner)
                later = np.ones_like(ahead[t - 1])
                later[: len(inner)] = inner @ self.move.T
        seen, share = np.concatenate(at[::-1]), np.concatenate(shares)
        emit = np.array([np.bincount(seen, share[:, i], len(SHAPES)) for i in range(k)])
        return np.hstack([emit, move, shares[-1].sum(0)[:, None]])

    def renew(self, expected: np.ndarray) -> None:
        """The likeliest model for expected counts and the prior."""
        emit, move, start = np.split(np.round(expected, DECIMALS), [len(SHAPES), len(SHAPES) + len(LABELS)], 1)
        more = max(1.0, start.sum() / PRIOR_TEXTS)  # each text starts once
        emit, move, start = emit + self.prior * PRIOR_WEIGHT * more, move + self.move0 * PRIOR_WEIGHT * more, start[:, 0] + more
        self.emit = emit / emit.sum(1, keepdims=True)
        self.move = move / move.sum(1, keepdims=True)
        self.start = start / start.sum()

    def words(self, texts: list[tuple[list[int], list[int]]]) -> np.ndarray:
        """Words by label of each text, along the likeliest labels of its units; a long unit is observed as often as it is long.

        All texts advance together, the longest first.
        """
        counts = np.zeros((len(texts), len(LABELS)), np.int64)
        order = sorted((i for i, (shapes, _) in enumerate(texts) if len(shapes)), key=lambda i: -len(texts[i][0]))
        if not order:
            return counts
        move, emit = np.log(self.move), np.log(self.emit).T
        lengths, starts, live = _advance([texts[i][0] for i in order])
        shapes = np.concatenate([texts[i][0] for i in order])
        sizes = np.concatenate([texts[i][1] for i in order]).astype(np.int64)
        seen = emit[shapes] * (1 + sizes // UNIT)[:, None]
        score, back = np.log(self.start) + seen[starts], []
        for t in range(1, lengths[0]):
            k = live[t]
            each = score[:k, :, None] + move
            back.append(each.argmax(1).astype(np.int8))
            score[:k] = each.max(1) + seen[starts[:k] + t]
        label = score.argmax(1)
        rows = np.array(order)
        for t in range(lengths[0] - 1, -1, -1):
            k = live[t]
            np.add.at(counts, (rows[:k], label[:k]), sizes[starts[:k] + t])
            if t:
                label[:k] = back[t - 1][np.arange(k), label[:k]]
        return counts


def observed(documents: DataFrame, id_column: str, text: str) -> DataFrame:
    """``id``, and the shapes (a byte each) and sizes (four) of the units of each text that is not null."""
    kind = documents.schema[id_column].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            units = [observe(t) for t in part["text"]]
            yield pd.DataFrame({"id": part["id"], "shapes": [bytes(u) for u, _ in units], "sizes": [np.array(n, np.int32).tobytes() for _, n in units]})

    rows = documents.filter(F.col(text).isNotNull()).select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    return shipped(rows).mapInPandas(run, f"id {kind}, shapes binary, sizes binary")


def _expect(model: Model):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, some, units = model.expected({}), {}, 0
        for part in parts:
            for shapes, n in zip(part["shapes"], part["n"]):
                if some and units + len(shapes) > TOGETHER:
                    total, some, units = total + model.expected(some), {}, 0
                some[shapes] = n
                units += len(shapes)
        yield pd.DataFrame({"expected": [(total + model.expected(some)).ravel()]})

    return run


def train(units: DataFrame) -> Model:
    """A model fitted on all texts, from their shapes; a row for each task reaches the driver in each round."""
    # The sequences are few bytes, which would be merged into few tasks, but much work.
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = cut(units.filter(F.length("shapes") > 0).groupBy("shapes").agg(F.count("*").alias("n")).repartition(tasks))
    model = Model()
    for _ in range(ROUNDS):
        sums = texts.mapInPandas(_expect(model), "expected array<double>").collect()
        model.renew(sum((np.array(r.expected) for r in sums), model.expected({}).ravel()).reshape(len(LABELS), -1))
    return model


def labelled(documents: DataFrame, id_column: str, text: str) -> DataFrame:
    """Words by label of each text: the id, a column per label, ``words`` and ``spam_share``."""
    units = stored(observed(documents, id_column, text))
    model = train(units)
    kind = documents.schema[id_column].dataType.simpleString()
    names = [n.replace(" ", "_") for n in LABELS]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [(np.frombuffer(a, np.uint8), np.frombuffer(b, np.int32)) for a, b in zip(part["shapes"], part["sizes"])]
            yield pd.DataFrame({"id": part["id"], **dict(zip(names, model.words(texts).T))})

    out = units.mapInPandas(run, f"id {kind}, " + ", ".join(f"{n} bigint" for n in names))
    words = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    spam = sum((F.col(names[i]) for i in SPAM[1:]), F.col(names[SPAM[0]]))
    return out.withColumn("words", words).withColumn("spam_share", F.when(words > 0, spam / words).otherwise(0.0)).withColumnRenamed("id", id_column)
