"""Texts that were decoded with a wrong encoding: which they are, and the original where it can be had.

Garbled forms of every distinct corpus word are generated under all encoding chains and hash-joined
with the distinct tokens of the corpus; a token that equals a form of another, known word is a
candidate, and is verified before the word is put in its place. Tokens are runs of ASCII letters and
characters beyond ASCII that hold one of the latter (``Prüfung``, ``±``, ``doesn’t``). Bare runs beyond
ASCII in them (``ü``) are joined with chains through UTF-8 only, so that a garbled letter is found in
a word that never occurs clean. Tokens of less than :data:`STRONG` characters say little alone: they
are joined together with the pieces of text before and after them (``mm ±0 µm``, ``‡ la main`` for
``à la main``), numbers and codes levelled.

How often a word occurs is counted on whole tokens alone, so that one odd row with a lone letter does
not lend that letter the frequency of all words that hold it. The evidence, by row:

* *Sure*: forms of chains through UTF-8, which no clean word has by chance, replacement characters
  and C1 controls. Short ones that may stand together in clean text count only beside other evidence.
* *Strong*: forms of one byte encoding read as another, of at least :data:`STRONG` characters or in
  their surroundings, that bear more signs of garbling than their word (a symbol between letters, a
  capital after a small letter, two scripts in a word) or whose word is :data:`RATIO` times as frequent.
* *Together*: one chain turns several different such tokens of a row into known words, and their signs
  and frequencies together say that the row's side is the garbled one.
* *Weak*: short tokens that bear signs or hold frame lines or blocks, without their surroundings, where
  there are several and the chain turns every token of the row into a known word.

A form with fewer signs than its word is never taken for garbled. So ``ñ`` on a key stays, although
it is a garbled ``±``, and so does a row of symbols that one by one are garbled letters.

Null and empty texts are clean, and rows without an id are left out. Rows are judged one by one;
repeated rows stay repeated.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.joins import join_small
from quire.session import cut, shipped, stored

#: A word must be this many times as frequent as its garbled form, for lone tokens without signs.
RATIO = 10
#: Characters from which such a form alone is evidence; shorter tokens are joined with their surroundings.
STRONG = 3
#: Rows of garbled tokens up to which the table is broadcast (about 100 bytes a row).
BROADCAST_ROWS = 100_000

# What UTF-8 is taken for, and byte encodings that are taken for others.
UTF8_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "iso8859-15", "mac_roman", "cp437", "cp850", "cp852", "cp866", "koi8-r")
CYRILLIC = ("cp1251", "cp866", "koi8-r", "iso8859-5")
TWICE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251")
BYTES_AS = {
    "cp1252": ("mac_roman", "cp437", "cp850", "cp1250"),
    "mac_roman": ("cp1252",),
    "cp437": ("cp1252",),
    "cp850": ("cp1252",),
    "cp1250": ("cp1252", "cp852", "mac_roman"),
    "iso8859-2": ("cp1252", "cp1250", "cp852"),
    "cp852": ("cp1250", "cp1252"),
    "cp1251": ("koi8-r", "cp1252", "cp866"),
    "koi8-r": ("cp1251", "cp1252", "cp866"),
    "cp866": ("cp1251", "cp1252", "koi8-r"),
    "iso8859-5": ("cp1251", "cp1252"),
}
CHAINS = [("utf-8", d) for d in UTF8_AS] + [("utf-8", d, "utf-8", e) for d in TWICE for e in (d, "cp1252", "latin-1")]
CHAINS = list(dict.fromkeys(CHAINS)) + [(e, d) for e, ds in BYTES_AS.items() for d in ds]
SURE, STRONG_FORM, WEAK, LOST, BY_ROW = 3, 2, 1, 4, 0
WHOLE, RUN, AROUND = range(3)
UTF8_CHAINS = sum(c[0] == "utf-8" for c in CHAINS)
_TOKEN = re.compile("[A-Za-z\x80-\U0010ffff]+")
_RUN = re.compile("[\x80-\U0010ffff]+")
_NUMBER = re.compile(r"[A-Z]{2,}[A-Z0-9/.-]*|[0-9]+(?:[.,][0-9]+)*")
_SIGN = r"(?<=\p{L})[\p{S}\p{No}\p{Lm}ªº¿¡§¶†‡‰]+(?=\p{L})|(?<=[\p{Ll}&&[^a-z]])\p{Lu}|(?<=[a-z])[\p{Lu}&&[^A-Z]]"
_SIGN += r"|(?<=\p{IsLatin})[\p{IsGreek}\p{IsCyrillic}]|(?<=\p{IsGreek})[\p{IsLatin}\p{IsCyrillic}]|(?<=\p{IsCyrillic})[\p{IsLatin}\p{IsGreek}]"
#: What a token with more signs than its word weighs, as the logarithm of a ratio.
_SIGN_WEIGHT = 5.0
_FRAME = r"[\x{2500}-\x{259F}]"
_LOST = r"[\x{FFFD}\x{80}-\x{84}\x{86}-\x{9F}]"


@functools.cache
def _table(encoding: str) -> list[str]:
    """The 256 characters of a byte encoding; bytes that it leaves out stand for themselves."""
    return [bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(256)]


@functools.cache
def _inverse(encoding: str) -> dict[int, int]:
    return {ord(c): b for b, c in reversed(list(enumerate(_table(encoding))))}


@functools.cache
def _shift(source: str, target: str) -> dict[int, str]:
    """Characters of one byte encoding as another shows them."""
    return {ord(c): _table(target)[b] for b, c in reversed(list(enumerate(_table(source)))) if b >= 128}


def garble(word: str, chain: tuple[str, ...]) -> str | None:
    """``word`` written and read along ``chain``; None where an encoding lacks one of its characters."""
    for source, target in zip(chain[::2], chain[1::2]):
        if source == "utf-8":
            table = _table(target)
            word = "".join([table[b] for b in word.encode("utf-8", "surrogatepass")])
        else:
            shift = _shift(source, target)
            if any(ord(c) >= 128 and ord(c) not in shift for c in word):
                return None
            word = word.translate(shift)
    return word


def restore(word: str, chain: tuple[str, ...]) -> str | None:
    """The word that ``chain`` would have turned into ``word``; None if there is none."""
    for source, target in list(zip(chain[::2], chain[1::2]))[::-1]:
        inverse = _inverse(target)
        if any(ord(c) not in inverse for c in word):
            return None
        data = bytes([inverse[ord(c)] for c in word])
        try:
            word = data.decode("utf-8") if source == "utf-8" else "".join(_table(source)[b] for b in data)
        except UnicodeDecodeError:
            return None
    return word


def _forms(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        form, word, n, signs, chain = [], [], [], [], []
        for w, rows, whole, sign in zip(part["token"], part["n"], part["whole"], part["signs"]):
            around = " " in w
            seen: dict[tuple[str, int], int] = {}  # the first chain through UTF-8, every one of byte encodings
            for k, c in enumerate(CHAINS):
                if (not around) if c[0] == "utf-8" else whole:
                    g = garble(w, c)
                    if g is not None and g != w:
                        seen.setdefault((g, -1 if c[0] == "utf-8" else k), k)
            form += [g for g, _ in seen]
            chain += seen.values()
            word += [w] * len(seen)
            n += [rows if k < UTF8_CHAINS else whole for k in seen.values()]
            signs += [sign] * len(seen)
        yield pd.DataFrame({"token": form, "word": word, "word_n": n, "word_signs": signs, "chain": chain})


def _around(text: str) -> set[str]:
    """The short tokens of a text, each with the pieces before and after it, numbers and codes levelled."""
    pieces = ["^", *text.split(), "$"]
    out = set()
    for i, p in enumerate(pieces):
        if not p.isascii() and any(len(w) < STRONG and not w.isascii() for w in _TOKEN.findall(p)):
            out.add(_NUMBER.sub("0", " ".join(pieces[i - 1 : i + 2])))
    return out


def tokens(rows: DataFrame, id_column: str, text: str) -> DataFrame:
    """Distinct tokens of each row: ``_id``, ``token`` and ``unit``, a WHOLE one, a bare RUN or a short one with what is AROUND it.

    A scan of the text in Arrow batches; as expressions on arrays it takes about twice the time.
    """
    kind = rows.schema[id_column].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, token, unit = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                words = {w for w in _TOKEN.findall(t) if not w.isascii()}
                runs = {r for w in words for r in _RUN.findall(w)} - words
                around = _around(t) if any(len(w) < STRONG for w in words) else ()
                row += [i] * (len(words) + len(runs) + len(around))
                token += [*words, *runs, *around]
                unit += [WHOLE] * len(words) + [RUN] * len(runs) + [AROUND] * len(around)
            ids = batch.column(0).take(pa.array(row, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(token, pa.string()), pa.array(unit, pa.int8())], ["_id", "token", "unit"])

    beyond = rows.filter(F.col(text).rlike(r"[^\x{0}-\x{7F}]")).select(id_column, text)
    return shipped(beyond).mapInArrow(scan, f"_id {kind}, token string, unit tinyint")


def garbled_tokens(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The corpus tokens that are garbled forms: ``token``, ``word``, ``chain`` and ``kind``; and all pairs to be settled by row.

    ``kind`` is SURE, STRONG_FORM or, for tokens with lost characters and no word, LOST. The pairs are those
    of byte encodings: ``token``, ``chain``, ``word``, ``weight``, whether they count ``together``, and ``weak``.
    """
    counts = found.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("unit") != RUN).alias("whole"))
    around, lost = F.contains("token", F.lit(" ")), F.col("token").rlike(_LOST)
    counts = cut(counts.withColumn("signs", F.when(around, 0).otherwise(F.regexp_count("token", F.lit(_SIGN)))))
    # Surroundings that occur less than RATIO times can't be RATIO times as frequent as others.
    parallel = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = counts.filter(~lost & (~around | (F.col("n") >= RATIO))).repartition(parallel, "token")
    forms = shipped(spread).mapInPandas(_forms, "token string, word string, word_n bigint, word_signs int, chain int")
    utf8, short = F.col("chain") < UTF8_CHAINS, F.length("token") < STRONG
    more, fewer = (F.col("signs") > F.col("word_signs")) & ~F.col("word").rlike(r"\p{Z}"), F.col("signs") < F.col("word_signs")
    often = more | (F.col("word_n") >= RATIO * F.col("whole"))
    byte = ~utf8 & (F.col("whole") > 0) & ~fewer
    kind = F.when(utf8 & (F.length("token") > 1), SURE).when(byte & ~short & often, STRONG_FORM)
    letters = F.col("token").rlike(r"\p{L}") & F.col("word").rlike(r"\p{L}")
    weight = F.when(more, _SIGN_WEIGHT).otherwise(F.log(F.col("word_n") / F.col("whole")))
    joined = forms.join(counts, "token").withColumns({"kind": kind, "byte": byte, "weight": F.when(byte, weight), "together": ~short & (more | letters | around), "weak": short & (more | (often & F.col("token").rlike(_FRAME)))})
    met = cut(joined.filter(F.col("kind").isNotNull() | F.col("byte")).select("token", "word", "word_n", "chain", "kind", "byte", "weight", "together", "weak"))
    best = met.filter(F.col("kind").isNotNull()).groupBy("token").agg(F.max_by(F.struct("word", "chain", "kind"), F.struct("kind", "word_n", -F.col("chain"), "word")).alias("b"))
    known = best.select("token", "b.*")
    rest = counts.filter(lost & ~around).join(best, "token", "left_anti")
    bad = known.unionByName(rest.select("token", F.lit(None).cast("string").alias("word"), F.lit(None).cast("int").alias("chain"), F.lit(LOST).alias("kind")))
    # A token RATIO times as frequent as the word says nothing; without those hardly a clean row is joined.
    pairs = met.filter(F.col("byte") & (F.col("weight") > -math.log(RATIO))).groupBy("token", "chain").agg(F.max_by(F.struct("word", "weight", "together", "weak"), F.struct("weight", "word")).alias("b"))
    return bad, pairs.select("token", "chain", "b.*")


def _met(found: DataFrame, table: DataFrame) -> DataFrame:
    return found.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, "token")


def _evidence(df: DataFrame, id_column: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Each row's garbled tokens: ``_id``, ``token``, ``word``, ``chain`` and ``kind``; and the ids of the garbled rows."""
    found = stored(tokens(df, id_column, text))
    bad, pairs = (cut(t) for t in garbled_tokens(found))
    # Two or three letters may stand together in a clean word by chance, and so may lines of a frame.
    n, whole = F.length("token"), F.col("unit") == WHOLE
    cyrillic = F.col("chain").isin([k for k, c in enumerate(CHAINS) if c[-1] in CYRILLIC])
    chance = (cyrillic & (n < F.when(whole, 3).otherwise(4))) | (~whole & (n == 2) & F.col("token").rlike(r"[\x{A0}\x{AD}]")) | (whole & (n == 2) & F.col("token").rlike(r"^[\x{2500}-\x{257F}]+$"))
    solid = (F.col("kind") == LOST) | ((F.col("kind") == SURE) & ~F.coalesce(chance, F.lit(False))) | ((F.col("kind") == STRONG_FORM) & (F.col("unit") != RUN))
    hits = _met(found, bad).filter(solid).select("_id", "token", "word", "chain", "kind")
    paired = _met(found.filter(F.col("unit") != RUN), pairs)
    mark = F.xxhash64("token")
    of = lambda what: [F.min(F.when(what, mark)).alias("a"), F.max(F.when(what, mark)).alias("b")]
    votes = paired.filter("together").groupBy("_id", "chain").agg(*of(F.lit(True)), F.sum("weight").alias("weight")).filter("a < b and weight > 0")
    weak = cut(paired.filter(whole).groupBy("_id", "chain").agg(*of(F.col("weak")), F.count(F.lit(1)).alias("n")).filter("a < b").select("_id", "chain", "n"))
    every = join_small(found.filter(whole), weak.select("_id").distinct(), "_id", "left_semi").groupBy("_id").agg(F.count(F.lit(1)).alias("n"))
    settled = cut(votes.select("_id", "chain").union(weak.join(every, ["_id", "n"]).select("_id", "chain")).distinct())
    by_row = paired.join(settled, ["_id", "chain"], "left_semi").select("_id", "token", "word", "chain", F.lit(BY_ROW).alias("kind"))
    return hits.union(by_row), hits.select("_id").union(settled.select("_id")).distinct()


def garbled(df: DataFrame, id_column: str, text: str, keep: bool = False) -> DataFrame:
    """Ids of rows whose text holds garbled characters; with ``keep`` also their ``repairs``.

    ``repairs`` is an array of (token, word, chain, kind) with the garbled tokens of the row.
    """
    hits, ids = _evidence(df, id_column, text)
    if not keep:
        return df.select(F.col(id_column).alias("_id")).join(ids, "_id", "left_semi").select(F.col("_id").alias(id_column))
    repairs = hits.distinct().groupBy("_id").agg(F.collect_list(F.struct("token", "word", "chain", "kind")).alias("repairs"))
    return repairs.withColumnRenamed("_id", id_column)


def _mend(text: str, words: dict[str, str], chains: list[int]) -> tuple[str, bool]:
    """The text with its garbled tokens replaced, and whether all of them could be."""
    missing = False

    def token(m: re.Match) -> str:
        nonlocal missing
        t = m[0]
        if t.isascii():
            return t
        if t in words:
            return words[t]
        for k in chains:  # a word that never occurs clean: undo the row's own chain if it can be
            if CHAINS[k][0] == "utf-8" and (w := restore(t, CHAINS[k])) is not None and len(w) < len(t):
                return w
        whole = _RUN.sub(lambda r: words.get(r[0], r[0]), t)
        missing |= "�" in whole
        return whole

    return _TOKEN.sub(token, text), not missing


def restored(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """The garbled rows with their original text as far as it can be had.

    Columns: the id, ``restored`` and ``complete``, false where characters are lost for good.
    """
    repairs = garbled(df, id_column, text, keep=True)

    def mend(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts, complete = [], []
            for t, found in zip(p["_text"], p["repairs"]):
                found = sorted(found, key=lambda r: (r["kind"], r["word"] or ""))  # firmer evidence last
                words = {}
                for r in found:
                    if r["word"] is not None:
                        words.update((a, b) for a, b in zip(_TOKEN.findall(r["token"]), _TOKEN.findall(r["word"])) if a != b)
                chains = list(dict.fromkeys(int(r["chain"]) for r in found if r["chain"] is not None))
                new, ok = _mend(t, words, chains)
                texts.append(new)
                complete.append(ok)
            yield pd.DataFrame({"id": p["_id"], "restored": texts, "complete": complete})

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")).join(repairs.withColumnRenamed(id_column, "_id"), "_id")
    return shipped(rows).mapInPandas(mend, f"id {kind}, restored string, complete boolean").withColumnRenamed("id", id_column)
