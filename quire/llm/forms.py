"""One consistent form for texts that look the same.

``Transducer`` is a longest-match rewriter over grapheme clusters. Its rules are computed from the
Unicode data of Python and one fixed table of look-alike letters, checked for conflicts when they
are compiled, and applied in one pass. ``consistent`` picks the script of each word first, from the
letters that exist in one script only, so that a word of mixed look-alikes ends up in its own script.

What changes: full-width and ligature forms, letters with detached accents, spaces of other widths,
invisible characters, look-alike letters and hyphens. Case, accents, digits and punctuation stay.
Null stays null and an empty text empty; a text of any length is handled whole.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import ship_package

# Letters that look the same in Latin, Cyrillic and Greek ("-": none there).
ALIKE = (
    "Latin:    A B C E H I J K M N O P S T X Y Z a c e i j o p s v x y d h q w",
    "Cyrillic: А В С Е Н І Ј К М - О Р Ѕ Т Х У - а с е і ј о р ѕ ѵ х у ԁ һ ԛ ԝ",
    "Greek:    Α Β - Ε Η Ι - Κ Μ Ν Ο Ρ - Τ Χ Υ Ζ - - - - - ο - - ν - - - - - -",
)
# Characters that look like another in any script.
TWINS = {"\u2010": "-", "\u2011": "-", "\u03bc": "\u00b5", "\u0261": "g", "\u2206": "\u0394"}
# Signs that are one letter by canonical equivalence.
SIGNS = "\u2126\u212a\u212b"
SCRIPTS = ("Latin", "Cyrillic", "Greek")
# Marks that some texts detach from their letter.
MARKS = "".join(map(chr, range(0x300, 0x346))) + "".join(map(chr, range(0x346, 0x34F)))
_COLUMNS = [row.split(":")[1].split() for row in ALIKE]
CLASS = {c: k for column in _COLUMNS for k, c in enumerate(column) if c != "-"}


def _range(*parts: tuple[int, int]) -> str:
    return "".join(chr(c) for a, b in parts for c in range(a, b + 1))


#: Characters without width of their own: format characters, joiners and variation selectors.
INVISIBLE = _range((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF))
SPACES = "".join(c for c in map(chr, range(0x80, 0x3001)) if unicodedata.category(c) == "Zs")
_WIDE = _range((0xFF01, 0xFF5E), (0xFFE0, 0xFFE6))
_JOINED = _range((0xFB00, 0xFB06), (0x132, 0x133))
_EXPAND = {ord(c): unicodedata.normalize("NFKC", c) for c in _WIDE + _JOINED}


class Transducer:
    """Longest-match rules on grapheme clusters, for one target script."""

    def __init__(self, script: str) -> None:
        own = SCRIPTS.index(script)
        self.rules: dict[str, str] = {}
        letters: dict[str, str] = {}
        for c, k in CLASS.items():
            target = _COLUMNS[own][k]
            letters[c] = target if target != "-" else next(col[k] for col in _COLUMNS if col[k] != "-")
        singles = {c: "" for c in INVISIBLE} | {c: " " for c in SPACES} | {c: unicodedata.normalize("NFKC", c) for c in _WIDE + _JOINED} | TWINS
        for source, target in singles.items():
            self._add(source, "".join(letters.get(c, c) for c in target))
        for source, target in letters.items():
            self._add(source, target)
        # Letters with marks, stored as one character or as several.
        marked = [c for c in map(chr, [*range(0xC0, 0x530), *range(0x1E00, 0x1F00)]) if unicodedata.decomposition(c) and unicodedata.combining(c) == 0]
        for c in marked:
            parts = unicodedata.normalize("NFD", c)
            if len(parts) < 2 or any(m not in MARKS for m in parts[1:]):
                continue
            same = [parts[0]] + [s for s in letters if parts[0] in CLASS and CLASS.get(s) == CLASS[parts[0]]]
            whole = unicodedata.normalize("NFC", letters.get(parts[0], parts[0]) + parts[1:])
            for base in dict.fromkeys(same):
                self._add(base + parts[1:], whole)
            self._add(c, whole)
        for c in SIGNS:
            letter = unicodedata.normalize("NFC", c)
            self._add(c, self.rules.get(letter, letter))
        self.longest = max(map(len, self.rules))
        self._check()
        self._clusters = re.compile(f"[^{re.escape(MARKS + INVISIBLE)}](?:[{re.escape(MARKS + INVISIBLE)}]+)|[{re.escape(''.join(s for s in self.rules if len(s) == 1))}]")
        self._one = functools.lru_cache(maxsize=1 << 16)(self._cluster)

    def _add(self, source: str, target: str) -> None:
        known = self.rules.setdefault(source, target)
        if known != target:
            raise ValueError(f"{source!r} has two forms, {known!r} and {target!r}")

    def _check(self) -> None:
        """Every result is left as it is by the rules; then one pass is enough."""
        for source, target in self.rules.items():
            again = "".join(map(self._cluster, re.findall(f".[{MARKS}]*", target)))
            if again != target:
                raise ValueError(f"{source!r} becomes {target!r}, which becomes {again!r}")
        self.rules = {s: t for s, t in self.rules.items() if s != t}

    def _cluster(self, cluster: str) -> str:
        if len(cluster) > 1:
            cluster = cluster[0] + cluster[1:].translate(dict.fromkeys(map(ord, INVISIBLE)))
            cluster = unicodedata.normalize("NFC", cluster.translate(_EXPAND))
        out, i = [], 0
        while i < len(cluster):
            for n in range(min(self.longest, len(cluster) - i), 0, -1):
                piece = cluster[i : i + n]
                if piece in self.rules:
                    out.append(self.rules[piece])
                    break
            else:
                n = 1
                out.append(cluster[i])
            i += n
        return "".join(out)

    def __call__(self, text: str) -> str:
        return self._clusters.sub(lambda m: self._one(m[0]), text)


def _script(c: str) -> str | None:
    """The script of a letter that has no look-alike in another, else None."""
    c = unicodedata.normalize("NFKD", c)[0]
    if c in CLASS or not c.isalpha():
        return None
    code = ord(c)
    return "Latin" if code < 0x250 or 0x1E00 <= code < 0x1F00 else "Greek" if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000 else "Cyrillic" if 0x400 <= code < 0x530 else "Latin"


@functools.cache
def _compiled() -> tuple[dict[str, Transducer], re.Pattern, re.Pattern, dict[str, re.Pattern], re.Pattern]:
    machines = {s: Transducer(s) for s in SCRIPTS}
    odd = INVISIBLE + SPACES + _WIDE + _JOINED + "".join(TWINS) + SIGNS + MARKS
    foreign = "".join(c for column in _COLUMNS[1:] for c in column if c != "-")
    letters = [chr(c) for c in [*range(0x41, 0x530), *range(0x1E00, 0x2000)] if chr(c).isalpha()]
    sure = {s: re.compile(f"[{''.join(c for c in letters if _script(c) == s)}]") for s in SCRIPTS}
    word = re.compile(f"(?:[^\\W\\d_]|[{re.escape(MARKS + INVISIBLE)}])+")
    plain_foreign = re.compile(f"[{foreign}Ѐ-ԯͰ-Ͽ]")
    return machines, re.compile(f"[{re.escape(odd)}]"), plain_foreign, sure, word


def _count(sure: dict[str, re.Pattern], text: str) -> str | None:
    """The script with most sure letters, Latin before Cyrillic before Greek; None without any."""
    text = text.translate(_EXPAND)
    n = {s: len(p.findall(text)) for s, p in sure.items()}
    best = max(n, key=n.get)
    return best if n[best] else None


def consistent(text: str | None) -> str | None:
    """The consistent form of one text."""
    if text is None or text.isascii():
        return text
    machines, odd, foreign, sure, word = _compiled()
    if not foreign.search(text):
        return machines["Latin"](text) if odd.search(text) else text
    words = list(word.finditer(text))
    scripts = [_count(sure, m[0]) for m in words]
    # Look-alikes only: capitals are codes, the rest goes with the word before, else the one after.
    near, later = None, next((s for s in scripts if s), "Latin")
    out, last = [], 0
    for m, script in zip(words, scripts):
        w = m[0]
        near = script or near
        out += [machines["Latin"](text[last : m.start()]), machines[script or ("Latin" if w.upper() == w else near or later)](w)]
        last = m.end()
    return "".join(out) + machines["Latin"](text[last:])


@F.pandas_udf(T.StringType())
def _consistent(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield pd.Series([consistent(t) for t in s], dtype=object)


def consistent_form(text: F.Column) -> F.Column:
    """Column form of :func:`consistent`; one Arrow-batched Python stage."""
    ship_package(SparkSession.active())
    return _consistent(text)


def same_reading(left: DataFrame, right: DataFrame, group: str, left_id: str, right_id: str, left_text: str, right_text: str) -> DataFrame:
    """Pairs of a left and a right row of one group whose texts read the same but differ.

    The forms are joined, not the rows: equal texts of a group meet once however many rows have
    them, so rows that are spelt alike are never paired. Null groups and texts match nothing;
    repeated rows give repeated pairs. Columns: ``left_id``, ``right_id``.
    """
    side = lambda df, i, t, text: df.select(F.col(group).alias("_g"), F.col(i).alias(i), F.col(t).alias(text)).filter(F.col("_g").isNotNull() & F.col(text).isNotNull())
    a, b = side(left, left_id, left_text, "_a"), side(right, right_id, right_text, "_b")
    forms = lambda df, text: df.select("_g", text).distinct().withColumn("_form", consistent_form(F.col(text)))
    met = forms(a, "_a").join(forms(b, "_b"), ["_g", "_form"]).filter(F.col("_a") != F.col("_b")).select("_g", "_a", "_b")
    return met.join(a, ["_g", "_a"]).join(b, ["_g", "_b"]).select(left_id, right_id)
