"""Repair of glyphs that fonts map to wrong characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Greek letters of the Symbol font by its codes, signs by code, and ligatures.
SYMBOL_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖαβχδεφγηιϕκλμνοπθρστυϖωξψζ")
SYMBOL_SIGNS = ("\"$'*@\\^~", "∀∃∋∗≅∴⊥∼")
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
LETTER_GLYPHS = {"Ɵ": "ti", "Ʃ": "tt", "Ō": "ft"}
_PRIVATE = "".join(chr(0xF000 + c) for c in range(0x21, 0x7F))
_PLAIN = "".join(map(chr, range(0x21, 0x7F)))


def decode_symbol(text: Column) -> Column:
    """Text of the Symbol font: private-use codes first, then letters and signs."""
    plain = F.translate(text, _PRIVATE, _PLAIN)
    return F.translate(plain, SYMBOL_LETTERS[0] + SYMBOL_SIGNS[0], SYMBOL_LETTERS[1] + SYMBOL_SIGNS[1])


def fix_ligatures(text: Column) -> Column:
    """Presentation ligatures always; letters that stand for ligatures only beside small letters."""
    for glyph, plain in LIGATURES.items():
        text = F.replace(text, F.lit(glyph), F.lit(plain))
    for glyph, plain in LETTER_GLYPHS.items():
        beside = rf"(?<=\p{{Ll}}){glyph}" if glyph == "Ō" else rf"(?<=\p{{Ll}}){glyph}|{glyph}(?=\p{{Ll}})"
        text = F.regexp_replace(text, beside, plain)
    return text


def drop_stray_marks(text: Column) -> Column:
    """Combining marks outside the common block after Latin text: a space between letters, else nothing."""
    stray = r"[\p{M}&&[^\x{300}-\x{36F}]]"
    spaced = F.regexp_replace(text, rf"(?<=[\p{{IsLatin}}\d]){stray}+(?=[\p{{L}}\p{{N}}])", " ")
    return F.regexp_replace(spaced, rf"(?<=[\p{{IsLatin}}\d\s]){stray}+", "")


def repair(text: Column) -> Column:
    return drop_stray_marks(fix_ligatures(text))
