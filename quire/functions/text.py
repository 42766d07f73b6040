"""Text keys, numbers, slugs and joins as Column expressions; all run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python counts it, and the patterns of numbers, leaders and markers.
WS = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NUMBER_PREFIX = r"^(\d+(?:\.\d+)*\.?)\s+(.+)$"
SECTION_NUMBER = r"^(\d{1,3}(?:\.\d{1,3})*\.?)\s+.+$"
LEADER_END = r"\.{2,}\s*\d+\s*$"
LEADER_LINE = r"^(.*?)\s*\.{2,}\s*(\d+)\s*$"
BULLETS = "·•▪–-"
ENUMERATOR = r"(?:\d{1,3}[.)]|\(\d{1,3}\)|\([A-Za-z]\)|[ivxlcdmIVXLCDM]{1,4}\)|[A-Za-z]\))"
MARKER = rf"^([\x{{F02D}}\x{{F0B7}}\x{{F0A7}}\x{{F0D8}}{BULLETS}]|{ENUMERATOR})[ \t]\s*(\S.*)$"
CAPTION = r"(?i)^(figure|fig\.?|table)\s+\d+\.?:?(?:\s|$)"
TERMINALS = ".!?:;"
TRAILING = rf"(?:{WS}|[.:;,\-–—])+$"
WORD4 = r"\p{L}{4,}"
# Common function words; those that two languages share are dropped.
FUNCTION_WORDS = {
    "deu": "und der die das nicht mit für auf ist wird sie den von zu ein eine dem des bei oder auch",
    "eng": "the and of to is for with that this are on be from by it as an or not",
    "fra": "le les et des est pour dans une que sur avec pas du au ce qui sont",
    "spa": "el los las y que en para con una por es del se al lo como",
    "ita": "il che di e per con una non sono della gli nel alla dei",
    "nld": "het een en van is dat met voor niet op zijn ook aan bij of",
}


def function_words() -> list[tuple[str, str]]:
    """Word and language, for words of one language only."""
    pairs = [(w, lang) for lang, ws in FUNCTION_WORDS.items() for w in ws.split()]
    return [(w, lang) for w, lang in pairs if sum(x == w for x, _ in pairs) == 1]


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def furniture_key(text: Column) -> Column:
    """Key of a line that repeats with other numbers: no white space, digit runs as ``#``."""
    return F.regexp_replace(F.regexp_replace(text, WS + "+", ""), r"\p{Nd}+", "#")


def has_letters(key: Column) -> Column:
    return key.rlike(r"\p{L}")


def heading_key(text: Column) -> Column:
    """Key by which contents entries and headings meet: case folded, no trailing punctuation."""
    return F.replace(F.lower(F.regexp_replace(collapse(text), TRAILING, "")), F.lit("ß"), F.lit("ss"))


def section_number(text: Column) -> Column:
    """The leading section number, parts of at most three digits, or null."""
    return F.nullif(F.regexp_extract(F.trim(text), SECTION_NUMBER, 1), F.lit(""))


def number_depth(number: Column) -> Column:
    return F.size(F.split(F.rtrim(number, F.lit(".")), r"\."))


def split_number(text: Column) -> tuple[Column, Column]:
    """A leading dotted number or null, and the rest."""
    t = F.trim(text)
    number = F.nullif(F.regexp_extract(t, NUMBER_PREFIX, 1), F.lit(""))
    return number, F.when(number.isNull(), t).otherwise(F.trim(F.regexp_extract(t, NUMBER_PREFIX, 2)))


def slug(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("section"))


def heading_slug(text: Column) -> Column:
    """Anchor of a heading: its number with dashes, else its slug."""
    number = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)*)", 1)
    return F.when(number != "", F.replace(number, F.lit("."), F.lit("-"))).otherwise(slug(text))


def two_digits(number: Column, fallback: Column) -> Column:
    """The last part of a dotted number, or the fallback, with at least two digits."""
    last = F.element_at(F.split(number, r"\."), -1).try_cast("int")
    return F.format_string("%02d", F.coalesce(last, fallback.cast("int")))


def join_text(left: Column, right: Column) -> Column:
    """Two runs of text with a space between, or none after a hyphen that ends a word."""
    cut = left.rlike(r"[\p{L}\p{N}][-\x{2010}\x{2011}]$")
    return F.when(F.coalesce(left, F.lit("")) == "", right).when(F.coalesce(right, F.lit("")) == "", left).when(cut, F.concat(left, right)).otherwise(F.concat(left, F.lit(" "), right))


def join_texts(texts: Column) -> Column:
    """:func:`join_text` over an array, in order."""
    return F.aggregate(texts, F.lit(""), join_text)


def ends_sentence(text: Column) -> Column:
    """Whether the text ends a sentence; white space and an empty text do not."""
    return F.coalesce(F.rtrim(text), F.lit("")).rlike(r"[.!?:;]$")


def list_marker(line: Column) -> tuple[Column, Column]:
    """Marker and text of a list line; nulls where it is none."""
    marker = F.nullif(F.regexp_extract(line, MARKER, 1), F.lit(""))
    return marker, F.when(marker.isNotNull(), F.trim(F.regexp_extract(line, MARKER, 2)))


def is_caption(text: Column) -> Column:
    return F.trim(text).rlike(CAPTION)


def first_sentence(text: Column, longest: int = 160) -> Column:
    """Up to the first sentence end; else the text, cut at a word if it is long."""
    t = F.trim(text)
    sentence = F.regexp_extract(t, r"(?s)^(.*?[.!?])(?:\s|$)", 1)
    short = F.regexp_replace(F.substring(t, 1, longest), r"(?s) [^ ]*$", "")
    return F.when(sentence != "", sentence).when(F.length(t) <= longest, t).otherwise(F.concat(short, F.lit("…")))


def garbled_fraction(text: Column) -> Column:
    """Share of characters, white space aside, that map to nothing: U+FFFD, controls, private use."""
    solid = F.regexp_replace(text, WS + "+", "")
    lost = F.length(F.regexp_replace(solid, r"[^\x{FFFD}\p{Cc}\p{Co}]", ""))
    return F.when(F.length(solid) > 0, lost / F.length(solid)).otherwise(F.lit(0.0))


def page_tier(text: Column, image_share: Column) -> Column:
    """How a page is to be read: ``text``, or ``ocr`` for scans, garbled layers and sparse picture pages."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    garbled = garbled_fraction(F.coalesce(text, F.lit("")))
    return F.when(n < 20, F.when(image_share > 0, "ocr").otherwise("text")).when(garbled >= 0.1, "ocr").when((n < 200) & (image_share >= 0.5), "ocr").otherwise("text")


def coverage_words(text: Column) -> Column:
    """Words of at least four letters in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD4), F.lit(0))
