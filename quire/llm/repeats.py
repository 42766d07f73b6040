"""Repetition inside single documents.

Compression bands come first. A document is written as one code of four bytes for every run of
:data:`CODED` words, so that text without repetition cannot be compressed, whatever its words, and a
run of :data:`RUN` words that starts earlier is a match of seven codes. The zstandard ratio, whole and
in fixed chunks, is held against limits for the number of codes: were a quarter of the words repeated,
so many bytes would be saved that the ratio lay above. Below all limits a document is passed as plain,
and where nothing can be saved as incompressible; nothing that has the share asked for is lost. What
remains is measured exactly: a word is repeated if it lies in a run of :data:`RUN` words that also
starts earlier in the document. Words are runs of letters in lower case.

The whole is compressed in segments of :data:`SEGMENT` codes. A code that stands in an earlier segment is
written as zero, so that repetition saves its bytes however far apart it lies.

A document is its rows in reading order, of each place the latest row. It is handled in blocks of
:data:`BLOCK_PAGES` pages and :data:`BLOCK_PLACES` places. One of a single block is compressed and
measured where it is put together. The codes of a longer one are gathered by segment, and the segments
are compressed by themselves, with the same figures and band as if it were one block. If it is measured,
the runs of each block are hashed, a block sends each hash once, and the first starts of a hash over all
blocks decide, so that no task holds a long document.

Rows without document, and rows whose text is null, are left out; null page or place counts as 0. A
document without words has share 0. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import regex
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.joins import join_small
from quire.session import cut, shipped, stored

RUN = 12
#: Share of repeated words that the limits are made for.
SHARE = 0.25
BLOCK_PAGES = 64
BLOCK_PLACES = 4096
#: Words to a code, and codes to a chunk.
CODED = 6
CHUNK = 1024
#: Codes to a segment.
SEGMENT = 1 << 18
#: Bytes that a match takes up at most, a segment besides its codes, and what is saved less where two
#: segments meet: a run may be cut by the seam, or be one of six that begin before it and end behind it.
MATCH_BYTES, FRAME_BYTES, SEAM_BYTES = 8, 24, 64
#: Size of the compressor's window, which holds a segment.
WINDOW_LOG = 26
# The search inserts every position, so that no repeated run is passed over.
SEARCH = {"strategy": zstandard.STRATEGY_BTOPT, "window_log": WINDOW_LOG, "chain_log": 25, "hash_log": 22, "search_log": 4, "min_match": 4, "target_length": 32}
PLAIN, REPETITIVE, DENSE = "plain", "repetitive", "incompressible"
_LETTERS = regex.compile(r"\p{L}+")
_POWERS = np.cumprod(np.full(RUN, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)[::-1]


class _Hashes(dict):
    """Word hashes, kept for up to a million words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def _hash_words(words: list[str], known: _Hashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _hash_runs(hashes: np.ndarray, run: int = RUN) -> np.ndarray:
    """A hash of every run of ``run`` words, at most RUN."""
    n = len(hashes) - run + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(run):
        out += hashes[j : j + n] * _POWERS[j]
    return out ^ (out >> np.uint64(29))


def _later(runs: np.ndarray) -> np.ndarray:
    """Starts of the runs that also start earlier."""
    _, first = np.unique(runs, return_index=True)
    later = np.ones(len(runs), bool)
    later[first] = False
    return np.flatnonzero(later)


def _covered(starts: np.ndarray) -> int:
    return int(np.minimum(np.diff(starts), RUN).sum() + RUN) if len(starts) else 0


def repeated_share(text: str) -> float:
    """The share of repeated words of one text."""
    hashes = _hash_words(words_of(text), _Hashes())
    return _covered(_later(_hash_runs(hashes))) / max(len(hashes), 1)


def limit(codes: int, segments: int = 1) -> float:
    """The ratio that a document of so many codes has at least if :data:`SHARE` of its words are repeated.

    Every RUN repeated words hold RUN - CODED + 1 codes that stand earlier in the same order, one match.
    """
    saved = SHARE * (codes + CODED - 1) * (4 * (RUN - CODED + 1) - MATCH_BYTES) / RUN
    return 4 * codes / (4 * codes - saved + FRAME_BYTES * segments + SEAM_BYTES * (segments - 1))


def packer() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(**SEARCH))


def _pack(codes: np.ndarray, known: np.ndarray | None, pack: zstandard.ZstdCompressor) -> tuple[int, int, float, bool]:
    """Of a segment: codes, compressed bytes without those ``known`` from earlier ones, largest ratio of a chunk, and whether one is at its limit."""
    short = (codes >> np.uint64(13)).astype(np.uint32)
    n = len(short)
    new = short if known is None else np.where(known, np.uint32(0), short)
    size = len(pack.compress(new.tobytes()))
    chunks = [short[i : i + CHUNK] for i in range(0, n, CHUNK)]
    packed = [size] if n <= CHUNK and known is None else [len(pack.compress(c.tobytes())) for c in chunks]
    rated = [(4 * len(c) / k, limit(len(c))) for c, k in zip(chunks, packed)]
    return n, size, max(r for r, _ in rated), any(r >= most for r, most in rated)


def _rated(words: int, segments: list[tuple[int, int, float, bool]]) -> tuple[int, int, float, float, str]:
    """Bytes of codes, compressed bytes, ratio of the whole, largest ratio of a chunk, and the band, from the segments."""
    n = max(words - CODED + 1, 0)
    if words <= RUN:
        return 4 * n, 4 * n, 1.0, 1.0, PLAIN
    size = sum(s[1] for s in segments)
    ratio = 4 * n / size
    over = ratio >= limit(n, len(segments)) or any(s[3] for s in segments)
    return 4 * n, size, ratio, max(s[2] for s in segments), REPETITIVE if over else PLAIN if ratio > 1 else DENSE


def compression(hashes: np.ndarray, pack: zstandard.ZstdCompressor, segment: int = SEGMENT) -> tuple[int, int, float, float, str]:
    """Bytes of codes, compressed bytes, ratio of the whole, largest ratio of a chunk, and the band, from the words' hashes."""
    codes = _hash_runs(hashes, CODED)
    if len(hashes) <= RUN:
        return _rated(len(hashes), [])
    starts = range(0, len(codes), segment)
    if len(starts) == 1:
        return _rated(len(hashes), [_pack(codes, None, pack)])
    _, first, which = np.unique(codes, return_index=True, return_inverse=True)
    known = first[which] // segment < np.arange(len(codes)) // segment
    return _rated(len(hashes), [_pack(codes[i : i + segment], known[i : i + segment], pack) for i in starts])


def blocks(rows: DataFrame, block: Column) -> DataFrame:
    """``doc``, ``block`` and ``text``: the document's texts in reading order, the latest of each place."""
    page, seq = _place()
    row = F.struct(page.alias("page"), seq.alias("seq"), F.col("extracted_at").alias("at"), F.col("element_id").alias("id"), F.col("text"))
    listed = rows.select("doc", block.alias("block"), row.alias("r")).groupBy("doc", "block").agg(F.sort_array(F.collect_list("r")).alias("r"))
    next_one = lambda i: F.get("r", i + 1)
    last = lambda x, i: next_one(i).isNull() | (next_one(i).page != x.page) | (next_one(i).seq != x.seq)
    return listed.select("doc", "block", F.array_join(F.transform(F.filter("r", last), lambda x: x.text), "\n").alias("text"))


def _place() -> tuple[Column, Column]:
    return F.coalesce(F.col("page_number"), F.lit(0)), F.coalesce(F.col("seq"), F.lit(0))


def _measure(measure_all: bool, segment: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, pack = _Hashes(), packer()
        for part in parts:
            out = []
            for doc, text in zip(part["doc"], part["text"]):
                hashes = _hash_words(words_of(text), known)
                size, _, ratio, chunk, band = compression(hashes, pack, segment)
                share = None
                if measure_all or band == REPETITIVE:
                    share = _covered(_later(_hash_runs(hashes))) / max(len(hashes), 1)
                out.append((doc, len(hashes), size, ratio, chunk, band, share))
            yield pd.DataFrame(out, columns=_COLUMNS)

    return run


_COLUMNS = ["doc", "words", "bytes", "ratio", "chunk_ratio", "band", "share"]
_SCHEMA = "doc string, words bigint, bytes bigint, ratio double, chunk_ratio double, band string, share double"


def _heads(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        found = [words_of(t) for t in part["text"]]
        yield pd.DataFrame({"doc": part["doc"], "block": part["block"], "n": [len(w) for w in found], "head": [w[: RUN - 1] for w in found]})


def _pieces(segment: int):
    """The codes of each block, cut where a segment of the document begins."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for part in parts:
            for doc, text, offset, tail in zip(part["doc"], part["text"], part["offset"], part["tail"]):
                words = words_of(text)
                codes = _hash_runs(_hash_words(words + list(tail)[: CODED - 1], known), CODED)[: len(words)]
                cuts = [0, *range(segment - offset % segment, len(codes), segment), len(codes)]
                found = [(doc, (offset + a) // segment, offset + a, codes[a:b].tobytes()) for a, b in pairwise(cuts) if a < b]
                yield pd.DataFrame(found, columns=["doc", "segment", "start", "codes"])

    return run


def _different(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for doc, segment, codes in zip(part["doc"], part["segment"], part["codes"]):
            yield pd.DataFrame({"doc": doc, "segment": segment, "code": np.unique(np.frombuffer(b"".join(codes), np.int64))})


def _packs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pack = packer()
    for part in parts:
        out = []
        for doc, codes, known in zip(part["doc"], part["codes"], part["known"]):
            found = np.frombuffer(b"".join(codes), np.uint64)
            earlier = None if known is None else np.isin(found.view(np.int64), np.asarray(known, np.int64))
            out.append((doc, *_pack(found, earlier, pack)))
        yield pd.DataFrame(out, columns=["doc", "n", "packed", "chunk_ratio", "over"])


def _bands(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        out = []
        for doc, words, segments in zip(part["doc"], part["words"], part["segments"]):
            size, _, ratio, chunk, band = _rated(words, [(s["n"], s["packed"], s["chunk_ratio"], s["over"]) for s in segments])
            out.append((doc, words, size, ratio, chunk, band))
        yield pd.DataFrame(out, columns=_COLUMNS[:-1])


def _runs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each block a row of its own repeats, and one per distinct run with its first start."""
    known = _Hashes()
    for part in parts:
        for doc, block, text, offset, tail in zip(part["doc"], part["block"], part["text"], part["offset"], part["tail"]):
            words = words_of(text)
            n = len(words)
            runs = _hash_runs(_hash_words(words + list(tail), known))[:n]
            again = _later(runs)
            once = np.setdiff1d(np.arange(len(runs)), again)
            yield pd.DataFrame({"doc": doc, "block": block, "run": [None], "start": [None], "own": [(again + offset).tolist()]}, dtype=object)
            yield pd.DataFrame({"doc": doc, "block": block, "run": runs[once].view(np.int64), "start": once + offset, "own": None})


def _figures(texts: DataFrame, placed: DataFrame, counts: DataFrame) -> DataFrame:
    """Words, compression and band of documents of several blocks."""
    codes = texts.join(placed, ["doc", "block"]).mapInPandas(_pieces(SEGMENT), "doc string, segment bigint, start bigint, codes binary")
    pieces = F.sort_array(F.collect_list(F.struct("start", "codes")))
    segments = stored(codes.groupBy("doc", "segment").agg(F.transform(pieces, lambda x: x.codes).alias("codes")))
    several = segments.filter("segment > 0").select("doc").distinct()
    different = join_small(segments, several, "doc", "left_semi").mapInPandas(_different, "doc string, segment bigint, code bigint")
    first = F.min("segment").over(Window.partitionBy("doc", "code"))
    known = different.withColumn("first", first).filter("segment > first").groupBy("doc", "segment").agg(F.collect_list("code").alias("known"))
    packs = segments.join(known, ["doc", "segment"], "left").mapInPandas(_packs, "doc string, n bigint, packed bigint, chunk_ratio double, over boolean")
    listed = packs.groupBy("doc").agg(F.collect_list(F.struct("n", "packed", "chunk_ratio", "over")).alias("segments"))
    words = counts.groupBy("doc").agg(F.sum("n").alias("words")).join(listed, "doc", "left")
    return cut(words.withColumn("segments", F.coalesce("segments", F.array())).mapInPandas(_bands, _SCHEMA.rsplit(",", 1)[0]))


def _long(texts: DataFrame, measure_all: bool) -> DataFrame:
    """As :func:`repetition`, of documents of several blocks."""
    counts = cut(shipped(texts).mapInPandas(_heads, "doc string, block bigint, n bigint, head array<string>"))
    every, counts = counts, counts.filter("n > 0")
    order = Window.partitionBy("doc").orderBy("block")
    ahead = F.flatten(F.collect_list("head").over(order.rowsBetween(1, RUN - 1)))
    placed = counts.select("doc", "block", (F.sum("n").over(order) - F.col("n")).alias("offset"), F.slice(ahead, 1, RUN - 1).alias("tail"))
    figures = _figures(texts, placed, every)
    chosen = figures if measure_all else figures.filter(F.col("band") == REPETITIVE)
    placed = join_small(placed, chosen.select("doc"), "doc", "left_semi")
    runs = texts.join(placed, ["doc", "block"]).mapInPandas(_runs, "doc string, block bigint, run bigint, start bigint, own array<bigint>")
    first = F.min("start").over(Window.partitionBy("doc", "run"))
    across = runs.filter(F.col("run").isNotNull()).withColumn("first", first).filter("start > first").select("doc", "block", F.array("start").alias("own"))
    starts = across.unionByName(runs.filter(F.col("run").isNull()).select("doc", "block", "own"))
    listed = starts.groupBy("doc", "block").agg(F.sort_array(F.flatten(F.collect_list("own"))).alias("s")).filter(F.size("s") > 0)
    gaps = F.aggregate(F.sequence(F.lit(1), F.size("s") - 1), F.lit(0).cast("bigint"), lambda a, i: a + F.least(F.get("s", i) - F.get("s", i - 1), F.lit(RUN)))
    inner = F.when(F.size("s") > 1, gaps).otherwise(0)
    to_next = F.lead(F.get("s", F.lit(0))).over(order) - F.element_at("s", -1)
    covered = listed.select("doc", (inner + F.least(F.coalesce(to_next, F.lit(RUN)), F.lit(RUN))).alias("c")).groupBy("doc").agg(F.sum("c").alias("covered"))
    share = F.when(F.col("words") > 0, F.coalesce("covered", F.lit(0)) / F.col("words")).otherwise(0.0)
    measured = F.lit(True) if measure_all else F.col("band") == REPETITIVE
    return figures.join(covered, "doc", "left").select(*_COLUMNS[:-1], F.when(measured, share).alias("share"))


def repetition(elements: DataFrame, measure_all: bool = False) -> DataFrame:
    """One row per document: ``doc``, ``words``, ``bytes``, ``ratio``, ``chunk_ratio``, ``band``, ``share``.

    ``share`` is null for documents outside the repetitive band, unless ``measure_all``.
    """
    rows = elements.filter(F.col("doc").isNotNull() & F.col("text").isNotNull()).select("element_id", "doc", "page_number", "seq", "extracted_at", "text")
    page, seq = _place()
    pages = F.floor(page / BLOCK_PAGES)
    spans = rows.groupBy("doc").agg(F.min(pages).alias("a"), F.max(pages).alias("b"), (F.max(seq) >= BLOCK_PLACES).alias("deep"))
    several = cut(spans.filter("a < b or deep").select("doc", "deep"))
    short = shipped(blocks(join_small(rows, several.select("doc"), "doc", "left_anti"), F.lit(0))).mapInPandas(_measure(measure_all, SEGMENT), _SCHEMA)
    # Pages with very many places are blocks of their own, in parts.
    part = F.when(F.col("deep"), F.shiftleft(page.cast("bigint"), 24) + F.floor(seq / BLOCK_PLACES)).otherwise(pages)
    return short.unionByName(_long(stored(blocks(join_small(rows, several, "doc"), part)), measure_all))
