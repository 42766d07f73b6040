"""A vectorised structural index of JSON texts.

Many JSON texts are indexed at once: bitmaps of quotes, brackets and delimiters over one byte
buffer, nesting depth by prefix sums, spans by pairing, and no parser loop over characters. The
grammar is checked on the same arrays, so that a text that is not valid JSON has no nodes.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OBJECT, ARRAY, STRING, SCALAR, NULL = range(5)

# Token classes.
_OPEN_O, _OPEN_A, _CLOSE_O, _CLOSE_A, _COMMA, _COLON, _QUOTE, _WORD = range(1, 9)
_CLASS = np.zeros(256, np.uint8)
for _c, _k in zip(b"{[}],:", range(1, 7)):
    _CLASS[_c] = _k
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r")] = True
_ESCAPE = np.zeros(256, bool)
_ESCAPE[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_WORD_FORM = r"^(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)$"


@dataclass
class Nodes:
    """All values of a set of JSON texts in document order, as parallel arrays."""

    data: bytes
    text: np.ndarray  # number of the text that the value belongs to
    kind: np.ndarray  # OBJECT .. NULL
    start: np.ndarray  # span in data; a string's span leaves the quotes out
    end: np.ndarray
    parent: np.ndarray  # node number, -1 for a root
    place: np.ndarray  # 1-based place among the values of its parent
    key: np.ndarray  # number in keys, -1 outside objects
    keys: list[str]

    def __len__(self) -> int:
        return len(self.kind)

    def raw(self, node: int) -> bytes:
        return self.data[self.start[node] : self.end[node]]

    def string(self, node: int) -> str:
        """The value of a string node, or the JSON text of another."""
        raw = self.raw(node)
        if self.kind[node] == STRING and b"\\" in raw:
            return json.loads(b'"' + raw + b'"')
        return raw.decode("utf-8", "surrogatepass")

    def children(self, nodes: np.ndarray, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Child nodes of ``nodes`` in order, and for each the index of its parent in ``nodes``."""
        where = np.full(len(self) + 1, -1, np.int64)
        where[nodes] = np.arange(len(nodes))
        of = where[self.parent]
        kids = np.flatnonzero(of >= 0)
        return kids, of[kids]

    def member(self, nodes: np.ndarray, *names: str) -> np.ndarray:
        """For each object in ``nodes`` its member of one of these names, the last if repeated, else -1."""
        codes = [i for i, k in enumerate(self.keys) if k in names]
        out = np.full(len(nodes), -1, np.int64)
        if not codes or not len(nodes):
            return out
        kids, of = self.children(nodes)
        hit = np.isin(self.key[kids], codes)
        out[of[hit]] = kids[hit]  # in order, so the last stays
        return out


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans as one Arrow string array, copied without a Python loop."""
    size = (end - start).astype(np.int64)
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - start, size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data[at].tobytes()))


def index(texts: list[bytes]) -> tuple[Nodes, np.ndarray]:
    """Nodes of all valid texts, and for each text whether it is valid JSON (RFC 8259)."""
    n = len(texts)
    data = b"\n".join(texts) + b"\n"
    a = np.frombuffer(data, np.uint8)
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, n)
    first = np.zeros(n + 1, np.int64)
    np.cumsum(size, out=first[1:])
    good = np.ones(n, bool)

    def spoil(positions: np.ndarray) -> None:
        good[np.searchsorted(first, positions, "right") - 1] = False

    # Quotes: one that follows an odd run of backslashes is escaped.
    slash = a == 92
    opener = np.zeros(0, np.int64)
    quote = a == 34
    if slash.any():
        at = np.flatnonzero(slash)
        begins = np.r_[True, np.diff(at) > 1]
        run = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        opener = at[run % 2 == 0]  # a backslash that escapes what follows
        quote[opener + 1] = False
    # Inside a string: an odd number of quotes since the text began.
    seen = np.cumsum(quote, dtype=np.int32)
    base = np.r_[0, seen[first[1:] - 1]].astype(np.int32)
    good &= (np.diff(base) % 2) == 0
    inside = ((seen - np.repeat(base[:-1], size)) & 1).astype(bool)
    content = inside & ~quote
    spoil(np.flatnonzero(content & (a < 32)))
    if len(opener):
        opener = opener[content[opener]]
        spoil(opener[~_ESCAPE[a[opener + 1]]])
        u = opener[a[opener + 1] == 117]
        for k in range(2, 6):
            at = np.minimum(u + k, len(a) - 1)
            spoil(u[~(_HEX[a[at]] & content[at])])
    outside = ~inside & ~quote
    mark = outside & (_CLASS[a] > 0)
    word = outside & ~mark & ~_SPACE[a]
    word_start = word.copy()
    word_start[1:] &= ~word[:-1]
    word_end = np.flatnonzero(word & ~np.r_[word[1:], False]) + 1

    pos = np.flatnonzero(mark | word_start | (quote & inside))
    kind = _CLASS[a[pos]]
    kind[a[pos] == 34] = _QUOTE
    kind[kind == 0] = _WORD
    end = pos + 1
    end[kind == _WORD] = word_end
    closing = np.flatnonzero(quote & ~inside)
    opening = pos[kind == _QUOTE]
    nearest = np.searchsorted(closing, opening)
    end[kind == _QUOTE] = np.r_[closing, len(a)][nearest]
    of = np.searchsorted(first, pos, "right") - 1

    # Depth by prefix sums; a text whose depth goes below zero or does not return is invalid.
    step = np.where(kind <= _OPEN_A, 1, np.where(kind <= _CLOSE_A, -1, 0)).astype(np.int32)
    depth = np.cumsum(step, dtype=np.int64)
    total = np.bincount(of, weights=step, minlength=n)
    before = np.r_[0, np.cumsum(total)][:-1].astype(np.int64)
    depth -= before[of]
    good &= total == 0
    good[of[depth < 0]] = False
    good &= np.bincount(of, minlength=n) > 0
    live = good[of]
    pos, kind, end, of, depth = pos[live], kind[live], end[live], of[live], depth[live]

    # The bracket around each token: the last one opened at that depth.
    count = len(pos)
    order = np.arange(count)
    is_open, is_close = kind <= _OPEN_A, (kind == _CLOSE_O) | (kind == _CLOSE_A)
    around = depth - is_open + is_close
    opens = order[is_open]
    span = max(count, 1)
    where = depth[opens] * span + opens
    by = np.argsort(where, kind="stable")
    found = np.searchsorted(where[by], around * span + order) - 1
    enclosing = np.where(around > 0, opens[by][np.maximum(found, 0)] if len(opens) else -1, -1)
    context = np.where(enclosing >= 0, kind[enclosing] if count else 0, 0)

    # Grammar, from each token's predecessor and its bracket.
    head = np.r_[True, of[1:] != of[:-1]] if count else np.zeros(0, bool)
    last = np.r_[0, kind[:-1]].astype(np.uint8)[:count]
    last[head] = 0
    key = (kind == _QUOTE) & (context == _OPEN_O) & ((last == _OPEN_O) | (last == _COMMA))
    after_key = np.r_[False, key[:-1]][:count] & ~head
    value = is_open | (kind == _QUOTE) | (kind == _WORD)
    done = ((last == _QUOTE) & ~after_key) | (last == _WORD) | (last == _CLOSE_O) | (last == _CLOSE_A)
    in_o, in_a = context == _OPEN_O, context == _OPEN_A
    ok = np.zeros(count, bool)
    ok |= value & ~in_o & ~in_a & head
    ok |= value & in_a & ((last == _OPEN_A) | (last == _COMMA))
    ok |= value & in_o & (last == _COLON)
    ok |= key
    ok |= (kind == _COMMA) & (in_o | in_a) & done
    ok |= (kind == _COLON) & in_o & after_key
    ok |= (kind == _CLOSE_O) & in_o & ((last == _OPEN_O) | done)
    ok |= (kind == _CLOSE_A) & in_a & ((last == _OPEN_A) | done)
    good[of[~ok]] = False
    words = np.flatnonzero(kind == _WORD)
    if len(words):
        form = pc.match_substring_regex(_gather(a, pos[words], end[words]), _WORD_FORM)
        good[of[words[~form.to_numpy(zero_copy_only=False)]]] = False

    # Values become nodes.
    take = np.flatnonzero(value & ~key & good[of])
    number = np.full(count + 1, -1, np.int64)
    number[take] = np.arange(len(take))
    parent = number[enclosing[take]]
    shape = np.choose(np.minimum(kind[take], 8) - 1, [OBJECT, ARRAY, 0, 0, 0, 0, STRING, SCALAR]).astype(np.uint8)
    start, stop = pos[take].copy(), end[take].copy()
    start[shape == STRING] += 1
    shape[(shape == SCALAR) & (a[start] == 110)] = NULL
    shut = np.flatnonzero(is_close & good[of])
    stop[number[enclosing[shut]]] = end[shut]
    by = np.argsort(parent, kind="stable")
    same = np.r_[False, parent[by][1:] == parent[by][:-1]] if len(by) else np.zeros(0, bool)
    place = np.zeros(len(take), np.int64)
    place[by] = np.arange(len(by)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(by)))) + 1
    named = np.flatnonzero((context[take] == _OPEN_O) & (parent >= 0))
    code, keys = np.full(len(take), -1, np.int64), []
    if len(named):
        at = take[named] - 2
        encoded = _gather(a, pos[at] + 1, end[at]).dictionary_encode()
        code[named] = encoded.indices.to_numpy()
        keys = [json.loads(f'"{k}"') if "\\" in k else k for k in encoded.dictionary.to_pylist()]
    return Nodes(data, of[take], shape, start, stop, parent, place, code, keys), good
