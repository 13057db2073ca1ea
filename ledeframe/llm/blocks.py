"""Content-defined blocks: where equal windows of two texts must lie in comparable places.

A text is a row of symbols. Of the short grams in each window of ``size`` symbols the one
with the least hash (the left one of equals) is the window's anchor. The choice depends
on the window alone, so equal windows have equal anchors at equal offsets. Neighbouring
windows with one anchor make up a block. Hence

* a window can occur twice only if its anchor's gram is the anchor of two blocks;
* two blocks with equal grams, offsets and symbols hold the same windows throughout.

The first rule leaves few candidates, the second collapses them to distinct contents,
and only contents that share a gram need to be compared window by window. Rows are one
per block, a few dozen to a hundred windows each in running text.

Hashes are polynomial: the sum of symbol[i] * B^i modulo 2^64 over a range, moved to
the origin and mixed; two bases, each over symbols of its own, make up the 128 bits that decide equality. Modulo a
power of two there are known sequences of 1,024 symbols and more that collide for every base, so no range may
be that long: blocks have fewer than twice ``size`` symbols, ``size`` is at most ``WIDEST``, and the number of a
longer word is another hash of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

WIDEST = 512
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_PLACE = np.uint64((1 << 31) - 1)
CHUNK = 1 << 19  # bytes of text worked on at a time; a longer text is a chunk of its own


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sums:
    """Hashes of ranges of ``symbols`` to one base."""

    def __init__(self, symbols: np.ndarray, base: int):
        n = len(symbols)
        power = np.full(n + 1, base, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.back = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * power[:-1], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.back[start])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    span = 1
    n = len(x) - width + 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n])


def anchors(sums: Sums, n: int, size: int, gram: int) -> np.ndarray:
    """The anchor's place for every window start of ``n`` symbols."""
    at = np.arange(n - gram + 1)
    key = (sums.of(at, at + gram) & ~_PLACE) | at.astype(np.uint64)
    return (sliding_least(key, size - gram + 1) & _PLACE).astype(np.int64)


def split_blocks(symbols: np.ndarray, bounds: np.ndarray, size: int, gram: int) -> dict[str, np.ndarray]:
    """Blocks of the texts (two rows of symbols) that end at ``bounds`` (first 0): text number, anchor, first and last
    window start (positions in all symbols), gram hash and content hash."""
    none = {k: np.zeros(0, np.int64) for k in ("text", "anchor", "lo", "hi")} | {k: np.zeros(0, np.uint64) for k in ("gram", "content")}
    n = symbols.shape[1]
    if size > WIDEST:
        raise ValueError(f"windows of more than {WIDEST} symbols")
    if n < size:
        return none
    sums = Sums(symbols[0], BASES[0])
    anchor = anchors(sums, n, size, gram)
    ends = np.repeat(bounds[1:], np.diff(bounds))[: n - size + 1]
    whole = np.flatnonzero(np.arange(size, n + 1) <= ends)
    if not len(whole):
        return none
    anchor = anchor[whole]
    first = np.flatnonzero(np.concatenate(([True], np.diff(anchor) != 0)))
    last = np.append(first[1:], len(whole)) - 1
    lo, hi, anchor = whole[first], whole[last], anchor[first]
    content = Sums(symbols[1], BASES[1]).of(lo, hi + size)
    content = mixed(content ^ mixed(((anchor - lo) << 32 | (hi - lo)).astype(np.uint64)))
    return {
        "text": np.searchsorted(bounds, lo, "right") - 1,
        "anchor": anchor,
        "lo": lo,
        "hi": hi,
        "gram": sums.of(anchor, anchor + gram),
        "content": content,
    }


_BLANKS = np.zeros(256, bool)
_BLANKS[[9, 10, 11, 12, 13, 32]] = True


def byte_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two rows of a number for each byte, and the bounds of the texts."""
    table = mixed(np.arange(1, 257, dtype=np.uint64))
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    numbers = table[np.frombuffer(b"".join(texts), np.uint8)]
    return np.broadcast_to(numbers, (2, len(numbers))), bounds


def word_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two rows of a hash for each word, and the bounds of the texts in words."""
    joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    blank = _BLANKS[joined]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank))))
    start, end = edge[::2], edge[1::2]
    letters = mixed(np.arange(1, 257, dtype=np.uint64))[joined]
    hashes = np.stack([Sums(letters, base).of(start, end) for base in BASES])
    for k in np.flatnonzero(end - start > WIDEST).tolist():
        word = joined[start[k] : end[k]].tobytes()
        hashes[:, k] = xxhash.xxh3_64_intdigest(word, 1), xxhash.xxh3_64_intdigest(word, 2)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return hashes, np.concatenate(([0], np.searchsorted(start, ends))).astype(np.int64)


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK`` bytes."""
    start = size = 0
    for i, t in enumerate(texts, 1):
        size += len(t)
        if size >= CHUNK:
            yield start, i
            start, size = i, 0
    if start < len(texts):
        yield start, len(texts)


def merge(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges joined to maximal ones where they overlap or touch, text by text."""
    if not len(text):
        return text, start, end
    order = np.lexsort((start, text))
    text, start, end = text[order], start[order], end[order]
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(text * wide + end)
    fresh = np.concatenate(([True], (text[1:] * wide + start[1:]) > reach[:-1]))
    firsts = np.flatnonzero(fresh)
    lasts = np.append(firsts[1:], len(text)) - 1
    return text[firsts], start[firsts], reach[lasts] - text[firsts] * wide
