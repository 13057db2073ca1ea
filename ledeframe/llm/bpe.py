"""Byte-level BPE by corpus-level merge replay.

A task takes its texts batch by batch and looks only at the distinct words, and of
those at the distinct pieces, not met before in the task. Their bytes stand in one array; an
inverted index lists, for each pair of neighbouring tokens, the positions where it
occurs, and a heap holds the ranks of the pairs present. The lowest rank is merged
at all of its positions in order, which changes the index for the touched
neighbours only, until no listed pair is left. If a merge makes a pair of a lower
rank than the one being replayed, that one goes first, so each piece sees its
merges in exactly the order of a piece-by-piece encoder.

The vocabulary is a file named by a parameter, read on the driver and sent to the
tasks: one entry per token, a fixed size. The pieces remembered by a task are
limited in number; forgetting them costs time, not results. Rows are independent,
there is no shuffle, and a lost task is simply run again.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ledeframe.llm.common import give_back, ship_code

REMEMBER = 300_000  # words or pieces a task keeps encoded
TEXTS = 3 << 20  # characters of text whose new words are encoded together
SLAB = 1 << 20  # bytes of distinct pieces that are replayed together


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of tokens that joins to a token, as left << 32 | right in order, and the rank of the whole."""
    pairs = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = rank
    keys = sorted(pairs)
    return np.array([*keys, np.iinfo(np.int64).max], np.int64), np.array([*(pairs[k] for k in keys), -1], np.int32)


def distinct(x: np.ndarray) -> np.ndarray:
    """The values of ``x`` in order, each once."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


class Vocabulary:
    """Ranks of tokens and of pairs of tokens."""

    def __init__(self, ranks: dict[bytes, int], keys: np.ndarray, joined: np.ndarray):
        self.ranks, self.keys, self.joined = ranks, keys, joined
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the tokens joined, -1 if they are no token."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.joined[at], -1)


def replay(pieces: list[bytes], words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces in a row, and where each piece's begin (one more entry at the end).

    A piece that is itself a token is that token; an empty one has none.
    """
    lengths = np.fromiter(map(len, pieces), np.int32, len(pieces))
    whole = np.fromiter((words.ranks.get(p, -1) for p in pieces), np.int32, len(pieces))
    token = words.single[np.frombuffer(b"".join(pieces), np.uint8)]
    n = len(token)
    starts = (np.cumsum(lengths) - lengths).astype(np.int32)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    filled = lengths > 0
    after[(starts + lengths - 1)[filled]] = -1
    before[starts[filled]] = -1
    rank_at = np.full(n, -1, np.int32)  # of the pair that begins at a position
    inner = np.flatnonzero((after >= 0) & np.repeat(whole < 0, lengths)).astype(np.int32)
    rank_at[inner] = words.pair(token[inner], token[inner + 1])

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def list_pairs(places: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for part, rank in zip(np.split(places, cuts), ranks[np.append(0, cuts)].tolist()):
            if rank in index:
                index[rank].append(part)
            else:
                index[rank] = [part]
                heapq.heappush(heap, rank)

    first = np.flatnonzero(rank_at >= 0).astype(np.int32)
    if len(first):
        list_pairs(first, rank_at[first])
    while heap:
        rank = heapq.heappop(heap)
        parts = index.pop(rank)
        at = parts[0] if len(parts) == 1 else distinct(np.concatenate(parts))
        at = at[rank_at[at] == rank]  # pairs that an earlier merge took apart are gone
        if not len(at):
            continue
        if len(at) > 1:
            ends = after[at]
            if (ends[:-1] == at[1:]).any():  # as in "aaa": the left one of two that overlap
                keep, taken = [], -1
                for k, (p, q) in enumerate(zip(at.tolist(), ends.tolist())):
                    if p != taken:
                        keep.append(k)
                        taken = q
                at = at[keep]
        gone = after[at]
        follow, lead = after[gone], before[at]
        right, left = at[follow >= 0], at[lead >= 0]
        ahead = words.pair(np.full(len(right), rank, np.int32), token[follow[follow >= 0]])
        behind = words.pair(token[lead[lead >= 0]], np.full(len(left), rank, np.int32))
        if len(at) > 1 and (((ahead >= 0) & (ahead < rank)).any() or ((behind >= 0) & (behind < rank)).any()):
            # A merge here makes a pair of a lower rank, which goes before the rest of this rank.
            index[rank] = [at[1:]]
            heapq.heappush(heap, rank)
            at, gone, follow, lead = at[:1], gone[:1], follow[:1], lead[:1]
        token[at], rank_at[gone] = rank, -1
        after[at] = follow
        before[follow[follow >= 0]] = at[follow >= 0]
        lead = before[at]
        rank_at[at] = -1
        has = follow >= 0
        rank_at[at[has]] = words.pair(token[at[has]], token[follow[has]])
        has = lead >= 0
        rank_at[lead[has]] = words.pair(token[lead[has]], token[at[has]])
        touched = distinct(np.concatenate([at, lead[has]]))
        touched = touched[rank_at[touched] >= 0]
        if len(touched):
            list_pairs(touched, rank_at[touched])

    head = np.zeros(n, bool)
    head[starts[filled]] = True
    live = head.copy()
    step = np.flatnonzero(head & np.repeat(whole < 0, lengths))
    while len(step):
        step = after[step]
        step = step[step >= 0]
        live[step] = True
    known = np.repeat(whole, lengths)
    token = np.where(known >= 0, known, token)
    counts = np.concatenate(([0], np.cumsum(live)))
    return token[live], np.append(counts[starts], counts[-1])


def load(spark: SparkSession, path: str) -> Broadcast:
    """The ranks of a vocabulary file and of its pairs, sent to the tasks."""
    ranks = read_ranks(path)
    return spark.sparkContext.broadcast((ranks, *pair_table(ranks)))


class Numbers(dict):
    """Gives each key not met before the next number."""

    def __missing__(self, key) -> int:
        number = self[key] = len(self)
        return number


class Encoder:
    """Encodes texts, remembering the parts met so far."""

    def __init__(self, words: Vocabulary, pattern: str, spaced: bool):
        self.words, self.find, self.spaced = words, regex.compile(pattern).findall, spaced
        self.blanks = re.compile(r"\s\s").search
        # Is a blank and letters one piece, as in the usual patterns? Then most words need no matching.
        self.letters = spaced and all(self.find(w) == [w] for w in (" a", " Straße", " été", " слово", " 中文"))
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers()
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def parts(self, text: str) -> np.ndarray:
        """Numbers of the parts of a text: its words if blanks stand alone, else its pieces. A word after a blank is
        its own key; the first word and pieces are a tuple, as they have no blank before them."""
        if self.spaced and not self.blanks(text):
            words = text.split(" ")
            keys, first = words[1:], [(words[0],)]
        else:
            keys, first = [], [(p,) for p in self.find(text)]
        number = self.numbers.__getitem__
        return np.fromiter(map(number, first + keys), np.int32, len(first) + len(keys))

    def learn(self) -> None:
        """Encodes the parts that have a number but no ids yet."""
        fresh = list(self.numbers)[len(self.bounds) - 1 :]
        pieces, flat, counts = Numbers(), [], []
        for key in fresh:
            if isinstance(key, tuple):
                found = self.find(key[0])
            elif key.isalpha() and self.letters:
                flat.append(pieces[" " + key])
                counts.append(1)
                continue
            else:
                found = self.find(" " + key)
            flat += [pieces[p] for p in found]
            counts.append(len(found))
        ids, bounds, held, size = [], [np.zeros(1, np.int64)], [], 0
        for i, piece in enumerate(pieces, 1):
            held.append(piece.encode())
            size += len(piece)
            if size >= SLAB or i == len(pieces):
                more, at = replay(held, self.words)
                bounds.append(at[1:] + bounds[-1][-1])
                ids.append(more)
                held, size = [], 0
        ids, bounds = np.concatenate(ids) if ids else self.ids[:0], np.concatenate(bounds)
        more, lengths = gather(ids, bounds, np.array(flat, np.int64))
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum(np.array(counts, np.int64))]
        self.bounds = np.concatenate([self.bounds, ends + len(self.ids)])
        self.ids = np.concatenate([self.ids, more])


def gather(ids: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the numbered rows one after the other, and how many each has."""
    lengths = bounds[rows + 1] - bounds[rows]
    ends = np.cumsum(lengths)
    return ids[np.repeat(bounds[rows] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths


def encode(docs: DataFrame, vocabulary: Broadcast, pattern: str, text_col: str = "text", out: str = "ids", spaced: bool = False) -> DataFrame:
    """``docs`` with ``out``, the token ids of the text: each match of ``pattern`` is encoded on its own,
    without special tokens. A null or empty text has no ids.

    ``spaced`` promises that no match goes on past a blank (U+0020) that stands between
    two characters other than blanks, but may begin with it; texts are then cut there,
    and only words not met before are matched.
    """
    ship_code()

    @arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(Vocabulary(*vocabulary.value), pattern, spaced)
        for batch in batches:
            rows, size = [], 0
            for k, text in enumerate(batch, 1):
                text = text.as_py() or ""
                rows.append(encoder.parts(text))
                size += len(text)
                if size >= TEXTS or k == len(batch):
                    encoder.learn()
                    ids, lengths = gather(encoder.ids, encoder.bounds, np.concatenate(rows))
                    ends = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum([0, *map(len, rows)])]
                    yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                    rows, size = [], 0
                    if len(encoder.numbers) > REMEMBER:
                        encoder.forget()
                    text = ids = lengths = ends = None
                    give_back()  # what learning took, beside what is remembered
        batch = encoder = None
        give_back()

    return docs.withColumn(out, ids_of(F.col(text_col).cast("string")))


def decode(docs: DataFrame, vocabulary: Broadcast, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with ``out``, the bytes of the ids in order; null ids give null, no ids no bytes. An id
    outside the vocabulary is an error."""
    ship_code()

    @arrow_udf("binary")
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks = vocabulary.value[0]
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        flat = np.frombuffer(b"".join(tokens), np.uint8)
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
        known = np.zeros(len(tokens), bool)
        known[list(ranks.values())] = True
        for batch in batches:
            valid, rows = batch.is_valid(), batch.offsets.to_numpy()
            ids = batch.values.to_numpy(zero_copy_only=False)
            for i in range(0, len(batch), 500):
                j = min(i + 500, len(batch))
                own = ids[rows[i] : rows[j]]
                if len(own) and (own.min() < 0 or own.max() >= len(tokens) or not known[own].all()):
                    raise ValueError("an id outside the vocabulary")
                text, lengths = gather(flat, bounds, own)
                ends = np.concatenate(([0], np.cumsum(lengths)))[rows[i : j + 1] - rows[i]]
                joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(text)])
                yield pc.if_else(valid[i:j], joined.cast(pa.binary()), None)
            batch = valid = rows = ids = own = text = lengths = ends = joined = None
        ranks = tokens = flat = bounds = known = None
        give_back()

    return docs.withColumn(out, bytes_of(F.col(ids_col)))
