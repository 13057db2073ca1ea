"""BPE encoding by a depth-first walk of a trie of words.

Of two tokens that follow each other in an encoding it depends on them alone whether they may:
they may if no merge across their border would have come before the merges that made
them. So every prefix of a word has exactly one last token that goes with the last token
of what is before it, and a word's encoding is read from these last tokens, from its end back.

A task collects the distinct words of its texts, batch by batch, sorts those not met before
and walks the trie they make depth-first: a stack holds the last token of every prefix of the
current word, and the next word goes on from the prefix it shares, so a shared prefix is
computed once. Words remembered by a task are limited in number; forgetting them costs time, not results. Rows are
independent, there is no shuffle, and a lost task is simply run again.

The vocabulary is a file in the tokenizers library's format, named by a parameter, read on the driver and sent
to the tasks: a fixed size. It is meant for byte-level BPE without a normalizer, whose merges each
make a token of their own, later than those that made its two halves.
"""

from __future__ import annotations

import json
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

from ledeframe.llm.bpe import Numbers, gather
from ledeframe.llm.common import ship_code

REMEMBER = 300_000  # words a task keeps encoded
TEXTS = 3 << 21  # characters of text whose new words are walked together
VERDICTS = 1 << 19  # pairs of tokens a task keeps judged
HEAD = 32  # bytes of neighbouring words that are compared at once


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: a byte that is a visible Latin-1 character
    stands for itself, the others follow from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_vocabulary(path: str) -> dict:
    """From a tokenizer file: ``ids`` (token bytes to id), ``merges`` (id of the whole to rank and ids of the halves), ``special``
    (text of a special token to id), ``dead`` (ids of tokens that no text is encoded to)."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    alphabet, model = byte_alphabet(), whole["model"]
    names = model["vocab"]
    ids = {bytes(alphabet[c] for c in name): i for name, i in names.items()}
    merges: dict[int, tuple[int, int, int]] = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges.setdefault(names[left + right], (rank, names[left], names[right]))
    found = {"ids": ids, "merges": merges, "special": {t["content"]: t["id"] for t in whole["added_tokens"]}, "dead": set()}
    trie = Trie(found)
    # A token whose own bytes are encoded otherwise never occurs.
    found["dead"] = {i for i, (rank, left, right) in merges.items() if not trie.fits(left, right, rank)}
    return found


def load(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary, sent to the tasks."""
    return spark.sparkContext.broadcast(read_vocabulary(path))


class Trie:
    """Last tokens of prefixes, and the encodings they give."""

    def __init__(self, vocabulary: dict):
        merges = vocabulary["merges"]
        self.rank = {(left, right): rank for rank, left, right in merges.values()}
        self.merges = merges
        self.tails: dict[int, list[tuple[int, int]]] = {}
        self.heads: dict[int, list[tuple[int, int]]] = {}
        self.verdicts: dict[tuple[int, int], bool] = {}
        self.ids = {token: i for token, i in vocabulary["ids"].items() if i not in vocabulary["dead"]}
        self.lengths = {i: len(token) for token, i in self.ids.items()}
        # How long the tokens can be that end with the same three bytes, the longest first.
        tails: dict[bytes, set[int]] = {}
        for token in self.ids:
            if len(token) > 2:
                tails.setdefault(token[-3:], set()).add(len(token))
        self.sizes = {tail: (*sorted(sizes, reverse=True), *self._short(tail)) for tail, sizes in tails.items()}

    def _short(self, tail: bytes) -> tuple[int, ...]:
        return (2, 1) if len(tail) > 1 and tail[-2:] in self.ids else (1,)

    def _spine(self, token: int, side: int, held: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int]]:
        """The tokens at one end of a token while it is made: (token, rank of the merge that ends it)."""
        if token not in held:
            spine, at, end = [], token, 1 << 40
            while True:
                spine.append((at, end))
                if at not in self.merges:
                    break
                end, at = self.merges[at][0], self.merges[at][side]
            held[token] = spine
        return held[token]

    def fits(self, left: int, right: int, until: int = 1 << 40) -> bool:
        """Do the two stay apart up to the merge ``until``? They are joined by a merge across the border that comes while
        both its halves stand there; of equal ranks the one further left comes first."""
        rank = self.rank
        tails, heads = self._spine(left, 2, self.tails), self._spine(right, 1, self.heads)
        for x, x_end in tails:
            for y, y_end in heads:
                joined = rank.get((x, y))
                if joined is not None and joined < x_end and joined <= y_end and joined < until:
                    return False
        return True

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each word's begin (one more entry at the end)."""
        order = sorted(range(len(words)), key=words.__getitem__)
        ids, lengths, sizes, verdicts, fits = self.ids, self.lengths, self.sizes, self.verdicts, self.fits
        out: list[list[int]] = [[]] * len(words)
        lasts: list[int] = [-1]  # last token of each prefix of the word before
        before = b""
        for at, shared in zip(order, shared_prefixes([words[k] for k in order])):
            word = words[at]
            if shared == HEAD:
                while shared < len(word) and shared < len(before) and word[shared] == before[shared]:
                    shared += 1
            del lasts[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                tail = word[end - 3 : end] if end > 3 else word[:end]
                for size in sizes.get(tail) or self._short(tail):
                    if size > end:
                        continue
                    token = ids.get(word[end - size : end])
                    if token is None:
                        continue
                    if size == end:
                        break
                    pair = (lasts[end - size], token)
                    fine = verdicts.get(pair)
                    if fine is None:
                        fine = verdicts[pair] = fits(*pair)
                    if fine:
                        break
                lasts.append(token)
            found, end = [], len(word)
            while end:
                found.append(lasts[end])
                end -= lengths[lasts[end]]
            found.reverse()
            out[at] = found
            before = word
        if len(verdicts) > VERDICTS:
            verdicts.clear()
        bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, out), np.int64, len(out))))).astype(np.int64)
        return np.fromiter((i for row in out for i in row), np.int32, int(bounds[-1])), bounds


def shared_prefixes(words: list[bytes]) -> list[int]:
    """How many bytes each word shares with the one before, at most ``HEAD``."""
    heads = np.array([w[:HEAD] for w in words], f"S{HEAD}").view(np.uint8).reshape(-1, HEAD)
    same = np.minimum.accumulate(heads[1:] == heads[:-1], axis=1).sum(axis=1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return [0, *np.minimum(same, np.minimum(lengths[1:], lengths[:-1])).tolist()][: len(words)]


class Words:
    """The distinct words of a task and their ids."""

    def __init__(self, vocabulary: dict, pattern: str, spaced: bool):
        self.trie, self.special = Trie(vocabulary), vocabulary["special"]
        self.find, self.spaced = regex.compile(pattern).findall, spaced
        self.blanks = re.compile(r"\s\s").search
        # Is a blank and letters one piece, as in the usual patterns? Then most words need no matching.
        self.letters = spaced and all(self.find(w) == [w] for w in (" a", " Straße", " été", " слово", " 中文"))
        texts = sorted(self.special, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, texts)) + ")").split if texts else lambda text: [text]
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers()
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def parts(self, text: str) -> np.ndarray:
        """Numbers of the parts of a text. A part is a word after a blank (its key is the word), a piece (a tuple) or
        a special token (its id)."""
        keys: list = []
        for k, stretch in enumerate(self.split(text)):
            if k % 2:
                keys.append(self.special[stretch])
            elif stretch and self.spaced and not self.blanks(stretch):
                first, *rest = stretch.split(" ")
                # What ends with a blank, before a special token or the end, is cut by the pattern itself.
                if rest and not rest[-1]:
                    keys += [(p,) for p in self.find(stretch)]
                else:
                    keys += [(p,) for p in self.find(first)]
                    keys += rest
            elif stretch:
                keys += [(p,) for p in self.find(stretch)]
        return np.fromiter(map(self.numbers.__getitem__, keys), np.int32, len(keys))

    def learn(self) -> None:
        """Encodes the parts that have a number but no ids yet."""
        fresh = list(self.numbers)[len(self.bounds) - 1 :]
        pieces, flat, counts = Numbers(), [], []
        whole = {}
        for key in fresh:
            if isinstance(key, int):
                found = [key]
                whole[len(counts)] = key
                counts.append(1)
                flat.append(-1)
                continue
            if isinstance(key, tuple):
                found = key
            elif self.letters and key.isalpha():
                found = (" " + key,)
            else:
                found = self.find(" " + key)
            flat += [pieces[p] for p in found]
            counts.append(len(found))
        ids, bounds = self.trie.encode([p.encode() for p in pieces])
        special = np.array(sorted(whole.values()), np.int32)
        # Special tokens stand behind the pieces, one entry each.
        bounds = np.concatenate([bounds, bounds[-1] + np.arange(1, len(special) + 1)])
        ids = np.concatenate([ids, special])
        flat = np.array(flat, np.int64)
        if len(special):
            places = [len(pieces) + int(np.searchsorted(special, whole[k])) for k in sorted(whole)]
            flat[flat < 0] = places
        more, lengths = gather(ids, bounds, flat)
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum(np.array(counts, np.int64))] if counts else np.zeros(0, np.int64)
        self.bounds = np.concatenate([self.bounds, ends + len(self.ids)])
        self.ids = np.concatenate([self.ids, more])


def encode(docs: DataFrame, vocabulary: Broadcast, pattern: str, text_col: str = "text", out: str = "ids", spaced: bool = False) -> DataFrame:
    """``docs`` with ``out``, the token ids of the text as the tokenizers library gives them without adding special
    tokens: special tokens written in the text are cut out first and get their id, each match of ``pattern`` in
    the rest is encoded on its own. A null or empty text has no ids. Repeated rows are encoded like others, no rows give no rows.

    ``spaced`` promises that no match goes on past a blank (U+0020) that stands between
    two characters other than blanks, but may begin with it; texts are then cut there,
    and only words not met before are matched.
    """
    ship_code()

    @arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Words(vocabulary.value, pattern, spaced)
        for batch in batches:
            rows, size = [], 0
            for k, text in enumerate(batch, 1):
                text = text.as_py() or ""
                rows.append(words.parts(text))
                size += len(text)
                if size >= TEXTS or k == len(batch):
                    words.learn()
                    ids, lengths = gather(words.ids, words.bounds, np.concatenate(rows))
                    ends = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum([0, *map(len, rows)])]
                    yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                    rows, size = [], 0
                    if len(words.numbers) > REMEMBER:
                        words.forget()

    return docs.withColumn(out, ids_of(F.col(text_col).cast("string")))


def decode(docs: DataFrame, vocabulary: Broadcast, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with ``out``, the text of the ids in order, special tokens included; bytes that are no UTF-8 give U+FFFD.
    Null ids give null, no ids the empty text, an id outside the vocabulary is an error."""
    ship_code()

    @arrow_udf("string")
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = {i: token for token, i in vocabulary.value["ids"].items()} | {i: text.encode() for text, i in vocabulary.value["special"].items()}
        tokens = [known.get(i) for i in range(max(known) + 1)]
        flat = np.frombuffer(b"".join(t or b"" for t in tokens), np.uint8)
        bounds = np.concatenate(([0], np.cumsum([len(t or b"") for t in tokens])))
        real = np.array([t is not None for t in tokens])
        for batch in batches:
            rows, every = batch.offsets.to_numpy(), batch.values.to_numpy(zero_copy_only=False)
            for i in range(0, len(batch), 500):
                j = min(i + 500, len(batch))
                ids = every[rows[i] : rows[j]]
                if len(ids) and (ids.min() < 0 or ids.max() >= len(tokens) or not real[ids].all()):
                    raise ValueError("an id outside the vocabulary")
                text, lengths = gather(flat, bounds, ids)
                ends = np.concatenate(([0], np.cumsum(lengths)))[rows[i : j + 1] - rows[i]].astype(np.int64)
                joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(text)])
                try:
                    texts = joined.cast(pa.large_string()).cast(pa.string())
                except pa.ArrowInvalid:  # some bytes are no UTF-8
                    texts = pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.string())
                yield pc.if_else(batch.is_valid()[i:j], texts, None)

    return docs.withColumn(out, text_of(F.col(ids_col)))
