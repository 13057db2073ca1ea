"""Suffix-array dedup: repeated byte strings from the common-prefix interval tree.

Only blocks (see ``blocks``) whose gram occurs in several can hold a repeated string,
and blocks of equal content repeat throughout; one of each distinct content is left to
compare, and only with contents of its gram. These few strings make up a bucket. For
the buckets of a batch together an enhanced suffix array is built: their suffixes in
order, with the lengths of the common prefixes of neighbours. A scan with a stack
visits the intervals of the common-prefix tree that are at least ``size`` deep, and
keeps the left-diverse ones: not all of their suffixes are preceded by one byte (the
start of a block counts as diverse). These are the maximal repeats, each with all its
occurrences; every repeated string of ``size`` bytes lies in one of them.

A gram with very many distinct contents (a passage in very many surroundings) would make
an unbounded bucket. Beyond ``BUCKET`` contents its windows are told apart by 128-bit
hashes instead, first in stretches, then one by one, counted in Spark: the same strings,
found the other way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ledeframe.llm import blocks as B
from ledeframe.llm import repeats as R
from ledeframe.llm.common import ship_code

BUCKET = 256
SUFFIXES = 40_000  # of whole buckets, sorted at a time


def maximal_repeats(strings: list[bytes], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, string numbers, starts) of every left-diverse interval at least ``size`` deep."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    if not len(strings) or lengths.max() < size:
        return
    width = int(lengths.max())
    table = np.zeros((len(strings), 2 * width), np.uint8)
    for i, s in enumerate(strings):
        table[i, : len(s)] = np.frombuffer(s, np.uint8)
    many = np.maximum(lengths - size + 1, 0)
    string = np.repeat(np.arange(len(strings)), many)
    start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    rows = np.lib.stride_tricks.sliding_window_view(table, width, axis=1)[string, start]
    rest = lengths[string] - start
    # Suffixes in order; behind its end a suffix is filled with zeros, so of equal rows the shorter comes first.
    order = np.argsort(rest, kind="stable")
    order = order[np.argsort(rows[order].view(f"S{width}").ravel(), kind="stable")]
    rows, string, start, rest = rows[order], string[order], start[order], rest[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(rest[1:], rest[:-1]))
    # The byte before each suffix; the start of a block is like no other.
    ahead = np.where(start > 0, table[string, np.maximum(start - 1, 0)].astype(np.int64), -1 - np.arange(len(start)))
    changes = np.concatenate(([0], np.cumsum(ahead[1:] != ahead[:-1])))

    deep = np.flatnonzero(common >= size)
    stack: list[tuple[int, int]] = []  # (depth, first suffix) of the open intervals
    end = -2

    def close(depth: int, right: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Intervals deeper than ``depth`` end with suffix ``right``."""
        while stack and stack[-1][0] > depth:
            length, left = stack.pop()
            if changes[right] > changes[left]:
                yield length, string[left : right + 1], start[left : right + 1]

    for i, depth in zip(deep.tolist(), common[deep].tolist()):
        if i != end + 1:
            yield from close(0, end + 1)
        left = next((first for deeper, first in stack if deeper > depth), i)
        yield from close(depth, i)
        if not stack or stack[-1][0] < depth:
            stack.append((depth, left))
        end = i
    yield from close(0, end + 1)


def block_strings(size: int):
    """For mapInArrow over (did, tid, text, places of struct gram, lo, hi): gram, did, tid, lo, string of each."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = R.keys_of(batch)
            cuts, places = batch.column(R.PLACES).offsets.to_numpy(), batch.column(R.PLACES).values
            gram, lo, hi = (places.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            owner = np.repeat(np.arange(len(keys)), np.diff(cuts))
            texts = R.texts_of(batch.column(R.TEXT))
            gram, lo, hi = (x[cuts[0] : cuts[-1]] for x in (gram, lo, hi))
            for i in range(0, len(owner), 20_000):
                s = slice(i, i + 20_000)
                strings = [texts[t][a : b + size] for t, a, b in zip(owner[s].tolist(), lo[s].tolist(), hi[s].tolist())]
                yield pa.record_batch({"gram": pa.array(gram[s])} | R.key_columns(keys[owner[s]]) | {"lo": pa.array(lo[s]), "string": pa.array(strings, pa.binary())})

    return rows_of


def occurrences(size: int):
    """For mapInArrow over (bucket of struct did, tid, lo, string): repeat, did, tid, start, end, one row per
    occurrence of a maximal repeat; ``repeat`` numbers the repeats within their batch."""

    def of(rows: list[list[dict]]) -> pa.RecordBatch:
        members = [m for row in rows for m in row]
        keys = np.array([[m[k] for k in R.DOC] for m in members], np.int64).reshape(-1, len(R.DOC))
        lo = np.array([m["lo"] for m in members], np.int64)
        found = list(maximal_repeats([m["string"] for m in members], size))
        counts = [len(s) for _, s, _ in found]
        string = np.concatenate([s for _, s, _ in found]) if found else np.zeros(0, np.int64)
        start = np.concatenate([a for _, _, a in found]) if found else np.zeros(0, np.int64)
        length = np.repeat([n for n, _, _ in found], counts).astype(np.int64)
        at = lo[string] + start if len(members) else start
        return pa.record_batch(
            {"repeat": pa.array(np.repeat(np.arange(len(found)), counts).astype(np.int64))}
            | R.key_columns(keys[string])
            | {"start": pa.array(at), "end": pa.array(at + length)}
        )

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, many = [], 0
            for bucket in batch.column(0):
                held.append(bucket.as_py())
                many += sum(max(0, len(m["string"]) - size + 1) for m in held[-1])
                if many >= SUFFIXES:
                    yield of(held)
                    held, many = [], 0
            if held:
                yield of(held)

    return rows_of


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 200) -> DataFrame:
    """Ranges of bytes (did, tid, start, end), overlapping, of strings of ``size`` bytes or more that occur twice."""
    ship_code()
    rows = R.keyed(docs, id_col, text_col)
    gram = max(1, size // 2)
    blocks = R.candidate_blocks(rows, B.byte_symbols, size, gram, first_stays=False)
    range_ = lambda end: [*R.DOC, F.col("lo").alias("start"), end.alias("end")]
    local = blocks.where("gram is null").select(*range_(F.col("hi")))
    members, classes = R.contents(blocks)
    copied = members.join(classes.where("copied").select("gram", "content"), ["gram", "content"]).select(*range_(F.col("hi") + size))
    rows = rows.drop("doc_id")
    own = classes.where("kinds > 1").select("gram", "kinds", "first.*")

    few = own.where(F.col("kinds") <= BUCKET).select(*R.DOC, F.struct("gram", "lo", "hi").alias("place"))
    strings = R.with_places(rows, few, "places").mapInArrow(block_strings(size), f"gram long, {R.DOC_SCHEMA}, lo long, string binary")
    buckets = strings.groupBy("gram").agg(F.collect_set(F.struct(*R.DOC, "lo", "string")).alias("bucket"))
    repeats = buckets.select("bucket").mapInArrow(occurrences(size), f"repeat long, {R.DOC_SCHEMA}, start long, end long")

    many = own.where(F.col("kinds") > BUCKET).select(*R.DOC, F.struct("lo", "hi").alias("place"))
    stretches = R.with_places(rows, many, "places").mapInArrow(R.stretch_rows(B.byte_symbols, size, gram), R.STRETCH_SCHEMA)
    hashed = R.shared_ranges(stretches, size)
    return local.unionByName(copied).unionByName(repeats.select(*R.DOC, "start", "end")).unionByName(hashed)


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 200) -> DataFrame:
    """One row per row of ``docs``: doc_id, spans (maximal removed ranges of bytes, in order), n_bytes, n_removed
    and kept (the other bytes, binary).

    Null texts are empty; texts of fewer than ``size`` bytes keep all. Overlapping
    occurrences within one text count. Rows that repeat an id with the same text are
    one document, which is not a repeat of itself. Strings never span two texts.
    """
    rows = R.keyed(docs, id_col, text_col)
    listed = R.with_ranges(rows, repeated_ranges(docs, id_col, text_col, size))
    ship_code()

    @arrow_udf("struct<spans:array<struct<start:bigint,end:bigint>>,n_bytes:bigint,n_removed:bigint,kept:binary>")
    def cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(R.texts_of(texts), ranges):
            spans, kept = [], text
            if len(found):
                start, end = (np.asarray(found.values.field(k)) for k in (0, 1))
                _, a, b = B.merge(np.zeros(len(start), np.int64), start, end)
                spans = [{"start": i, "end": j} for i, j in zip(a.tolist(), b.tolist())]
                edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(text)]
                kept = b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2]))
            out.append({"spans": spans, "n_bytes": len(text), "n_removed": len(text) - len(kept), "kept": kept})
        return pa.array(out, pa.struct([("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())]))

    return listed.select("doc_id", cut("text", "ranges").alias("_")).select("doc_id", "_.*")
