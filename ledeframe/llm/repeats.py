"""The Spark side of repeated passages: candidate blocks, distinct contents, the texts they need, and cutting.

A document is known by its id and 64 hashed bits of its text (``tid``), which
alone tell texts apart that share an id or have none; rows that repeat both are the same
document, returned for each row. Null ids count as the least.
Nothing here gathers a group: frequent grams and contents are counted with partial
aggregation and joined back by shuffle, where Spark splits a skewed key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledeframe.llm import blocks as B
from ledeframe.llm.common import ship_code, written

LEAST = -(1 << 63)
DOC = ["did", "tid"]
DOC_SCHEMA = "did long, tid long"
TEXT, PLACES = len(DOC), len(DOC) + 1  # columns of what the tasks read
SPAN = 12  # bits of a block's windows beyond the first: fewer than ``blocks.WIDEST``
Symbols = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, did, tid, text: the id, the identity and the text of every row; a null text is empty.

    The upper half of ``tid`` is the 32-bit hash that orders the texts of an id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    did = F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST))
    tid = F.shiftleft(F.hash(text).cast("long"), 32).bitwiseOR(F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)))
    return docs.select(F.col(id_col).alias("doc_id"), did.alias("did"), tid.alias("tid"), text.alias("text"))


def keys_of(batch: pa.RecordBatch) -> np.ndarray:
    """The first columns, did and tid, as rows of an array."""
    return np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(DOC))]).astype(np.int64, copy=False)


def key_columns(keys: np.ndarray) -> dict[str, pa.Array]:
    return {name: pa.array(np.ascontiguousarray(keys[:, k])) for k, name in enumerate(DOC)}


def texts_of(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def candidate_blocks(rows: DataFrame, symbols: Symbols, size: int, gram: int, first_stays: bool) -> DataFrame:
    """Blocks of ``rows`` (did, tid, text), those without a twin in their chunk of texts.

    Columns: did, tid, lo, hi (first and last window start, in symbols of the text), gram, content. Of blocks
    that are equal within a chunk one is kept, the first by did and place; the others'
    windows are known to be repeated and come merged as rows with a null gram, lo to
    hi then being a range to remove. Unless ``first_stays`` the kept one's is among them.
    """
    ship_code()

    def part(keys: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
        values, bounds = symbols(texts)
        found = B.split_blocks(values, bounds, size, gram)
        text, lo, hi = found["text"], found["lo"], found["hi"]
        order = np.lexsort((lo, *keys[text].T[::-1], found["content"], found["gram"]))
        g, c = found["gram"][order], found["content"][order]
        fresh = np.concatenate(([True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])))[: len(g)]
        group = np.cumsum(fresh) - 1
        shared = (np.bincount(group)[group] > 1) if len(g) else fresh
        keep, gone = order[fresh], order[shared if not first_stays else ~fresh]
        t, a, b = B.merge(text[gone], lo[gone], hi[gone] + size)
        base, base2 = bounds[text[keep]], bounds[t]
        column = lambda x, y: pa.array(np.concatenate([x, y]))
        hashes = lambda x: pa.concat_arrays([_signed(x), pa.nulls(len(t), pa.int64())])
        return pa.record_batch(
            key_columns(keys[np.concatenate([text[keep], t])])
            | {
                "lo": column(lo[keep] - base, a - base2),
                "hi": column(hi[keep] - base, b - base2),
                "gram": hashes(found["gram"][keep]),
                "content": hashes(found["content"][keep]),
            }
        )

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = keys_of(batch), texts_of(batch.column(TEXT))
            once = {key: k for k, key in reversed(list(enumerate(map(tuple, keys.tolist()))))}
            if len(once) < len(texts):  # rows of one document
                rows_ = sorted(once.values())
                keys, texts = keys[rows_], [texts[k] for k in rows_]
            for i, j in B.chunks(texts):
                yield part(keys[i:j], texts[i:j])

    return rows.select(*DOC, "text").mapInArrow(blocks_of, f"{DOC_SCHEMA}, lo long, hi long, gram long, content long")


def contents(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes): the blocks whose gram occurs in two blocks or more; and one row per distinct
    content of them: gram, content, first (least did, tid, lo, hi), copied (it has another place), and
    kinds, the number of contents of its gram."""
    at = F.shiftleft("lo", SPAN).bitwiseOR(F.col("hi") - F.col("lo")).alias("at")  # slim rows: these are shuffled
    own = blocks.where(F.col("gram").isNotNull()).select("gram", "content", *DOC, at)
    common = own.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    members = written(own.join(common, "gram"))
    lo = lambda at: F.shiftright(at, SPAN)
    hi = lambda at: F.shiftright(at, SPAN) + F.col(at).bitwiseAND(F.lit((1 << SPAN) - 1))
    place = F.struct(*DOC, "at")
    classes = members.groupBy("gram", "content").agg(F.min(place).alias("place"), (F.min(place) < F.max(place)).alias("copied"))
    first = F.struct(*[F.col(f"place.{k}").alias(k) for k in DOC], lo("place.at").alias("lo"), hi("place.at").alias("hi"))
    kinds = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"))
    classes = written(classes.join(kinds, "gram")).select("gram", "content", first.alias("first"), "copied", "kinds")
    return members.select("gram", "content", *DOC, lo("at").alias("lo"), hi("at").alias("hi")), classes


def with_places(rows: DataFrame, places: DataFrame, name: str, how: str = "inner") -> DataFrame:
    """``rows`` (did, tid, text) with the array ``name`` of all structs that ``places`` (did, tid, place) has
    for the document: as many as the text has places, however frequent their contents are."""
    lists = places.groupBy(*DOC).agg(F.collect_list("place").alias(name))
    return rows.join(lists, DOC, how)


def first_windows(windows: DataFrame) -> DataFrame:
    """Rows (w1, w2, did, tid, at) with ``first``, the least (did, tid, at) of their 128-bit hash, where it occurs again."""
    first = F.min(F.struct(*DOC, "at")).alias("first")
    common = windows.groupBy("w1", "w2").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return windows.join(common, ["w1", "w2"])


def window_rows(symbols: Symbols, size: int) -> Callable:
    """For mapInArrow over (did, tid, text, places of struct lo, hi): w1, w2, did, tid, at of each window there."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, places = keys_of(batch), texts_of(batch.column(TEXT)), batch.column(PLACES)
            cuts = places.offsets.to_numpy()
            lo, hi = (places.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, j in B.chunks(texts):
                values, bounds = symbols(texts[i:j])
                per = np.diff(cuts[i : j + 1])
                text = np.repeat(np.arange(j - i), per)
                part = slice(cuts[i], cuts[j])
                many = hi[part] - lo[part] + 1
                which = np.repeat(text, many)
                at = np.repeat(lo[part] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                start = bounds[which] + at
                w1, w2 = (B.Sums(row, base).of(start, start + size) for row, base in zip(values, B.BASES))
                for k in range(0, max(len(at), 1), 100_000):
                    s = slice(k, k + 100_000)
                    yield pa.record_batch({"w1": _signed(w1[s]), "w2": _signed(w2[s])} | key_columns(keys[i:j][which[s]]) | {"at": pa.array(at[s])})

    return rows_of


WINDOW_SCHEMA = f"w1 long, w2 long, {DOC_SCHEMA}, at long"
STRETCH = 16


def stretch_rows(symbols: Symbols, size: int, gram: int) -> Callable:
    """For mapInArrow over (did, tid, text, places of struct lo, hi): the windows of each place in stretches of
    up to ``STRETCH``, cut at places that count from the anchor, so that equal windows fall into like stretches:
    s1, s2 (hash of all symbols), did, tid, at (of the first window) and ws, the windows' (w1, w2)."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, places = keys_of(batch), texts_of(batch.column(TEXT)), batch.column(PLACES)
            cuts = places.offsets.to_numpy()
            lo, hi = (places.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, j in B.chunks(texts):
                values, bounds = symbols(texts[i:j])
                part = slice(cuts[i], cuts[j])
                text = np.repeat(np.arange(j - i), np.diff(cuts[i : j + 1]))
                a, b = lo[part], hi[part]
                sums = [B.Sums(row, base) for row, base in zip(values, B.BASES)]
                c = B.anchors(sums[0], values.shape[1], size, gram)[bounds[text] + a] - bounds[text]
                # Stretch k of a place holds the windows whose distance from the anchor is in [16 k, 16 k + 16).
                first, last = (c - b) // STRETCH, (c - a) // STRETCH
                many = last - first + 1
                which = np.repeat(np.arange(len(a)), many)
                k = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
                start = np.maximum(a[which], c[which] - STRETCH * k - STRETCH + 1)
                end = np.minimum(b[which], c[which] - STRETCH * k)
                owner = text[which]
                at, to = bounds[owner] + start, bounds[owner] + end
                whole = [B.mixed(s.of(at, to + size) ^ B.mixed((end - start).astype(np.uint64))) for s in sums]
                count = end - start + 1
                offsets = np.concatenate(([0], np.cumsum(count)))
                window = np.repeat(at - offsets[:-1], count) + np.arange(offsets[-1])
                hashes = pa.StructArray.from_arrays([_signed(s.of(window, window + size)) for s in sums], ["w1", "w2"])
                yield pa.record_batch(
                    {"s1": _signed(whole[0]), "s2": _signed(whole[1])}
                    | key_columns(keys[i:j][owner])
                    | {
                        "at": pa.array(start),
                        "ws": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), hashes),
                    }
                )

    return rows_of


STRETCH_SCHEMA = f"s1 long, s2 long, {DOC_SCHEMA}, at long, ws array<struct<w1:bigint,w2:bigint>>"


def shared_ranges(stretches: DataFrame, size: int) -> DataFrame:
    """Ranges (did, tid, start, end) of the windows of ``stretches`` that occur at another place too.

    Equal stretches are settled as a whole; of each distinct one the windows are counted once."""
    place = F.struct(*DOC, "at")
    kinds = stretches.groupBy("s1", "s2").agg((F.min(place) < F.max(place)).alias("whole"), F.min(F.struct(*DOC, "at", "ws")).alias("first"))
    kinds = written(kinds)
    whole = stretches.join(kinds.where("whole").select("s1", "s2"), ["s1", "s2"])
    whole = whole.select(*DOC, F.col("at").alias("start"), (F.col("at") + F.size("ws") - 1 + size).alias("end"))
    windows = kinds.select(*[f"first.{k}" for k in DOC], "first.at", "whole", F.posexplode("first.ws").alias("k", "w"))
    windows = windows.select("w.w1", "w.w2", *DOC, (F.col("at") + F.col("k")).alias("at"), "whole")
    common = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
    parts = windows.where("not whole").join(common, ["w1", "w2"])
    return whole.unionByName(parts.select(*DOC, F.col("at").alias("start"), (F.col("at") + size).alias("end")))


def with_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """``rows`` (did, tid, text) with ``ranges``, all ranges (struct start, end) that ``ranges``
    (did, tid, start, end) has for the document; an empty array without any."""
    place = ranges.select(*DOC, F.struct("start", "end").alias("place"))
    listed = with_places(rows, place, "ranges", "left")
    return listed.withColumn("ranges", F.coalesce(F.col("ranges"), F.array().cast("array<struct<start:bigint,end:bigint>>")))
