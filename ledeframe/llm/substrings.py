"""Substring dedup: Rabin-Karp hashes of every window of words; later copies of a window go.

Each word is a pair of numbers and each window of ``size`` words a pair of polynomial hashes of them
(128 bits), all from running sums. Windows that cannot be repeated, because
the gram they are anchored at occurs in no other block, and blocks whose whole content
is repeated are settled without sending their windows; the windows of the distinct
contents left are counted in Spark, and every window that is not the first of its
hash is marked. Marked windows merge into maximal removal intervals.

First means least (id, start): of equal blocks the first holds the first of each of
its windows, so only the first of each content need be compared.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ledeframe.llm import blocks as B
from ledeframe.llm import repeats as R
from ledeframe.llm.common import ship_code

GRAM = 6


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20) -> DataFrame:
    """Ranges of words (did, tid, start, end), overlapping, of windows whose words also start earlier."""
    rows = R.keyed(docs, id_col, text_col)
    gram = min(GRAM, size)
    blocks = R.candidate_blocks(rows, B.word_symbols, size, gram, first_stays=True)
    local = blocks.where("gram is null").select(*R.DOC, F.col("lo").alias("start"), F.col("hi").alias("end"))
    members, classes = R.contents(blocks)
    first = [f"first.{k}" for k in R.DOC]
    copied = classes.where("copied").select("gram", "content", "first")
    later = members.join(copied, ["gram", "content"]).where(F.struct(*R.DOC, "lo") > F.struct(*first, "first.lo"))
    later = later.select(*R.DOC, F.col("lo").alias("start"), (F.col("hi") + size).alias("end"))
    open_ = classes.where("kinds > 1").select(*first, F.struct("first.lo", "first.hi").alias("place"))
    # doc_id comes along unread, last: these are the columns that ``remove_repeats`` shuffles, so the texts are shuffled once.
    placed = R.with_places(rows, open_, "places").select(*R.DOC, "text", "places", "doc_id")
    windows = placed.mapInArrow(R.window_rows(B.word_symbols, size), R.WINDOW_SCHEMA)
    repeated = R.first_windows(windows).where(F.struct(*R.DOC, "at") > F.col("first"))
    return local.unionByName(later).unionByName(repeated.select(*R.DOC, F.col("at").alias("start"), (F.col("at") + size).alias("end")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, spans (removal intervals in words, end exclusive, in order),
    n_words, n_removed and kept (the other words, joined by one blank).

    Null texts and texts of fewer than ``size`` words keep all their words. Rows that
    repeat an id with the same text are one document: none makes the other a repeat.
    Of an id with several texts the order among them is by a hash of the text.
    """
    rows = R.keyed(docs, id_col, text_col)
    listed = R.with_ranges(rows, later_windows(docs, id_col, text_col, size))
    ship_code()

    @arrow_udf("struct<spans:array<struct<start:bigint,end:bigint>>,n_words:bigint,n_removed:bigint,kept:string>")
    def cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts, ranges):
            words, spans, removed = text.as_py().encode().split(), [], 0
            if len(found):
                start, end = (np.asarray(found.values.field(k)) for k in (0, 1))
                _, a, b = B.merge(np.zeros(len(start), np.int64), start, end)
                spans = [{"start": i, "end": j} for i, j in zip(a.tolist(), b.tolist())]
                total = len(words)
                edges = [0, *(x for s in spans for x in (s["start"], s["end"])), total]
                words = [w for i, j in zip(edges[::2], edges[1::2]) for w in words[i:j]]
                removed = total - len(words)
            out.append({"spans": spans, "n_words": len(words) + removed, "n_removed": removed, "kept": b" ".join(words).decode()})
        return pa.array(out, pa.struct([("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    return listed.select("doc_id", cut("text", "ranges").alias("_")).select("doc_id", "_.*")
