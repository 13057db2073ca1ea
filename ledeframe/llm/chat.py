"""Chat formatting with built-in functions only.

Logged conversations are often snapshots: the same dialogue saved after each turn. Every
turn gets a digest of its role and text; the sum of the digests, each mixed with its
position, over a conversation's first n turns is the rolling hash of that prefix (two
sums of 64 mixed bits). A conversation whose whole hash is a proper prefix hash of
another is dropped by an anti-join, of equal conversations the least id stays, and
only the conversations that remain are rendered.

Only digests move for the comparison, counted with partial aggregation, so a first turn
that a third of all conversations share costs one row per task. A conversation's own
turns meet in one place, as its rendered text is one row in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|start|>", "<|end|>"


def _half(seed: int, *cols: Column) -> list[Column]:
    """Two numbers of 32 bits: sums of up to 2^31 of them fit a long."""
    h = F.xxhash64(F.lit(seed), *cols)
    return [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]


def prefix_hashes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n (position from 1), turns (of the conversation) and prefix, the hash of turns 1 to n."""
    body = F.concat(F.coalesce(F.col(role), F.lit("")), F.lit("\0"), F.coalesce(F.col(text), F.lit("")))
    slim = turns.where(F.col(conv).isNotNull()).select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.md5(body).alias("digest"))
    order = Window.partitionBy("conv_id").orderBy("turn", "digest")
    numbered = slim.select("conv_id", F.row_number().over(order).alias("n"), "turn", "digest")
    parts = [*_half(1, F.col("n"), F.col("digest")), *_half(2, F.col("n"), F.col("digest"))]
    upto = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    hashes = numbered.select("conv_id", "n", *[F.sum(p).over(upto).alias(f"h{i}") for i, p in enumerate(parts)])
    last = F.lead("n").over(Window.partitionBy("conv_id").orderBy("n")).isNull()
    return hashes.withColumn("last", last)


def maximal_conversations(turns: DataFrame, **names: str) -> DataFrame:
    """conv_id of every conversation that is no prefix of another; of equal ones the least."""
    hashes = prefix_hashes(turns, **names)
    key = ["n", "h0", "h1", "h2", "h3"]
    whole = hashes.where("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    inner = hashes.where("not last").select(*key).distinct()
    return whole.join(inner, key, "left_anti").select("conv_id")


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", start: str = START, end: str = END
) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns (long), chat (string).

    chat is, for each turn, ``start`` role, a line break, the text, ``end`` and a line
    break. Turns go by number (null first) and, where numbers tie, by the md5 of role and
    text; rows repeated in full are turns like others. Null roles and texts count as
    empty. Rows with a null conversation id belong to none and are left out. No rows
    give no rows.
    """
    kept = maximal_conversations(turns, conv=conv, turn=turn, role=role, text=text)
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.md5(F.concat(role_, F.lit("\0"), text_)).alias("digest"), role_.alias("role"), text_.alias("text")).alias("t"),
    )
    chosen = rows.join(kept, "conv_id", "left_semi").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    line = lambda t: F.concat(F.lit(start), t["role"], F.lit("\n"), t["text"], F.lit(end + "\n"))
    return chosen.select("conv_id", F.size("ts").cast("long").alias("n_turns"), F.array_join(F.transform("ts", line), "").alias("chat"))
