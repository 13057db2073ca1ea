"""Reproducible text augmentation (F11, F12), driven by seeded hashes.

Each decision is a function of (seed, row id, epoch, position) only, so the
result is the same for any partitioning and on any recomputation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledeframe.functions.rand import seeded_uniform
from ledeframe.functions.text import join_words, split_words

MASK_TOKEN = "[MASK]"
TRAIN_ONLY = "train_only"


def _scope(df: DataFrame, apply_to, split_col: str = "split") -> Column | None:
    """``'train_only'`` (default): rows whose ``split`` is train when the frame has a
    split column, else every row; ``None``: every row; or any boolean Column."""
    if isinstance(apply_to, str) and apply_to == TRAIN_ONLY:
        return (F.col(split_col) == "train") if split_col in df.columns else None
    return apply_to


def delete_random_word(
    df: DataFrame,
    text_col: str,
    id_col: str,
    seed: int = 42,
    p: float = 0.3,
    min_words: int = 3,
    out: str | None = None,
    apply_to=TRAIN_ONLY,
) -> DataFrame:
    """with probability ``p``, and only for texts of more than ``min_words``
    words, delete one uniformly chosen word and rejoin with single spaces;
    otherwise keep the text unchanged.  Train rows only by default."""
    apply_to = _scope(df, apply_to)
    # Words and the chosen index are staged as columns: a lambda that refers to
    # an outer expression re-evaluates it for every element.
    staged = df.withColumn("_ws", split_words(text_col))
    n = F.size("_ws")
    coin = seeded_uniform(seed, id_col, "=coin")
    staged = staged.withColumn("_k", F.floor(seeded_uniform(seed, id_col, "=pick") * n).cast("int"))
    hit = (coin < F.lit(p)) & (n > F.lit(min_words))
    if apply_to is not None:
        hit = hit & apply_to
    dropped = join_words(F.filter("_ws", lambda w, i: i != F.col("_k")))
    return staged.withColumn(out or text_col, F.when(hit, dropped).otherwise(F.col(text_col))).drop("_ws", "_k")


def mask_random_tokens(
    df: DataFrame,
    tokens_col: str,
    id_col: str,
    epoch: int | str = 1,
    seed: int = 42,
    row_p: float = 0.5,
    token_p: float = 0.1,
    mask: str = MASK_TOKEN,
    out: str | None = None,
    apply_to=TRAIN_ONLY,
) -> DataFrame:
    """for a share ``row_p`` of rows per epoch, replace each token by ``mask``
    with probability ``token_p`` (draw <= p masks).  ``epoch`` is a number or a
    column name.  Train rows only by default (the reference also masked
    validation rows: pass ``apply_to=None`` for that)."""
    apply_to = _scope(df, apply_to)
    ep = epoch if isinstance(epoch, str) else f"={epoch}"
    row_hit = seeded_uniform(seed, id_col, ep, "=row") < F.lit(row_p)
    if apply_to is not None:
        row_hit = row_hit & apply_to
    masked = F.transform(
        F.col(tokens_col),
        lambda t, i: F.when(seeded_uniform(seed, id_col, ep, i) <= F.lit(token_p), F.lit(mask)).otherwise(t),
    )
    return df.withColumn(out or tokens_col, F.when(row_hit, masked).otherwise(F.col(tokens_col)))
