"""A keyed permutation of 0..n-1 in closed form: shuffles without a sort (O2)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledeframe.functions.rand import seeded_bits

HALF_ROUNDS = 6
WALKS = 3  # steps tried for every row before the loop that a few rows may need


def grid(n: int) -> tuple[int, int]:
    """Two factors whose product is n or a little more."""
    a = max(1, math.isqrt(n - 1) + 1) if n else 1
    return a, max(1, -(-n // a))


def permuted(index: Column, n: int, seed: int, *salt) -> Column:
    """The place of ``index`` (0..n-1) in the order that (seed, salt) names; a bijection of 0..n-1.

    Feistel rounds over an a x b grid: the row number moves by a hash of the column number, then the column by a hash
    of the row, and so on; each half round can be undone, so the whole is a permutation of the grid. The grid
    has at most a - 1 cells too many; who lands there walks on until it is back (cycle walking).
    """
    a, b = grid(n)

    def half(cell, k):
        row, column = cell["r"], cell["c"]
        moved = F.struct(
            F.when(k % 2 == 1, (row + seeded_bits(seed, *salt, k, column)) % a).otherwise(row).alias("r"),
            F.when(k % 2 == 0, (column + seeded_bits(seed, *salt, k, row)) % b).otherwise(column).alias("c"),
        )
        return moved

    def once(x):
        start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("r"), (x % b).cast("long").alias("c"))
        if n > 1 << 52:  # beyond what a division of doubles keeps
            start = F.struct(((x - x % b) / F.lit(b)).cast("long").alias("r"), (x % b).cast("long").alias("c"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(HALF_ROUNDS)), start, half, lambda cell: cell["r"] * b + cell["c"])

    walk = lambda x, _: F.when(x >= n, once(x)).otherwise(x)
    near = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(index.cast("long")), walk)
    if a * b == n:
        return near
    return F.when(near < n, near).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n)), near, walk))
