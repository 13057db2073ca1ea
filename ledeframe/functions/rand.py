"""seeded, partition-independent randomness.

A uniform in [0, 1) is derived from the md5 of ``seed|key|...``: the first 32
bits as an unsigned integer divided by 2**32.  The value depends only on the
row's key, never on partitioning or task order, so any recomputation (lost
executor, different cluster size) reproduces it, and DuckDB can compute the
same number for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(x) -> Column:
    if isinstance(x, Column):
        return x.cast("string")
    if isinstance(x, str) and not x.startswith("="):
        return F.col(x).cast("string")
    return F.lit(str(x).lstrip("="))


def seeded_bits(seed: int, *keys) -> Column:
    """Unsigned 32-bit integer (as long) from md5(seed|keys...).

    ``keys`` are column names, Columns, or literals (ints, or strings written
    as ``'=text'``).
    """
    parts = [F.lit(str(seed))] + [_part(k) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def seeded_uniform(seed: int, *keys) -> Column:
    """Uniform double in [0, 1) from md5(seed|keys...)."""
    return seeded_bits(seed, *keys).cast("double") / F.lit(4294967296.0)
