"""Fixed-length id sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _n(n) -> Column:
    return F.lit(n) if isinstance(n, int) else _c(n)


def truncate_sequence(ids, n) -> Column:
    """Keep the first ``n`` ids ('post' truncation)."""
    return F.slice(_c(ids), 1, _n(n))


def pad_sequence(ids, n, pad: int = 0) -> Column:
    """truncate to ``n`` then right-pad with ``pad``; an empty input is all pad."""
    nn = _n(n)
    return F.slice(F.concat(_c(ids), F.array_repeat(F.lit(pad), nn)), 1, nn)


def attention_mask(ids, n) -> Column:
    """1 for each real token, 0 for padding, decided by length (not by value)."""
    nn = _n(n)
    real = F.least(F.size(_c(ids)), nn)
    return F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), nn - real))


def frame_sequence(ids, n, cls_id: int, sep_id: int, pad: int = 0) -> Column:
    """``[cls] + ids[:n-2] + [sep]``, right-padded to ``n``."""
    nn = _n(n)
    framed = F.concat(F.array(F.lit(cls_id)), F.slice(_c(ids), 1, nn - 2), F.array(F.lit(sep_id)))
    return pad_sequence(framed, nn, pad)


def argmax_class(z) -> Column:
    """0-based index of the first largest element."""
    zc = _c(z)
    return (F.array_position(zc, F.array_max(zc)) - 1).cast("int")
