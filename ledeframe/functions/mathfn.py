"""Scalar and array math."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sigmoid(x) -> Column:
    """1 / (1 + e^-x)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def softmax_array(z) -> Column:
    """F15 (array form): softmax over the elements of one array, max-shifted.

    The max and the total are produced by ``aggregate``'s finish step, so each
    is computed once per array (lambdas get no common-subexpression sharing).
    """
    zc = _c(z)

    def with_max(m):
        ex_sum = F.aggregate(zc, F.lit(0.0), lambda a, v: a + F.exp(v - m))
        return F.aggregate(F.array(ex_sum), F.lit(0.0), lambda a, t: t, lambda tot: F.transform(zc, lambda v: F.exp(v - m) / tot))

    return F.aggregate(zc, F.lit(float("-inf")), lambda a, v: F.greatest(a, v.cast("double")), with_max)


def _sq_norm(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))


def _scale_by(arr: Column, sq_norm: Column, max_norm: float, eps: float) -> Column:
    # The norm is folded once; the finish step rescales every element with it.
    return F.aggregate(
        F.array(sq_norm),
        F.lit(0.0),
        lambda a, t: t,
        lambda sq: F.transform(
            arr,
            lambda v: v * F.coalesce(F.least(F.lit(1.0), F.try_divide(F.lit(float(max_norm)), F.sqrt(sq) + F.lit(float(eps)))), F.lit(1.0)),
        ),
    )


def clip_norm(g, max_norm: float, eps: float = 0.0) -> Column:
    """F16, per-array scope: scale ``g`` so its L2 norm is at most ``max_norm``."""
    gc = _c(g)
    return _scale_by(gc, _sq_norm(gc), max_norm, eps)


def clip_norm_global(cols, max_norm: float, eps: float = 1e-6) -> list[Column]:
    """F16, global scope: one norm over several arrays, each scaled by the same factor."""
    arrs = [_c(c) for c in cols]
    total = sum((_sq_norm(a) for a in arrs[1:]), _sq_norm(arrs[0]))
    return [_scale_by(a, total, max_norm, eps) for a in arrs]


def warmup_steps(total, share: float = 0.1) -> Column:
    """int(share * total), truncating."""
    return (F.lit(float(share)) * _c(total).cast("double")).cast("long")


def total_steps(n_rows, batch_size: int, epochs: int) -> Column:
    """batches per epoch times epochs, ceil(n / b) * e."""
    return F.ceil(_c(n_rows).cast("double") / F.lit(float(batch_size))).cast("long") * F.lit(epochs)


def total_steps_accumulated(n_rows, batch_size: int, epochs: int, accumulation: int) -> Column:
    """F18 (second form): floor(n * e / (b * a))."""
    return F.floor(_c(n_rows).cast("double") * F.lit(float(epochs)) / F.lit(float(batch_size * accumulation))).cast("long")
