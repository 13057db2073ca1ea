"""Model passes as numpy blocks inside Arrow tasks: sweeps, mini-batches and a hidden layer.

A pass sends the parameters to the tasks (a vector whose length does not grow with the
data), runs them over each Arrow batch of feature rows as one matrix, and adds up what the
model asks for. A task yields one row of sums per split; the rows are added in two
levels before the driver sees one row per split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledeframe.session import ship_code

EPS = 1e-7
FAN = 64  # tasks whose sums are added first


def _bce(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    clipped = np.clip(p, EPS, 1.0 - EPS)  # a NaN stays one
    return -(y * np.log(clipped + EPS) + (1.0 - y) * np.log(1.0 - clipped + EPS))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-z))


def _counts(p: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Per column of p: true positives, false positives, false negatives, right ones."""
    said = p > 0.5
    true = (y == 1)[:, None]
    return [(said & true).sum(0), (said & ~true).sum(0), (~said & true).sum(0), (said == true).sum(0)]


@dataclass
class Heads:
    """k logistic heads over the same d features; parameters d x k weights and k biases."""

    dim: int
    k: int

    @property
    def width(self) -> int:
        return self.k * (self.dim + 1)

    def sums(self, params: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        w, b = params[: self.dim * self.k].reshape(self.dim, self.k), params[self.dim * self.k :]
        p = _sigmoid(x @ w + b)
        slope = (p - y[:, None]) * weight[:, None]
        loss = (_bce(p, y[:, None]) * weight[:, None]).sum(0)
        return np.concatenate([(x.T @ slope).ravel(), slope.sum(0), loss, *_counts(p, y)])


@dataclass
class HiddenLayer:
    """d features, h rectified units, one sigmoid; parameters d x h, h, h and 1."""

    dim: int
    hidden: int

    k = 1

    @property
    def width(self) -> int:
        return self.hidden * (self.dim + 2) + 1

    def parts(self, params: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        d, h = self.dim, self.hidden
        return params[: d * h].reshape(d, h), params[d * h : d * h + h], params[d * h + h : d * h + 2 * h], params[d * h + 2 * h :]

    def probability(self, params: np.ndarray, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.parts(params)
        return _sigmoid(np.maximum(x @ w1 + b1, 0.0) @ w2 + b2[0])

    def sums(self, params: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.parts(params)
        units = x @ w1 + b1
        shown = np.maximum(units, 0.0)
        p = _sigmoid(shown @ w2 + b2[0])
        slope = (p - y) * weight
        back = (slope[:, None] * w2) * (units > 0)
        loss = (_bce(p, y) * weight).sum()
        return np.concatenate([(x.T @ back).ravel(), back.sum(0), shown.T @ slope, [slope.sum(), loss], *_counts(p[:, None], y)])


def block_pass(features: DataFrame, model, params, x_col: str = "x", y_col: str = "y", split_col: str = "split", weight_col: str | None = None) -> dict[str, dict]:
    """One scan: per split n (rows), weight (their sum), gradient (a vector like ``params``), loss and counts per head.

    Gradient and loss are sums over rows, each times ``weight_col`` (1 without).
    """
    ship_code()
    params = np.asarray(params, np.float64)
    dim = model.dim

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            splits = batch["split"].to_numpy(zero_copy_only=False)
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            y, weight = (batch[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in ("y", "w"))
            for split in set(splits):
                own = splits == split
                found = np.concatenate([[own.sum(), weight[own].sum()], model.sums(params, x[own], y[own], weight[own])])
                held[split] = held[split] + found if split in held else found
        yield pa.RecordBatch.from_pydict(
            {"split": pa.array(list(held), pa.string()), "sums": pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))}
        )

    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    weight = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    slim = features.select(F.col(split_col).alias("split"), F.col(y_col).cast("double").alias("y"), F.col(x_col).alias("x"), weight.alias("w"))
    rows = slim.mapInArrow(task, "split string, sums array<double>")
    rows = rows.select("split", array_to_vector("sums").alias("v"), (F.spark_partition_id() % FAN).alias("fan"))
    for keys in (["split", "fan"], ["split"]):
        rows = rows.groupBy(*keys).agg(Summarizer.sum(F.col("v")).alias("v"))
    out = {}
    for r in rows.select("split", vector_to_array("v").alias("s")).collect():
        s, m, k = np.array(r["s"]), model.width, model.k
        names = ("loss", "tp", "fp", "fn", "right")
        out[r["split"]] = {"n": s[0], "weight": s[1], "gradient": s[2 : 2 + m]} | {c: s[2 + m + i * k : 2 + m + (i + 1) * k] for i, c in enumerate(names)}
    return out


def head_row(sums: dict[str, dict], model: Heads, j: int) -> dict:
    """What ``train.epoch_pass`` returns, for head ``j`` of a block."""
    row: dict = {"train_loss": None, "val_loss": None, "gb": None, "val_accuracy": None, "val_f1": 0.0}
    train, val = sums.get("train"), sums.get("val")
    if train:
        row |= {"train_loss": train["loss"][j] / train["n"], "gb": train["gradient"][model.dim * model.k + j] / train["n"]}
        slopes = train["gradient"][: model.dim * model.k].reshape(model.dim, model.k)[:, j] / train["n"]
    for i in range(model.dim):
        row[f"g{i}"] = float(slopes[i]) if train else None
    if val:
        tp, fp, fn = (val[c][j] for c in ("tp", "fp", "fn"))
        row |= {"val_loss": val["loss"][j] / val["n"], "val_accuracy": val["right"][j] / val["n"], "val_f1": 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0}
    return {k: v if v is None else float(v) for k, v in row.items()}


def clipped(gradient: np.ndarray, clip: float | None, arrays: list[slice] | None = None) -> np.ndarray:
    """F16 over the whole vector, or over each of ``arrays`` on its own."""
    if not clip:
        return gradient
    out = gradient.copy()
    for part in arrays or [slice(None)]:
        out[part] *= min(1.0, clip / (math.sqrt(float(np.square(gradient[part]).sum())) + 1e-6))
    return out
