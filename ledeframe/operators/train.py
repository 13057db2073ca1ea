"""Training and scoring re-aimed as Spark jobs.

T1 keeps only the model on the driver (d + 1 numbers).  Each epoch is one scan of the
materialised feature table: sums per (split, label), with the weighted feature
sums from Spark ML's vector summarizer, give the gradient, losses and counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledeframe.operators.blocks import Heads, HiddenLayer, block_pass, clipped, head_row
from ledeframe.session import cut_lineage, scratch_path, ship_code


@dataclass
class TrainConfig:
    max_epochs: int = 20
    lr: float = 0.5
    patience: int = 6
    l2: float = 0.0  # A15: decay on weights, the bias is exempt
    clip: float | None = 1.0  # F16, global scope over all weights
    warmup_share: float = 0.1  # W6 over full-batch steps
    run_id: str = "run"


@dataclass
class TrainResult:
    log: list = field(default_factory=list)
    weights: list = field(default_factory=list)  # weights after each epoch: (w list, b)
    stop_epoch: int | None = None
    best_epoch: int | None = None


def lr_factors(total_steps: int, warmup_share: float) -> list[float]:
    """W6 factors for steps 0..T-1 (one full-batch step per epoch)."""
    w = int(warmup_share * total_steps)
    out = []
    for s in range(total_steps):
        if s < w:
            out.append(s / max(1, w))
        else:
            out.append(max(0.0, (total_steps - s) / max(1, total_steps - w)))
    return out


def _dot(x: Column, w: list[float], b: float) -> Column:
    wl = F.array(*[F.lit(float(v)) for v in w])
    return F.aggregate(F.arrays_zip(x.alias("x"), wl.alias("w")), F.lit(float(b)), lambda a, p: a + p["x"] * p["w"])


def score_expr(x: Column, w: list[float], b: float) -> Column:
    """T8 kernel: sigmoid(x . w + b)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_dot(x, w, b)))


def bce_expr(p: Column, y: Column, eps: float = 1e-7) -> Column:
    pc = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    yd = y.cast("double")
    loss = -(yd * F.log(pc + F.lit(eps)) + (F.lit(1.0) - yd) * F.log(F.lit(1.0) - pc + F.lit(eps)))
    return F.when(F.isnan(p), p).otherwise(loss)  # clipping would hide a NaN


def l2_penalty(w: list[float], l2: float) -> float:
    """0.5 * l2 * sum(w^2), bias exempt."""
    return 0.5 * l2 * sum(v * v for v in w)


def materialise(features: DataFrame) -> DataFrame:
    """The feature table, computed once: every epoch, listener and scoring pass reads it."""
    return cut_lineage(features)


def epoch_pass(features: DataFrame, w: list[float], b: float, dim: int, x_col: str = "x", y_col: str = "y", split_col: str = "split") -> dict:
    """One scan at (w, b): train gradient, train and validation loss, accuracy and confusion counts.

    For 0/1 labels the residual p - y has one sign per label, so the gradient is the sum of x
    weighted by |p - y| over the positives taken from that over the negatives: a weighted vector
    sum per (split, label), aggregated before its shuffle of a handful of rows."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    staged = features.select(
        split_col, F.col(y_col).cast("double").alias("_y"), array_to_vector(x_col).alias("_v"), score_expr(F.col(x_col), w, b).alias("_p")
    )
    # Weights have to be numbers, and not all zero; a NaN is in the bias gradient as well and stands for all.
    residual = F.greatest(F.nanvl(F.abs(F.col("_p") - F.col("_y")), F.lit(0.0)), F.lit(1e-300))
    groups = staged.groupBy(split_col, "_y").agg(
        F.count(F.lit(1)).alias("n"),
        vector_to_array(Summarizer.sum(F.col("_v"), residual)).alias("gx"),
        F.sum(F.col("_p") - F.col("_y")).alias("gb"),
        F.sum(bce_expr(F.col("_p"), F.col("_y"))).alias("loss"),
        F.count_if(F.col("_p") > 0.5).alias("positive"),
    ).collect()
    side = {k: [g for g in groups if g[split_col] == k] for k in ("train", "val")}
    total = {k: sum(g["n"] for g in v) for k, v in side.items()}
    mean = lambda k, f: sum(f(g) for g in side[k]) / total[k] if total[k] else None
    row = {"train_loss": mean("train", lambda g: g["loss"]), "val_loss": mean("val", lambda g: g["loss"]), "gb": mean("train", lambda g: g["gb"])}
    for j in range(dim):
        slope = mean("train", lambda g, j=j: (-1.0 if g["_y"] == 1 else 1.0) * g["gx"][j])
        row[f"g{j}"] = row["gb"] if row["gb"] is not None and math.isnan(row["gb"]) else slope
    right = lambda g: g["positive"] if g["_y"] == 1 else g["n"] - g["positive"]
    tp = sum(g["positive"] for g in side["val"] if g["_y"] == 1)
    fp = sum(g["positive"] for g in side["val"] if g["_y"] == 0)
    fn = sum(g["n"] - g["positive"] for g in side["val"] if g["_y"] == 1)
    row |= {"val_accuracy": mean("val", right), "tp": tp, "fp": fp, "fn": fn}
    row["val_f1"] = (2 * tp / (2 * tp + fp + fn)) if (2 * tp + fp + fn) else 0.0
    return row


class Run:
    """A T1 run between two scans: weights, rate schedule, best and patience. ``state`` and ``restore`` carry it
    over a restart."""

    def __init__(self, dim: int, cfg: TrainConfig):
        self.cfg, self.w, self.b, self.epoch = cfg, [0.0] * dim, 0.0, 0
        self.factors = lr_factors(cfg.max_epochs, cfg.warmup_share)
        self.best, self.since, self.res = math.inf, 0, TrainResult()

    @property
    def done(self) -> bool:
        return self.res.stop_epoch is not None or self.epoch >= self.cfg.max_epochs

    def step(self, row: dict) -> None:
        """New weights from the gradient at the current ones: L2 (A15), global clip (F16), rate."""
        cfg, w = self.cfg, self.w
        g = [(row[f"g{j}"] or 0.0) + cfg.l2 * w[j] for j in range(len(w))]
        gb = row["gb"] or 0.0
        if cfg.clip:
            norm = math.sqrt(sum(v * v for v in g) + gb * gb)
            coef = min(1.0, cfg.clip / (norm + 1e-6))
            g, gb = [v * coef for v in g], gb * coef
        self.rate = cfg.lr * self.factors[self.epoch]
        self.w = [wj - self.rate * gj for wj, gj in zip(w, g)]
        self.b -= self.rate * gb
        self.epoch += 1

    def observe(self, train_loss: float | None, row: dict) -> dict:
        """The epoch's metrics at the new weights. A missing loss is no evaluation: it neither improves nor counts."""
        res, loss = self.res, row["val_loss"]
        res.weights.append((list(self.w), self.b))
        metrics = {
            "run_id": self.cfg.run_id,
            "epoch": self.epoch,
            "train_loss": train_loss,
            "val_loss": loss,
            "val_f1": row["val_f1"],
            "val_accuracy": row["val_accuracy"],
            "lr": self.rate,
            "l2_penalty": l2_penalty(self.w, self.cfg.l2),
        }
        res.log.append(metrics)
        if loss is not None and loss < self.best:
            self.best, self.since, res.best_epoch = loss, 0, self.epoch
        elif loss is not None:
            self.since += 1
            if self.since >= self.cfg.patience:
                res.stop_epoch = self.epoch
        return metrics

    def state(self) -> dict:
        return {
            "epoch": self.epoch, "best": self.best, "since": self.since, "best_epoch": self.res.best_epoch, "stop_epoch": self.res.stop_epoch,
            "weights": [{"w": w, "b": b} for w, b in self.res.weights], "log": self.res.log,
        }

    def restore(self, state: dict) -> None:
        self.epoch, self.best, self.since = state["epoch"], state["best"], state["since"]
        weights = [(list(p["w"]), p["b"]) for p in state["weights"]]
        self.res = TrainResult([dict(r) for r in state["log"]], weights, state["stop_epoch"], state["best_epoch"])
        self.w, self.b = list(weights[-1][0]), weights[-1][1]


def train_epochs(
    features: DataFrame,
    dim: int,
    cfg: TrainConfig,
    x_col: str = "x",
    y_col: str = "y",
    split_col: str = "split",
    on_epoch_end: Callable[[int, list, float, dict], None] | None = None,
    checkpoints=None,
) -> TrainResult:
    """Logistic head trained by full-batch gradient steps, one scan per epoch.

    Epoch t: take the gradient at the current weights (from the previous
    scan), add L2 (A15), clip globally (F16), step with the warm-up/decay rate
    (W6); the next scan gives validation loss/F1 at the new weights *and* the
    gradient for epoch t+1.  Stop when validation loss has not strictly
    improved for ``patience`` evaluations (W2; without validation rows there are none);
    remember the best epoch (W3). ``on_epoch_end(epoch, w, b, metrics)`` is the U5 hook.
    With ``checkpoints`` (``sinks.Checkpoints``) the run goes on from the newest whole
    checkpoint and commits one after each epoch.  ``features`` is read once per
    epoch: hand in a materialised table (``materialise``).
    """
    feats = features.select(split_col, x_col, y_col)
    run = Run(dim, cfg)
    found = checkpoints.newest() if checkpoints else None
    if found:
        run.restore(found)
    if run.done:
        return run.res
    row = epoch_pass(feats, run.w, run.b, dim, x_col, y_col, split_col)
    while not run.done:
        train_loss = row["train_loss"]
        run.step(row)
        row = epoch_pass(feats, run.w, run.b, dim, x_col, y_col, split_col)
        metrics = run.observe(train_loss, row)
        if checkpoints:
            checkpoints.commit(run.state())
        if on_epoch_end is not None:
            on_epoch_end(run.epoch, run.w, run.b, metrics)
    return run.res


def train_sweep(features: DataFrame, dim: int, configs: list[TrainConfig], x_col: str = "x", y_col: str = "y", split_col: str = "split") -> list[TrainResult]:
    """T1 runs of several configurations side by side, one scan per epoch for all of them.

    Every pass multiplies the features with a block of weight columns, one per run still
    going; a run that has stopped leaves the block. Each run's log is that of its own T1.
    """
    runs = [Run(dim, cfg) for cfg in configs]
    rows: dict[int, dict] = {}

    def scan(going: list[int]) -> None:
        block = Heads(dim, len(going))
        params = np.concatenate([np.array([runs[i].w for i in going]).T.ravel(), [runs[i].b for i in going]])
        sums = block_pass(features, block, params, x_col, y_col, split_col)
        rows.update({i: head_row(sums, block, j) for j, i in enumerate(going)})

    going = [i for i, r in enumerate(runs) if not r.done]
    while going:
        if not rows:
            scan(going)
        losses = {i: rows[i]["train_loss"] for i in going}
        for i in going:
            runs[i].step(rows[i])
        scan(going)
        for i in going:
            runs[i].observe(losses[i], rows[i])
        going = [i for i in going if not runs[i].done]
    return [r.res for r in runs]


@dataclass
class BatchConfig(TrainConfig):
    batch_size: int = 32
    accumulate: int = 1  # batches per step
    seed: int = 42


STRETCH = 1 << 22  # feature values of the steps that are run in one job


def step_tables(train: DataFrame, id_col: str, cfg: BatchConfig, epoch: int, per: int = 1) -> tuple[DataFrame, int]:
    """W7 over the epoch's shuffle, written by stretches of ``per`` steps: (table with position, batch_id, step, stretch
    and weight, number of batches).

    Files follow the shuffled positions, so a stretch reads its own files and nothing else. A
    row weighs 1 / rows of its batch, so weighted sums are sums of batch means.
    """
    from ledeframe.operators.order import shuffled_batches

    spark = train.sparkSession
    batched = shuffled_batches(train, id_col, cfg.batch_size, epoch, cfg.seed)
    batched = batched.withColumn("step", F.floor(F.col("batch_id") / F.lit(cfg.accumulate)).cast("long"))
    batched = batched.withColumn("stretch", F.floor(F.col("step") / F.lit(per)).cast("long"))
    path = scratch_path(spark, f"steps-{epoch}")
    batched.repartitionByRange("position").write.partitionBy("stretch").parquet(path)
    table = spark.read.schema(batched.schema).parquet(path)  # no file at all if there are no rows
    n = table.count()  # from the files' footers
    last = (n - 1) // cfg.batch_size
    size = F.when(F.col("batch_id") == last, F.lit(n - last * cfg.batch_size)).otherwise(F.lit(cfg.batch_size))
    return table.withColumn("weight", F.lit(1.0) / size), last + 1 if n else 0


def _moved(params: np.ndarray, gradient: np.ndarray, taken: int, rate: float, dim: int, cfg: TrainConfig) -> np.ndarray:
    """The parameters after a step on ``taken`` batches whose mean gradients add up to ``gradient``."""
    gradient = gradient / taken
    gradient[:dim] += cfg.l2 * params[:dim]
    return params - rate * clipped(gradient, cfg.clip)


def _run_stretch(rows: DataFrame, head: Heads, params: np.ndarray, taken: list[int], rates: list[float], cfg: BatchConfig, x_col: str, y_col: str) -> tuple[np.ndarray, float]:
    """(parameters, sum of losses) after the steps of one stretch, run one after the other in a task over its rows."""
    ship_code()
    dim = head.dim

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b["step"], b["position"], b["x"].flatten(), b["y"], b["weight"]) for b in batches]
        if not parts:
            return
        step, position, x, y, weight = (np.concatenate([c.to_numpy(zero_copy_only=False) for c in column]) for column in zip(*parts))
        order = np.argsort(position, kind="stable")
        step, x, y, weight = step[order], x.reshape(-1, dim)[order], y[order].astype(np.float64), weight[order]
        bounds = [*np.flatnonzero(np.diff(step, prepend=-1)), len(step)]
        now, loss = params, 0.0
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            sums = head.sums(now, x[a:b], y[a:b], weight[a:b])
            now = _moved(now, sums[: head.width], taken[i], rates[i], dim, cfg)
            loss += float(sums[head.width])
        yield pa.RecordBatch.from_pydict({"params": pa.array([now.tolist()], pa.list_(pa.float64())), "loss": [loss]})

    slim = rows.select("step", "position", F.col(x_col).alias("x"), F.col(y_col).cast("double").alias("y"), "weight")
    found = slim.coalesce(1).mapInArrow(task, "params array<double>, loss double").first()
    return np.array(found["params"]), found["loss"]


def train_minibatches(features: DataFrame, id_col: str, dim: int, cfg: BatchConfig, x_col: str = "x", y_col: str = "y", split_col: str = "split") -> TrainResult:
    """T1 over mini-batches of a shuffled loader, a new order every epoch.

    A step takes ``accumulate`` batches: the mean of their mean gradients, L2 (A15), global clip
    (F16), the rate of its step (W6 over all steps of all epochs). The epoch's train loss is the mean of
    batch means, each taken at the weights of its step (A4). After an epoch the validation rows are scored
    once; stop and best epoch are T1's. Orders come from hashes of ids, so the same steps are made for
    any partitioning. Steps follow on one another, so small ones are run in stretches of ``STRETCH``
    feature values, a job with one task each, which hands the weights on; a step above that size is a job over many
    tasks. No training rows leave the weights as they are.
    """
    train = features.filter(F.col(split_col) == "train")
    val = features.filter(F.col(split_col) == "val")
    total = train.count()
    batches = -(-total // cfg.batch_size)
    steps = -(-batches // cfg.accumulate)
    per = max(1, STRETCH // (cfg.batch_size * cfg.accumulate * dim))
    factors = lr_factors(steps * cfg.max_epochs, cfg.warmup_share)
    run, head, done = Run(dim, cfg), Heads(dim, 1), 0
    while not run.done:
        table, _ = step_tables(train, id_col, cfg, run.epoch + 1, per)
        loss, params = 0.0, np.array([*run.w, run.b])
        for stretch in range(-(-steps // per)):
            own = table.filter(F.col("stretch") == stretch)
            ahead = range(stretch * per, min(steps, (stretch + 1) * per))
            taken = [min(cfg.accumulate, batches - step * cfg.accumulate) for step in ahead]
            rates = [cfg.lr * f for f in factors[done : done + len(ahead)]]
            if per > 1:
                params, lost = _run_stretch(own, head, params, taken, rates, cfg, x_col, y_col)
            else:
                sums = block_pass(own, head, params, x_col, y_col, split_col, "weight")["train"]
                params, lost = _moved(params, sums["gradient"], taken[0], rates[0], dim, cfg), float(sums["loss"][0])
            loss, done = loss + lost, done + len(ahead)
        run.w, run.b = params[:dim].tolist(), float(params[dim])
        run.epoch, run.rate = run.epoch + 1, cfg.lr * factors[done - 1] if steps else 0.0
        run.observe(loss / batches if batches else None, head_row(block_pass(val, head, params, x_col, y_col, split_col), head, 0))
    return run.res


@dataclass
class NetworkResult:
    log: list = field(default_factory=list)
    params: list = field(default_factory=list)  # after each epoch
    stop_epoch: int | None = None
    best_epoch: int | None = None


def start_weights(dim: int, hidden: int, seed: int = 42) -> np.ndarray:
    """Start of a hidden layer, the same everywhere: uniforms of md5(seed|k) scaled to the layer's fan, biases 0."""
    import hashlib

    draw = lambda k: int(hashlib.md5(f"{seed}|{k}".encode()).hexdigest()[:8], 16) / 2**32 * 2.0 - 1.0
    first = [round(draw(k) * math.sqrt(6.0 / (dim + hidden)), 9) for k in range(dim * hidden)]
    second = [round(draw(dim * hidden + k) * math.sqrt(6.0 / (hidden + 1)), 9) for k in range(hidden)]
    return np.array([*first, *[0.0] * hidden, *second, 0.0])


def train_network(
    features: DataFrame, dim: int, hidden: int, cfg: TrainConfig, start: np.ndarray | None = None, x_col: str = "x", y_col: str = "y", split_col: str = "split"
) -> NetworkResult:
    """T2 with a hidden layer: rectified units and one sigmoid, full-batch gradient steps, one scan per epoch.

    The backward pass runs as matrices inside the tasks; a pass returns one gradient. L2 falls on both
    weight arrays, clipping on every array of its own (F16, per array), the rate follows W6, and the loss stops the
    run as in T1.
    """
    net = HiddenLayer(dim, hidden)
    params = start_weights(dim, hidden) if start is None else np.asarray(start, np.float64)
    d = dim * hidden
    arrays = [slice(0, d), slice(d, d + hidden), slice(d + hidden, d + 2 * hidden), slice(d + 2 * hidden, None)]
    decay = np.zeros(net.width)
    decay[arrays[0]] = decay[arrays[2]] = cfg.l2
    run, res = Run(1, cfg), NetworkResult()
    sums = block_pass(features, net, params, x_col, y_col, split_col)
    while not run.done:
        train = sums.get("train")
        if train:
            rate = cfg.lr * run.factors[run.epoch]
            params = params - rate * clipped(train["gradient"] / train["n"] + decay * params, cfg.clip, arrays)
        run.epoch, run.rate = run.epoch + 1, cfg.lr * run.factors[run.epoch]
        sums = block_pass(features, net, params, x_col, y_col, split_col)
        row = head_row({k: v | {"gradient": np.zeros(2)} for k, v in sums.items()}, Heads(1, 1), 0)
        metrics = run.observe(float(train["loss"][0] / train["n"]) if train else None, row)
        metrics["l2_penalty"] = 0.5 * float((decay * params * params).sum())
        res.params.append(params)
    res.log, res.stop_epoch, res.best_epoch = run.res.log, run.res.stop_epoch, run.res.best_epoch
    return res


def network_score(df: DataFrame, dim: int, hidden: int, params, x_col: str = "x", threshold: float = 0.5) -> DataFrame:
    """T8 for a hidden layer: ``df`` with p and pred, in built-in functions."""
    w1, b1, w2, b2 = HiddenLayer(dim, hidden).parts(np.asarray(params, np.float64))
    numbers = lambda v: F.array(*[F.lit(float(x)) for x in v])
    dot = lambda k: F.aggregate(F.zip_with(x_col, numbers(w1[:, k]), lambda a, b: a * b), F.lit(float(b1[k])), lambda a, v: a + v)
    staged = df.withColumn("_units", F.array(*[F.greatest(dot(k), F.lit(0.0)) for k in range(hidden)]))
    z = F.aggregate(F.zip_with("_units", numbers(w2), lambda a, b: a * b), F.lit(float(b2[0])), lambda a, v: a + v)
    return staged.withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).withColumn("pred", (F.col("p") > threshold).cast("int")).drop("_units")


def chosen_weights(res: TrainResult, which: str = "best") -> tuple[list, float]:
    """Weights after the best epoch (the last one if none improved), or after the last that ran (Q2)."""
    if which not in ("best", "last"):
        raise ValueError(f"which: {which}")
    return res.weights[res.best_epoch - 1 if which == "best" and res.best_epoch else -1]


def log_frame(spark: SparkSession, res: TrainResult) -> DataFrame:
    """The epoch log of a T1 run as a DataFrame (driver-sized: one row per epoch)."""
    schema = "run_id string, epoch int, train_loss double, val_loss double, val_f1 double, val_accuracy double, lr double, l2_penalty double"
    return spark.createDataFrame([tuple(r[k] for k in ("run_id", "epoch", "train_loss", "val_loss", "val_f1", "val_accuracy", "lr", "l2_penalty")) for r in res.log], schema)


def batch_score(df: DataFrame, w: list[float], b: float, x_col: str = "x", threshold: float = 0.5) -> DataFrame:
    """Probability and class for every row (a projection; no training, no shuffle)."""
    p = score_expr(F.col(x_col), w, b)
    return df.withColumn("p", p).withColumn("pred", (F.col("p") > F.lit(threshold)).cast("int"))


def score_foreign_model(df: DataFrame, load_model: Callable[[], object], predict: Callable[[object, "pd.DataFrame"], "pd.DataFrame"], schema: str) -> DataFrame:
    """T8 for a model Spark cannot run itself (e.g. an ONNX or pickled model):
    ``load_model()`` runs once per task, ``predict(model, batch)`` once per
    Arrow batch and returns the output columns of ``schema``."""

    def run(batches):
        model = load_model()
        for pdf in batches:
            yield predict(model, pdf)

    from ledeframe.session import ship_code

    ship_code()
    return df.mapInPandas(run, schema)


def score_model_file(df: DataFrame, path: str, load_model: Callable[[str], object], predict: Callable[[object, "np.ndarray"], "np.ndarray"], x_col: str = "x", out: str = "p", batch_size: int = 4096) -> DataFrame:
    """T8 for a model file (ONNX, pickled, weights): ``df`` with ``out``, ``predict(model, x)`` of each batch of feature rows.

    The file (any path Spark reads) is shipped to every executor once; a Python worker loads it with ``load_model(local path)``
    at its first batch and keeps it for all tasks it runs."""
    import os

    from pyspark import SparkFiles
    from pyspark.ml.functions import predict_batch_udf

    from ledeframe.session import ship_code

    ship_code()
    df.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def make_predict():
        model = load_model(SparkFiles.get(name))
        return lambda x: predict(model, x)

    from pyspark.sql import types as ST

    dim_known = df.select(F.size(x_col).alias("d")).limit(1).collect()
    dim = dim_known[0]["d"] if dim_known else 1
    score = predict_batch_udf(make_predict, return_type=ST.DoubleType(), batch_size=batch_size, input_tensor_shapes=[[dim]])
    return df.withColumn(out, score(x_col))


def classifier_estimator(dim: int, x_col: str = "x", y_col: str = "y", kind: str = "logistic", hidden: int = 16, max_iter: int = 50, reg: float = 0.0, seed: int = 42):
    """T2 (unfitted): array column -> vector -> LogisticRegression or a one-hidden-layer MLP.

    Stock stages only, so a fitted pipeline saves and reloads anywhere."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.feature import SQLTransformer, VectorAssembler

    cols = [f"_x{j}" for j in range(dim)]
    unpack = SQLTransformer(
        statement="SELECT *, " + ", ".join(f"{x_col}[{j}] AS {c}" for j, c in enumerate(cols)) + f", CAST({y_col} AS DOUBLE) AS label_d FROM __THIS__"
    )
    assemble = VectorAssembler(inputCols=cols, outputCol="features")
    if kind == "mlp":
        clf = MultilayerPerceptronClassifier(layers=[dim, hidden, 2], maxIter=max_iter, seed=seed, labelCol="label_d")
    else:
        clf = LogisticRegression(maxIter=max_iter, regParam=reg, labelCol="label_d", standardization=False)
    return Pipeline(stages=[unpack, assemble, clf])


def fit_classifier(train: DataFrame, dim: int, x_col: str = "x", y_col: str = "y", kind: str = "logistic", hidden: int = 16, max_iter: int = 50, reg: float = 0.0, seed: int = 42):
    """Fit the classifier pipeline; returns the ``PipelineModel``."""
    return classifier_estimator(dim, x_col, y_col, kind, hidden, max_iter, reg, seed).fit(train)


def sweep_classifier(train: DataFrame, dim: int, reg_params=(0.0, 0.01, 0.1), x_col: str = "x", y_col: str = "y", train_ratio: float = 0.8, parallelism: int = 2, seed: int = 42):
    """T10 (model side): a grid over the regularisation strength, chosen on a
    held-out share with Spark ML ``TrainValidationSplit``; returns the fitted
    selection model (``validationMetrics`` in grid order)."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit

    pipe = classifier_estimator(dim, x_col, y_col)
    clf = pipe.getStages()[-1]
    grid = ParamGridBuilder().addGrid(clf.regParam, list(reg_params)).build()
    ev = BinaryClassificationEvaluator(labelCol="label_d")
    tvs = TrainValidationSplit(estimator=pipe, estimatorParamMaps=grid, evaluator=ev, trainRatio=train_ratio, parallelism=parallelism, seed=seed)
    return tvs.fit(train)


def fit_word_vectors(df: DataFrame, tokens_col: str, dim: int = 16, min_count: int = 5, max_iter: int = 1, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """Word vectors learned from the corpus (Spark ML Word2Vec) as (word, vec array<float>).

    Trained over as many partitions as the input has.  The library keeps the model,
    vocabulary x dim numbers, on the driver: a limit of T7."""
    from pyspark.ml.feature import Word2Vec

    partitions = partitions or df.rdd.getNumPartitions()

    w2v = Word2Vec(vectorSize=dim, minCount=min_count, maxIter=max_iter, seed=seed, inputCol=tokens_col, numPartitions=partitions)
    model = w2v.fit(df.select(tokens_col))
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select("word", vector_to_array("vector", "float32").alias("vec"))
