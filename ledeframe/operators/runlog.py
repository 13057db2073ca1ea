"""Run-log analytics as ordered per-run computations.

A run log is ``(run_id, epoch, metric...)``.  Epoch numbers may have gaps and metrics may
be missing: a null value is no evaluation (it neither improves nor counts), a NaN is
an evaluation that does not improve.  Patience counts evaluations, not epoch numbers.

Running values use ``PrefixScans`` (one range shuffle and one checkpoint for all scans
of an operator), so a run with very many rows is not one task; per-run decisions are
partial aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledeframe.operators.order import PrefixScans, running_aggregate
from ledeframe.session import cut_lineage


def _valid(value: Column) -> Column:
    """The value if it can improve on another: not null, not NaN."""
    return F.when(value.isNotNull() & ~F.isnan(value.cast("double")), value)


def _signed(value_col: str, mode: str) -> Column:
    """The value as something to minimise."""
    v = _valid(F.col(value_col))
    return v if mode == "min" else -v


def epoch_axis(df: DataFrame, run_col: str, order: list, name: str = "epoch") -> DataFrame:
    """Number each run's rows 1, 2, ... following ``order`` (unique within a run)."""
    one = df.withColumn("_one", F.lit(1))
    out = running_aggregate(one, run_col, order, [(name, "_one", "sum", True)])
    return out.withColumn(name, F.col(name).cast("int")).drop("_one")


def running_best(df: DataFrame, run_col: str = "run_id", epoch_col: str = "epoch", value_col: str = "val_loss", mode: str = "min") -> DataFrame:
    """Best value before each epoch and whether the epoch strictly improves on it.
    Missing values and NaN are never best and never improve."""
    fn = "min" if mode == "min" else "max"
    keyed = df.withColumn("_v", _valid(F.col(value_col)))
    out = running_aggregate(keyed, run_col, [F.col(epoch_col)], [("best_before", "_v", fn, False)])
    return _with_improved(out, mode).drop("_v")


def _with_improved(rows: DataFrame, mode: str) -> DataFrame:
    v, b = F.col("_v"), F.col("best_before")
    better = (v < b) if mode == "min" else (v > b)
    improved = v.isNotNull() & (b.isNull() | F.coalesce(better, F.lit(False)))
    best = F.least(b, v) if mode == "min" else F.greatest(b, v)
    return rows.withColumn("improved", improved).withColumn("best_so_far", best)


def _improvements(records: DataFrame, run_col: str, min_delta: float) -> DataFrame:
    """Greedy picks per run: (run, _ie), without gathering a run.  ``records``: (run, e, v) with v
    strictly decreasing in e; a record is picked when v < (last pick) - min_delta.

    next(i) = the first later record with v < v_i - min_delta.  Because record
    values fall strictly with the epoch, it is the smallest epoch among records
    whose value is below the threshold: one prefix scan over the merged
    (threshold, record) events sorted by value.  The picks are the path from
    each run's first record along ``next``; pointer doubling expands it in
    O(log n) rounds of joins on unique (run, epoch) keys.
    """
    recs = records.select(F.col(run_col).alias("_r"), F.col("e").cast("int").alias("e"), F.col("v").cast("double").alias("v"))
    events = recs.select("_r", F.col("v").alias("_val"), F.lit(1).alias("_kind"), "e").unionByName(
        recs.select("_r", (F.col("v") - F.lit(float(min_delta))).alias("_val"), F.lit(0).alias("_kind"), "e")
    ).withColumn("_rec_e", F.when(F.col("_kind") == 1, F.col("e")))
    # Ascending value; at equal value the threshold comes first (strictly below is required).
    scanned = running_aggregate(events, "_r", [F.col("_val"), F.col("_kind"), F.col("e")], [("_nx", "_rec_e", "min", False)])
    jump = cut_lineage(scanned.filter(F.col("_kind") == 0).select("_r", "e", F.col("_nx").alias("_j")))
    path = cut_lineage(recs.groupBy("_r").agg(F.min("e").alias("e")))  # the first epoch always improves
    while True:
        here = path.alias("p").join(jump.alias("j"), F.col("p._r").eqNullSafe(F.col("j._r")) & (F.col("p.e") == F.col("j.e")))
        step = here.filter(F.col("j._j").isNotNull()).select("p._r", F.col("j._j").alias("e"))
        path = cut_lineage(path.unionByName(step).distinct())
        longer = jump.alias("a").join(jump.alias("b"), F.col("a._r").eqNullSafe(F.col("b._r")) & (F.col("a._j") == F.col("b.e")), "left")
        jump = cut_lineage(longer.select(F.col("a._r").alias("_r"), F.col("a.e").alias("e"), F.col("b._j").alias("_j")))
        if jump.filter(F.col("_j").isNotNull()).limit(1).count() == 0:
            break
    return path.select(F.col("_r").alias("_ir"), F.col("e").alias("_ie"))


def _flagged(
    df: DataFrame, run_col: str, epoch_col: str, value_col: str, mode: str, min_delta: float
) -> tuple[PrefixScans, DataFrame]:
    """The scans of a log, and its rows with ``improved`` and ``_n``, the evaluations up to the row.

    Improvement means ``v < best - min_delta`` (mode min) or ``v > best + min_delta``
    (mode max); ``best`` moves only on an improvement.  With ``min_delta = 0`` this is a
    strict running best.  Otherwise ``best`` stays within ``min_delta`` of the running
    extreme, so only rows that set a new extreme can improve; which of them do is
    resolved by pointer doubling over those records.
    """
    keyed = df.withColumn("_v", _valid(F.col(value_col))).withColumn("_one", F.col(value_col).isNotNull().cast("int"))
    scans = PrefixScans(keyed, run_col, [F.col(epoch_col)])
    fn = "min" if mode == "min" else "max"
    rows = scans.scan(scans.table, [("best_before", "_v", fn, False), ("_n", "_one", "sum", True)])
    rows = _with_improved(rows, mode).drop("_one")
    if min_delta:
        sign = 1.0 if mode == "min" else -1.0
        records = rows.filter("improved").select(run_col, F.col(epoch_col).alias("e"), (F.col("_v") * F.lit(sign)).alias("v"))
        hits = _improvements(cut_lineage(records), run_col, min_delta).withColumn("_hit", F.lit(True))
        rows = rows.join(hits, F.col(run_col).eqNullSafe(F.col("_ir")) & (F.col(epoch_col) == F.col("_ie")), "left")
        rows = rows.withColumn("improved", F.coalesce("_hit", F.lit(False))).drop("_hit", "_ir", "_ie")
    return scans, rows.drop("_v", "best_before", "best_so_far")


def improvement_flags(
    df: DataFrame, run_col: str = "run_id", epoch_col: str = "epoch", value_col: str = "val_loss", mode: str = "min", min_delta: float = 0.0
) -> DataFrame:
    """Mark epochs that improve on the monitored best by more than ``min_delta`` (callback semantics)."""
    return _flagged(df, run_col, epoch_col, value_col, mode, min_delta)[1].drop("_pid", "_n")


def early_stop_trace(
    df: DataFrame, patience: int, run_col: str = "run_id", epoch_col: str = "epoch", value_col: str = "val_loss", mode: str = "min", min_delta: float = 0.0
) -> DataFrame:
    """W2 per epoch: evaluations since the last improvement (since the start if there was none) and the stop flag."""
    scans, rows = _flagged(df, run_col, epoch_col, value_col, mode, min_delta)
    rows = scans.scan(rows.withColumn("_at", F.when(F.col("improved"), F.col("_n"))), [("_last", "_at", "max", True)])
    since = (F.coalesce(F.col("_n"), F.lit(0)) - F.coalesce(F.col("_last"), F.lit(0))).cast("int")
    return rows.withColumn("since_improved", since).withColumn("stop_here", F.col("since_improved") >= F.lit(patience)).drop("_pid", "_n", "_at", "_last")


def _stops(trace: DataFrame, run_col: str, epoch_col: str) -> DataFrame:
    """Per run: n_epochs, stop_epoch (null if never) and last_epoch, the last one that ran."""
    per_run = trace.groupBy(run_col).agg(
        F.count(F.lit(1)).alias("n_epochs"),
        F.min(F.when(F.col("stop_here"), F.col(epoch_col))).alias("stop_epoch"),
        F.max(epoch_col).alias("_max"),
    )
    return per_run.withColumn("last_epoch", F.coalesce("stop_epoch", "_max")).drop("_max")


def _run_part(
    df: DataFrame, patience: int, run_col: str, epoch_col: str, value_col: str, mode: str, min_delta: float = 0.0
) -> tuple[DataFrame, DataFrame]:
    """(rows up to each run's stop, with n_epochs, stop_epoch and last_epoch; per-run stops)."""
    trace = early_stop_trace(df, patience, run_col, epoch_col, value_col, mode, min_delta)
    stops = _stops(trace, run_col, epoch_col)
    other = stops.withColumnRenamed(run_col, "_run")
    rows = trace.join(other, trace[run_col].eqNullSafe(other["_run"])).drop("_run")
    return rows.filter(F.col(epoch_col) <= F.col("last_epoch")), stops


def early_stop(
    df: DataFrame, patience: int, run_col: str = "run_id", epoch_col: str = "epoch", value_col: str = "val_loss", mode: str = "min", min_delta: float = 0.0
) -> DataFrame:
    """Per run the first epoch with ``patience`` evaluations since the last improvement (null if
    never), the last epoch that ran, and how many epochs ran.  Improvement is strict; with
    ``min_delta`` it must beat the best by more than that (callback semantics)."""
    return _at_stop(df, patience, run_col, epoch_col, value_col, mode, min_delta).select(run_col, "n_epochs", "stop_epoch", "epochs_run", "last_epoch")


def _at_stop(df: DataFrame, patience: int, run_col: str, epoch_col: str, value_col: str, mode: str, min_delta: float = 0.0) -> DataFrame:
    """One row per run, read off the row at which it stops (its last one if never): what has run by then and the epoch
    and value of the last improvement. One aggregation over the scans; nothing but run, epoch and value is scanned."""
    slim = df.select(run_col, epoch_col, value_col)
    scans, rows = _flagged(slim, run_col, epoch_col, value_col, mode, min_delta)
    hit = F.when(F.col("improved"), F.struct(F.col(epoch_col).alias("e"), F.col("_n").alias("n"), F.col(value_col).alias("v")))
    rows = scans.scan(rows.withColumn("_hit", hit).withColumn("_one", F.lit(1)), [("_last", "_hit", "max", True), ("_rows", "_one", "sum", True)])
    stops = (F.coalesce(F.col("_n"), F.lit(0)) - F.coalesce(F.col("_last.n"), F.lit(0))) >= F.lit(patience)
    here = F.struct(F.col(epoch_col).alias("epoch"), F.col("_rows").alias("rows"), F.col("_last").alias("best"))
    per_run = rows.groupBy(run_col).agg(
        F.count(F.lit(1)).cast("long").alias("n_epochs"),
        F.min_by(here, F.when(stops, F.col(epoch_col))).alias("_stop"),
        F.max_by(here, F.col(epoch_col)).alias("_end"),
    )
    last = F.coalesce("_stop", "_end")
    return per_run.select(
        run_col,
        "n_epochs",
        F.col("_stop.epoch").cast("int").alias("stop_epoch"),
        last["rows"].cast("long").alias("epochs_run"),
        last["epoch"].cast("int").alias("last_epoch"),
        last["best"]["e"].cast("int").alias("best_epoch"),
        last["best"]["v"].alias("best_value"),
    )


def _best(epoch_col: str, out: str, signed: Column) -> Column:
    """``out`` of the row with the least ``signed``, the earliest on ties; null without any."""
    return F.min_by(F.col(out), F.when(signed.isNotNull(), F.struct(signed.alias("v"), F.col(epoch_col).alias("e"))))


def best_epoch(df: DataFrame, patience: int, run_col: str = "run_id", epoch_col: str = "epoch", value_col: str = "val_loss", mode: str = "min") -> DataFrame:
    """The epoch whose state is kept: best value (earliest on ties) among epochs run."""
    return _at_stop(df, patience, run_col, epoch_col, value_col, mode).select(run_col, "epochs_run", "stop_epoch", "best_epoch", "best_value")


def dual_criterion(df: DataFrame, patience: int, run_col: str = "run_id", epoch_col: str = "epoch", loss_col: str = "val_loss", score_col: str = "f1") -> DataFrame:
    """Stop on loss, keep the checkpoint of the best score (strictly greater) up to the stop."""
    rows, _ = _run_part(df, patience, run_col, epoch_col, loss_col, "min")
    return rows.groupBy(run_col).agg(
        F.count(F.lit(1)).alias("epochs_run"),
        F.first("stop_epoch").cast("int").alias("stop_epoch"),
        _best(epoch_col, epoch_col, _signed(score_col, "max")).cast("int").alias("score_epoch"),
        F.max(_valid(F.col(score_col))).alias("best_score"),
        _best(epoch_col, epoch_col, _signed(loss_col, "min")).cast("int").alias("loss_epoch"),
    )


def compare_runs(df: DataFrame, patience: int, run_col: str = "run_id", epoch_col: str = "epoch", loss_col: str = "val_loss", score_col: str = "f1") -> DataFrame:
    """One row per run, its best epoch and loss, its best score up to the stop, and its place by loss."""
    from ledeframe.operators.order import with_row_index

    rows, _ = _run_part(df, patience, run_col, epoch_col, loss_col, "min")
    best = rows.groupBy(run_col).agg(
        F.count(F.lit(1)).alias("epochs_run"),
        _best(epoch_col, epoch_col, _signed(loss_col, "min")).cast("int").alias("best_epoch"),
        F.min(_valid(F.col(loss_col))).alias("best_loss"),
        F.max(_valid(F.col(score_col))).alias("best_f1"),
    )
    ranked = with_row_index(best, [F.col("best_loss").asc_nulls_last(), F.col(run_col)], "_at")
    return ranked.withColumn("place", F.col("_at") + 1).drop("_at")


def plateau_lr(
    df: DataFrame,
    patience: int,
    base_lr: float,
    factor: float = 0.5,
    min_delta: float = 1e-4,
    min_lr: float = 0.0,
    run_col: str = "run_id",
    epoch_col: str = "epoch",
    value_col: str = "val_loss",
) -> DataFrame:
    """Learning rate after each epoch under reduce-on-plateau.

    Semantics: improvement means ``v < best - min_delta`` (then best = v,
    wait = 0); otherwise ``wait`` grows with each evaluation, and when it reaches
    ``patience`` while the rate is above ``min_lr`` the rate becomes
    ``max(lr * factor, min_lr)`` and ``wait`` restarts.

    All scans run over one partitioned log: evaluations and improvements, then the
    evaluations since the last improvement, whose multiples of ``patience`` are the
    cut opportunities, then their running count ``c``; ``lr = max(base * factor^c, min_lr)``.
    """
    scans, rows = _flagged(df, run_col, epoch_col, value_col, "min", min_delta)
    rows = rows.withColumn("_at", F.when(F.col("improved"), F.col("_n"))).withColumn("_ok", F.col(value_col).isNotNull())
    rows = scans.scan(rows.select(run_col, epoch_col, "_pid", "_n", "_at", "_ok"), [("_last", "_at", "max", True)])
    wait = F.col("_n") - F.coalesce(F.col("_last"), F.lit(0))
    opp = F.col("_ok") & (wait > 0) & ((wait % F.lit(patience)) == 0)
    cnt = scans.scan(rows.withColumn("_opp", F.coalesce(opp, F.lit(False)).cast("int")), [("_c", "_opp", "sum", True)])
    base, fl = F.lit(float(base_lr)), F.lit(float(min_lr))
    c = F.col("_c").cast("double")
    if base_lr > min_lr:
        lr = F.greatest(base * F.pow(F.lit(float(factor)), c), fl)
        before = F.greatest(base * F.pow(F.lit(float(factor)), c - 1), fl)
        cut = (F.col("_opp") == 1) & (before > fl)
    else:
        lr, cut = base, F.lit(False)
    return cnt.select(run_col, F.col(epoch_col).cast("int").alias("epoch"), lr.alias("lr"), cut.alias("cut"))


def warmup_schedule(steps_df: DataFrame, base_lr: float, warmup_share: float = 0.1, total_col: str = "total_steps") -> DataFrame:
    """One row per step 0..T with the linear warm-up/decay rate.

    ``steps_df`` has one row per schedule (e.g. per run) with its total steps.
    """
    t = F.col(total_col)
    w = (F.lit(float(warmup_share)) * t.cast("double")).cast("long")
    # In blocks: no row ever holds more than a block of steps or the list of blocks.
    block = F.lit(4096).cast("long")
    first = F.explode(F.sequence(F.lit(0).cast("long"), t.cast("long"), block))
    s = steps_df.withColumn("warmup_steps", w).withColumn("_block", first).repartition("_block")
    s = s.withColumn("step", F.explode(F.sequence("_block", F.least(F.col("_block") + block - 1, t.cast("long"))))).drop("_block")
    st, ww = F.col("step").cast("double"), F.col("warmup_steps")
    factor = F.when(
        F.col("step") < ww, st / F.greatest(F.lit(1.0), ww.cast("double"))
    ).otherwise(F.greatest(F.lit(0.0), (t.cast("double") - st) / F.greatest(F.lit(1.0), (t - ww).cast("double"))))
    return s.withColumn("lr", F.lit(float(base_lr)) * factor)


def checkpoint_retention(df: DataFrame, keep: int, patience: int | None = None, run_col: str = "run_id", epoch_col: str = "epoch", value_col: str = "val_loss") -> DataFrame:
    """Checkpoints kept: the newest ``keep`` epochs of each run (by rank) plus its best epoch; with
    ``patience`` of the epochs up to its early stop."""
    if patience is not None:
        df = _run_part(df, patience, run_col, epoch_col, value_col, "min")[0].select(*df.columns)
    ranked = running_aggregate(df.withColumn("_one", F.lit(1)), run_col, [F.col(epoch_col)], [("_pos", "_one", "sum", True)])
    last = ranked.groupBy(F.col(run_col).alias("_run")).agg(
        F.max("_pos").alias("_last"), _best(epoch_col, epoch_col, _signed(value_col, "min")).alias("_best")
    )
    j = ranked.join(last, F.col(run_col).eqNullSafe(F.col("_run")))
    best = F.coalesce(F.col(epoch_col) == F.col("_best"), F.lit(False))
    kept = j.filter((F.col("_pos") > F.col("_last") - F.lit(keep)) | best)
    return kept.withColumn("is_best", best).drop("_run", "_last", "_best", "_pos", "_one")


def log_has_key(df: DataFrame, key: str, without: str | None = None, log_col: str = "log") -> DataFrame:
    """Records carrying ``key`` (and, optionally, not carrying ``without``)."""
    cond = F.map_contains_key(F.col(log_col), F.lit(key))
    if without:
        cond = cond & ~F.map_contains_key(F.col(log_col), F.lit(without))
    return df.filter(cond)


def log_series(df: DataFrame, key: str, without: str | None = None, run_col: str = "run_id", seq_col: str = "seq", log_col: str = "log") -> DataFrame:
    """P9 + W8: the values of one key, numbered 1.. per run in record order."""
    kept = log_has_key(df, key, without, log_col).withColumn("value", F.col(log_col)[key])
    return epoch_axis(kept.select(run_col, seq_col, "value"), run_col, [F.col(seq_col)], "point")


def trim_series(train: DataFrame, evals: DataFrame, run_col: str = "run_id", point_col: str = "point") -> DataFrame:
    """Cut each run's train series to the number of eval points of that run."""
    n_eval = evals.groupBy(F.col(run_col).alias("_run")).agg(F.count(F.lit(1)).alias("_n_eval"))
    return train.join(n_eval, F.col(run_col).eqNullSafe(F.col("_run"))).filter(F.col(point_col) <= F.col("_n_eval")).drop("_run", "_n_eval")


def curve_data(df: DataFrame, id_cols=("run_id", "epoch"), series=("val_loss", "f1")) -> DataFrame:
    """K4: tidy ``(id..., series, value)`` rows behind every plot."""
    return df.select(*id_cols, *[F.col(s).cast("double").alias(s) for s in series]).unpivot(
        list(id_cols), list(series), "series", "value"
    )


def epoch_loss(df: DataFrame, batch_col: str, value_col: str, group_cols=()) -> DataFrame:
    """A4: mean of batch means (a short last batch weighs as much as a full one),
    with the plain row mean beside it."""
    per_batch = df.groupBy(*group_cols, batch_col).agg(
        F.avg(value_col).alias("_bm"), F.sum(value_col).alias("_bs"), F.count(F.lit(1)).alias("_bn")
    )
    return per_batch.groupBy(*group_cols).agg(
        F.avg("_bm").alias("epoch_loss"),
        (F.sum("_bs") / F.sum("_bn")).alias("row_mean_loss"),
        F.count(F.lit(1)).alias("n_batches"),
    )
