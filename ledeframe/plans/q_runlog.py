"""Registered queries: run-log analytics, schedules, metric sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledeframe.functions.mathfn import total_steps, total_steps_accumulated, warmup_steps
from ledeframe.operators import runlog as R
from ledeframe.plans import fixtures as X
from ledeframe.plans.catalog import EPOCH_LOG_SQL, HEADLINES_SQL, i64, r6, register
from ledeframe.session import scratch_path
from ledeframe.sources import sinks as K

LOG = f"_log AS ({EPOCH_LOG_SQL})"


def sql_stop(value: str, patience: int, mode: str = "min") -> str:
    """CTEs over ``_log``: ``_li`` (per epoch) and ``_stop(run_id, n_epochs, stop_epoch, epochs_run, last_epoch)``.
    Null values are no evaluations."""
    agg, cmp = ("min", "<") if mode == "min" else ("max", ">")
    return f"""
_rb AS (SELECT *, {agg}({value}) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bb,
               count({value}) OVER (PARTITION BY run_id ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS n FROM _log),
_im AS (SELECT *, ({value} IS NOT NULL AND (bb IS NULL OR {value} {cmp} bb)) AS improved FROM _rb),
_li AS (SELECT *, coalesce(max(CASE WHEN improved THEN n END) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS li FROM _im),
_st AS (SELECT run_id, count(*) AS n_epochs, min(CASE WHEN n - li >= {patience} THEN epoch END) AS stop_epoch,
               coalesce(min(CASE WHEN n - li >= {patience} THEN epoch END), max(epoch)) AS last_epoch FROM _li GROUP BY run_id),
_stop AS (SELECT _st.run_id, any_value(n_epochs) AS n_epochs, any_value(stop_epoch) AS stop_epoch, any_value(last_epoch) AS last_epoch, count(*) AS epochs_run
          FROM _st JOIN _log ON _st.run_id = _log.run_id WHERE _log.epoch <= _st.last_epoch GROUP BY _st.run_id)
"""


def _stop_cols(df):
    return df.select("run_id", i64("n_epochs").alias("n_epochs"), i64("stop_epoch").alias("stop_epoch"), i64("epochs_run").alias("epochs_run"))


STOP_SELECT = "SELECT run_id, CAST(n_epochs AS BIGINT) AS n_epochs, CAST(stop_epoch AS BIGINT) AS stop_epoch, CAST(epochs_run AS BIGINT) AS epochs_run FROM _stop"


@register("epoch_axis", f"WITH {LOG} SELECT run_id, event_id, CAST(epoch AS BIGINT) AS epoch FROM _log")
def q_epoch_axis(spark, sf_dir):
    return X.epoch_log(spark, sf_dir).select("run_id", "event_id", i64("epoch").alias("epoch"))


@register(
    "running_best",
    f"WITH {LOG}, {sql_stop('val_loss', 3)} SELECT run_id, CAST(epoch AS BIGINT) AS epoch, round(bb, 6) AS best_before, improved FROM _im",
)
def q_running_best(spark, sf_dir):
    rb = R.running_best(X.epoch_log(spark, sf_dir))
    return rb.select("run_id", i64("epoch").alias("epoch"), r6("best_before").alias("best_before"), "improved")


@register("early_stop", f"WITH {LOG}, {sql_stop('val_loss', 3)} {STOP_SELECT}")
def q_early_stop(spark, sf_dir):
    return _stop_cols(R.early_stop(X.epoch_log(spark, sf_dir), patience=3))


@register("early_stop_monitor", f"WITH {LOG}, {sql_stop('f1', 5, 'max')} {STOP_SELECT}")
def q_early_stop_monitor(spark, sf_dir):
    return _stop_cols(R.early_stop(X.epoch_log(spark, sf_dir), patience=5, value_col="f1", mode="max"))


@register(
    "best_epoch",
    f"""WITH {LOG}, {sql_stop('val_loss', 3)},
    _c AS (SELECT l.run_id, l.epoch, l.val_loss, s.epochs_run, s.stop_epoch,
                  row_number() OVER (PARTITION BY l.run_id ORDER BY l.val_loss, l.epoch) AS rk
           FROM _log l JOIN _stop s ON l.run_id = s.run_id WHERE l.epoch <= s.last_epoch)
    SELECT run_id, CAST(epochs_run AS BIGINT) AS epochs_run, CAST(stop_epoch AS BIGINT) AS stop_epoch,
           CAST(epoch AS BIGINT) AS best_epoch, round(val_loss, 6) AS best_value FROM _c WHERE rk = 1""",
)
def q_best_epoch(spark, sf_dir):
    b = R.best_epoch(X.epoch_log(spark, sf_dir), patience=3)
    return b.select("run_id", i64("epochs_run").alias("epochs_run"), i64("stop_epoch").alias("stop_epoch"), i64("best_epoch").alias("best_epoch"), r6("best_value").alias("best_value"))


@register(
    "dual_criterion",
    f"""WITH {LOG}, {sql_stop('val_loss', 6)},
    _c AS (SELECT l.*, s.epochs_run, s.stop_epoch,
                  row_number() OVER (PARTITION BY l.run_id ORDER BY l.f1 DESC, l.epoch) AS rs,
                  row_number() OVER (PARTITION BY l.run_id ORDER BY l.val_loss, l.epoch) AS rl
           FROM _log l JOIN _stop s ON l.run_id = s.run_id WHERE l.epoch <= s.last_epoch)
    SELECT run_id, CAST(max(epochs_run) AS BIGINT) AS epochs_run, CAST(max(stop_epoch) AS BIGINT) AS stop_epoch,
           CAST(max(CASE WHEN rs = 1 THEN epoch END) AS BIGINT) AS score_epoch, round(max(f1), 6) AS best_score,
           CAST(max(CASE WHEN rl = 1 THEN epoch END) AS BIGINT) AS loss_epoch
    FROM _c GROUP BY run_id""",
)
def q_dual_criterion(spark, sf_dir):
    d = R.dual_criterion(X.epoch_log(spark, sf_dir), patience=6)
    return d.select(
        "run_id", i64("epochs_run").alias("epochs_run"), i64("stop_epoch").alias("stop_epoch"),
        i64("score_epoch").alias("score_epoch"), r6("best_score").alias("best_score"), i64("loss_epoch").alias("loss_epoch"),
    )


@register(
    "plateau_lr",
    f"""WITH RECURSIVE {LOG},
    _r(run_id, epoch, best, wait, lr, cut) AS (
      SELECT run_id, epoch, val_loss, 0, 1.0::DOUBLE, false FROM _log WHERE epoch = 1
      UNION ALL
      SELECT l.run_id, l.epoch,
             CASE WHEN l.val_loss < r.best - 1e-4 THEN l.val_loss ELSE r.best END,
             CASE WHEN l.val_loss < r.best - 1e-4 THEN 0 WHEN r.wait + 1 >= 2 THEN 0 ELSE r.wait + 1 END,
             CASE WHEN NOT (l.val_loss < r.best - 1e-4) AND r.wait + 1 >= 2 THEN r.lr * 0.5 ELSE r.lr END,
             NOT (l.val_loss < r.best - 1e-4) AND r.wait + 1 >= 2
      FROM _r r JOIN _log l ON l.run_id = r.run_id AND l.epoch = r.epoch + 1)
    SELECT run_id, CAST(epoch AS BIGINT) AS epoch, round(lr, 9) AS lr_factor, cut FROM _r""",
)
def q_plateau_lr(spark, sf_dir):
    base = 1e-4
    p = R.plateau_lr(X.epoch_log(spark, sf_dir), patience=2, base_lr=base, factor=0.5, min_delta=1e-4)
    return p.select("run_id", i64("epoch").alias("epoch"), F.round(F.col("lr") / F.lit(base), 9).alias("lr_factor"), "cut")


@register(
    "linear_warmup_lr",
    f"""WITH _n AS (SELECT count(*) AS n FROM ({HEADLINES_SQL})),
    _t AS (SELECT CAST(ceil(n::DOUBLE / 16.0) AS BIGINT) * 15 AS t FROM _n),
    _w AS (SELECT t, CAST(trunc(0.1 * t::DOUBLE) AS BIGINT) AS w FROM _t),
    _s AS (SELECT t, w, range AS step FROM _w, range(0, (SELECT t FROM _t) + 1))
    SELECT CAST(step AS BIGINT) AS step,
           round(CASE WHEN step < w THEN step::DOUBLE / greatest(1.0, w::DOUBLE)
                      ELSE greatest(0.0, (t - step)::DOUBLE / greatest(1.0, (t - w)::DOUBLE)) END, 6) AS lr_factor
    FROM _s""",
)
def q_linear_warmup_lr(spark, sf_dir):
    n = X.headlines(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    steps = n.select(total_steps("n", 16, 15).alias("total_steps"))
    sched = R.warmup_schedule(steps, base_lr=1.0, warmup_share=0.1)
    return sched.select(i64("step").alias("step"), r6("lr").alias("lr_factor"))


@register(
    "warmup_steps",
    f"""WITH _n AS (SELECT count(*) AS n FROM ({HEADLINES_SQL})), _t AS (SELECT CAST(ceil(n::DOUBLE / 32.0) AS BIGINT) * 70 AS t FROM _n)
    SELECT t AS total_steps, CAST(trunc(0.1 * t::DOUBLE) AS BIGINT) AS warmup_steps FROM _t""",
)
def q_warmup_steps(spark, sf_dir):
    n = X.headlines(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    t = n.select(total_steps("n", 32, 70).alias("total_steps"))
    return t.select(i64("total_steps").alias("total_steps"), i64(warmup_steps("total_steps")).alias("warmup_steps"))


@register(
    "total_steps",
    f"""WITH _n AS (SELECT count(*) AS n FROM ({HEADLINES_SQL}))
    SELECT CAST(ceil(n::DOUBLE / 8.0) AS BIGINT) * 10 AS per_batch, CAST(floor(n::DOUBLE * 10.0 / 16.0) AS BIGINT) AS accumulated FROM _n""",
)
def q_total_steps(spark, sf_dir):
    n = X.headlines(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    return n.select(i64(total_steps("n", 8, 10)).alias("per_batch"), i64(total_steps_accumulated("n", 8, 10, 2)).alias("accumulated"))


@register(
    "checkpoint_retention",
    f"""WITH {LOG},
    _k AS (SELECT run_id, max(epoch) AS last, arg_min(epoch, struct_pack(v := val_loss, e := epoch)) AS best FROM _log GROUP BY run_id)
    SELECT l.run_id, CAST(l.epoch AS BIGINT) AS epoch, l.epoch = k.best AS is_best
    FROM _log l JOIN _k k ON l.run_id = k.run_id WHERE l.epoch > k.last - 2 OR l.epoch = k.best""",
)
def q_checkpoint_retention(spark, sf_dir):
    kept = R.checkpoint_retention(X.epoch_log(spark, sf_dir), keep=2)
    return kept.select("run_id", i64("epoch").alias("epoch"), "is_best")


_RUN_LOG_SQL = f"""{LOG},
_rl AS (SELECT run_id, epoch AS seq, CASE WHEN epoch % 2 = 0 THEN 'loss' ELSE 'eval_loss' END AS k, val_loss AS v FROM _log)"""


@register("log_has_key", f"WITH {_RUN_LOG_SQL} SELECT run_id, CAST(seq AS BIGINT) AS seq FROM _rl WHERE k = 'loss'")
def q_log_has_key(spark, sf_dir):
    kept = R.log_has_key(X.run_log(spark, sf_dir), "loss", without="eval_loss")
    return kept.select("run_id", i64("seq").alias("seq"))


@register(
    "trim_series",
    f"""WITH {_RUN_LOG_SQL},
    _tr AS (SELECT run_id, v, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS point FROM _rl WHERE k = 'loss'),
    _ne AS (SELECT run_id, count(*) AS n_eval FROM _rl WHERE k = 'eval_loss' GROUP BY run_id)
    SELECT t.run_id, CAST(t.point AS BIGINT) AS point, round(t.v, 6) AS value FROM _tr t JOIN _ne e ON t.run_id = e.run_id WHERE t.point <= e.n_eval""",
)
def q_trim_series(spark, sf_dir):
    rl = X.run_log(spark, sf_dir)
    train = R.log_series(rl, "loss", without="eval_loss")
    evals = R.log_series(rl, "eval_loss")
    t = R.trim_series(train, evals)
    return t.select("run_id", i64("point").alias("point"), r6("value").alias("value"))


# Logs as the trainer writes them: eval_loss only where an evaluation took place, every second
# record, and none on every seventh of those.
_GAPPED_SQL = f"""_all AS ({EPOCH_LOG_SQL}),
_log AS (SELECT run_id, epoch * 2 AS epoch, CASE WHEN epoch % 7 = 0 THEN NULL ELSE val_loss END AS val_loss, f1 FROM _all)"""


def gapped_log(spark, sf_dir):
    """Evaluations with gaps in the epoch numbers and missing losses."""
    log = X.epoch_log(spark, sf_dir)
    loss = F.when(F.col("epoch") % 7 != 0, F.col("val_loss"))
    return log.select("run_id", (F.col("epoch") * 2).alias("epoch"), loss.alias("val_loss"), "f1")


@register("early_stop_gapped", f"WITH {_GAPPED_SQL}, {sql_stop('val_loss', 3)} {STOP_SELECT}")
def q_early_stop_gapped(spark, sf_dir):
    return _stop_cols(R.early_stop(gapped_log(spark, sf_dir), patience=3))


@register(
    "best_epoch_gapped",
    f"""WITH {_GAPPED_SQL}, {sql_stop('val_loss', 3)},
    _c AS (SELECT l.run_id, s.epochs_run, arg_min(l.epoch, struct_pack(v := l.val_loss, e := l.epoch)) FILTER (l.val_loss IS NOT NULL) AS best_epoch, min(l.val_loss) AS best_value
           FROM _log l JOIN _stop s ON l.run_id = s.run_id WHERE l.epoch <= s.last_epoch GROUP BY ALL)
    SELECT run_id, CAST(epochs_run AS BIGINT) AS epochs_run, CAST(best_epoch AS BIGINT) AS best_epoch, round(best_value, 6) AS best_value FROM _c""",
)
def q_best_epoch_gapped(spark, sf_dir):
    b = R.best_epoch(gapped_log(spark, sf_dir), patience=3)
    return b.select("run_id", i64("epochs_run").alias("epochs_run"), i64("best_epoch").alias("best_epoch"), r6("best_value").alias("best_value"))


@register(
    "checkpoint_retention_gapped",
    f"""WITH {_GAPPED_SQL},
    _p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) AS back FROM _log),
    _k AS (SELECT run_id, arg_min(epoch, struct_pack(v := val_loss, e := epoch)) FILTER (val_loss IS NOT NULL) AS best FROM _log GROUP BY run_id)
    SELECT p.run_id, CAST(p.epoch AS BIGINT) AS epoch, coalesce(p.epoch = k.best, false) AS is_best
    FROM _p p JOIN _k k ON p.run_id = k.run_id WHERE p.back <= 2 OR p.epoch = k.best""",
)
def q_checkpoint_retention_gapped(spark, sf_dir):
    kept = R.checkpoint_retention(gapped_log(spark, sf_dir), keep=2)
    return kept.select("run_id", i64("epoch").alias("epoch"), "is_best")


@register(
    "run_comparison",
    f"""WITH {LOG}, {sql_stop('val_loss', 3)},
    _b AS (SELECT l.run_id, any_value(s.epochs_run) AS epochs_run, arg_min(l.epoch, struct_pack(v := l.val_loss, e := l.epoch)) AS best_epoch,
                  min(l.val_loss) AS best_loss, max(l.f1) AS best_f1 FROM _log l JOIN _stop s ON l.run_id = s.run_id WHERE l.epoch <= s.last_epoch GROUP BY l.run_id)
    SELECT run_id, CAST(epochs_run AS BIGINT) AS epochs_run, CAST(best_epoch AS BIGINT) AS best_epoch, round(best_loss, 6) AS best_loss, round(best_f1, 6) AS best_f1,
           CAST(row_number() OVER (ORDER BY best_loss, run_id) AS BIGINT) AS place FROM _b""",
)
def q_run_comparison(spark, sf_dir):
    """Every run's best evaluation up to its stop, and its place among the runs."""
    c = R.compare_runs(X.epoch_log(spark, sf_dir), patience=3)
    return c.select(
        "run_id", i64("epochs_run").alias("epochs_run"), i64("best_epoch").alias("best_epoch"),
        r6("best_loss").alias("best_loss"), r6("best_f1").alias("best_f1"), i64("place").alias("place"),
    )


@register(
    "curve_data",
    f"""WITH {LOG}
    SELECT run_id, CAST(epoch AS BIGINT) AS epoch, 'val_loss' AS series, round(val_loss, 6) AS value FROM _log
    UNION ALL SELECT run_id, CAST(epoch AS BIGINT), 'f1', round(f1, 6) FROM _log""",
)
def q_curve_data(spark, sf_dir):
    c = R.curve_data(X.epoch_log(spark, sf_dir), ("run_id", "epoch"), ("val_loss", "f1"))
    return c.select("run_id", i64("epoch").alias("epoch"), "series", r6("value").alias("value"))


@register(
    "metrics_sink_csv",
    f"WITH {LOG} SELECT run_id, CAST(epoch AS BIGINT) AS epoch, round(val_loss, 6) AS val_loss, round(f1, 6) AS f1_score FROM _log",
)
def q_metrics_sink_csv(spark, sf_dir):
    log = X.epoch_log(spark, sf_dir).withColumnRenamed("f1", "f1_score")
    path = K.metrics_sink_csv(log, scratch_path(spark, "epoch-metrics"), cols=("epoch", "val_loss", "f1_score"))
    back = K.read_metrics_csv(spark, path, "epoch int, val_loss double, f1_score double, run_id long")
    return back.select("run_id", i64("epoch").alias("epoch"), r6("val_loss").alias("val_loss"), r6("f1_score").alias("f1_score"))
