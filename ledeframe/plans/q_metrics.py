"""Registered queries: predictions, losses and classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledeframe.functions.sequence import argmax_class
from ledeframe.operators import metrics as M
from ledeframe.operators import order as O
from ledeframe.operators import runlog as R
from ledeframe.plans import fixtures as X
from ledeframe.plans.catalog import (
    HEADLINES_SQL,
    LOGITS_SQL,
    PREDICTIONS_SQL,
    PROBABILITIES_SQL,
    i64,
    r6,
    register,
)
from ledeframe.session import table

LOGIT_PRED_SQL = f"SELECT vec_id, label AS y, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS pred FROM ({LOGITS_SQL})"


def sql_per_class(src: str) -> str:
    """CTEs ``_cells(y, pred, n)`` and ``_pcm(label, precision, recall, f1, support)`` for a (y, pred) source."""
    return f"""
_p AS ({src}),
_pcnt AS (SELECT y, pred, count(*) AS n FROM _p GROUP BY y, pred),
_ls AS (SELECT DISTINCT v FROM (SELECT y AS v FROM _p UNION ALL SELECT pred FROM _p)),
_cells AS (SELECT a.v AS y, b.v AS pred, coalesce(c.n, 0) AS n FROM _ls a CROSS JOIN _ls b LEFT JOIN _pcnt c ON c.y = a.v AND c.pred = b.v),
_bt AS (SELECT y AS label, sum(n) AS support, sum(CASE WHEN y = pred THEN n END) AS tp FROM _cells GROUP BY y),
_bp AS (SELECT pred AS label, sum(n) AS predicted FROM _cells GROUP BY pred),
_pcm AS (SELECT _bt.label,
                coalesce(tp::DOUBLE / nullif(predicted, 0)::DOUBLE, 0.0) AS precision,
                coalesce(tp::DOUBLE / nullif(support, 0)::DOUBLE, 0.0) AS recall,
                coalesce(2.0 * tp::DOUBLE / nullif(2 * tp + (predicted - tp) + (support - tp), 0)::DOUBLE, 0.0) AS f1,
                support
         FROM _bt JOIN _bp ON _bt.label = _bp.label)
"""


def _logit_preds(spark, sf_dir):
    lg = X.logits(spark, sf_dir)
    return lg.select("vec_id", F.col("label").alias("y"), argmax_class("z").alias("pred"))


@register(
    "confusion_matrix",
    f"WITH {sql_per_class(PREDICTIONS_SQL)} SELECT CAST(y AS BIGINT) AS y, CAST(pred AS BIGINT) AS pred, CAST(n AS BIGINT) AS n FROM _cells",
)
def q_confusion_matrix(spark, sf_dir):
    cells = M.confusion_cells(X.predictions(spark, sf_dir))
    return cells.select(i64("y").alias("y"), i64("pred").alias("pred"), i64("n").alias("n"))


@register("accuracy", f"SELECT round(avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({LOGIT_PRED_SQL})")
def q_accuracy(spark, sf_dir):
    return M.accuracy(_logit_preds(spark, sf_dir)).select(r6("accuracy").alias("accuracy"))


@register(
    "binary_prf",
    f"""WITH _p AS ({PREDICTIONS_SQL}),
    _a AS (SELECT sum(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y <> 1 AND pred = 1 THEN 1 ELSE 0 END) AS fp,
                  sum(CASE WHEN y = 1 AND pred <> 1 THEN 1 ELSE 0 END) AS fn FROM _p)
    SELECT round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0), 6) AS recall,
           round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1 FROM _a""",
)
def q_binary_prf(spark, sf_dir):
    b = M.binary_prf(X.predictions(spark, sf_dir))
    return b.select(*[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@register(
    "weighted_prf",
    f"""WITH {sql_per_class(LOGIT_PRED_SQL)}
    SELECT round(sum(precision * support) / sum(support)::DOUBLE, 6) AS precision, round(sum(recall * support) / sum(support)::DOUBLE, 6) AS recall,
           round(sum(f1 * support) / sum(support)::DOUBLE, 6) AS f1 FROM _pcm""",
)
def q_weighted_prf(spark, sf_dir):
    w = M.weighted_prf(_logit_preds(spark, sf_dir))
    return w.select(*[r6(c).alias(c) for c in ("precision", "recall", "f1")])


_REPORT_SQL = f"""WITH {sql_per_class(LOGIT_PRED_SQL)},
_s AS (SELECT sum(recall * support) / sum(support)::DOUBLE AS acc, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
              sum(precision * support) / sum(support)::DOUBLE AS wp, sum(recall * support) / sum(support)::DOUBLE AS wr,
              sum(f1 * support) / sum(support)::DOUBLE AS wf, sum(support) AS n FROM _pcm),
_rep AS (
  SELECT CAST(label AS VARCHAR) AS "row", 0 AS row_order, label, precision, recall, f1, support FROM _pcm
  UNION ALL SELECT 'accuracy', 1, NULL, NULL, NULL, acc, n FROM _s
  UNION ALL SELECT 'macro avg', 2, NULL, mp, mr, mf, n FROM _s
  UNION ALL SELECT 'weighted avg', 3, NULL, wp, wr, wf, n FROM _s)
"""


@register(
    "classification_report",
    _REPORT_SQL
    + """SELECT "row", row_order, CAST(label AS BIGINT) AS label, round(precision, 4) AS precision, round(recall, 4) AS recall,
              round(f1, 4) AS f1, CAST(support AS BIGINT) AS support FROM _rep""",
)
def q_classification_report(spark, sf_dir):
    rep = M.classification_report(_logit_preds(spark, sf_dir))
    return rep.select("row", "row_order", i64("label").alias("label"), "precision", "recall", "f1", "support")


@register(
    "report_text",
    _REPORT_SQL
    + """SELECT "row", printf('%.4f', round(f1, 4)) AS f1, printf('%.4f', round(recall, 4)) AS recall, CAST(support AS BIGINT) AS support FROM _rep""",
)
def q_report_text(spark, sf_dir):
    rep = M.classification_report(_logit_preds(spark, sf_dir))
    txt = M.report_text(rep, ["f1", "recall"], 4)
    return txt.select("row", "f1", "recall", "support")


@register(
    "metric_or_zero",
    f"""WITH {sql_per_class(LOGIT_PRED_SQL)}
    SELECT CAST(label AS BIGINT) AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM _pcm""",
)
def q_metric_or_zero(spark, sf_dir):
    pc = M.per_class(_logit_preds(spark, sf_dir))
    return pc.select(i64("label").alias("label"), *[r6(c).alias(c) for c in ("precision", "recall", "f1")], i64("support").alias("support"))


@register(
    "metric_callback",
    f"""WITH {sql_per_class(LOGIT_PRED_SQL)},
    _acc AS (SELECT avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM _p)
    SELECT round((SELECT accuracy FROM _acc), 6) AS accuracy,
           round(sum(precision * support) / sum(support)::DOUBLE, 6) AS precision, round(sum(recall * support) / sum(support)::DOUBLE, 6) AS recall,
           round(sum(f1 * support) / sum(support)::DOUBLE, 6) AS f1 FROM _pcm""",
)
def q_metric_callback(spark, sf_dir):
    m = M.metric_callback(_logit_preds(spark, sf_dir))
    return m.select(*[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


_LSE = "(list_max(z) + ln(list_sum(list_transform(z, lambda v: exp(v - list_max(z))))))"


@register("cross_entropy", f"SELECT vec_id, round({_LSE} - z[label + 1], 6) AS ce FROM ({LOGITS_SQL})")
def q_cross_entropy(spark, sf_dir):
    lg = X.logits(spark, sf_dir)
    return lg.select("vec_id", r6(M.cross_entropy("z", "label")).alias("ce"))


@register(
    "label_smoothed_ce",
    f"SELECT vec_id, round({_LSE} - 0.9 * z[label + 1] - 0.1 * (list_sum(z) / len(z)), 6) AS ce FROM ({LOGITS_SQL})",
)
def q_label_smoothed_ce(spark, sf_dir):
    lg = X.logits(spark, sf_dir)
    return lg.select("vec_id", r6(M.cross_entropy("z", "label", smoothing=0.1)).alias("ce"))


@register(
    "binary_cross_entropy",
    f"""WITH _p AS ({PROBABILITIES_SQL}), _c AS (SELECT least(greatest(p, 1e-7), 1.0 - 1e-7) AS pc, (label % 2)::DOUBLE AS y FROM _p)
    SELECT round(avg(-(y * ln(pc + 1e-7) + (1.0 - y) * ln(1.0 - pc + 1e-7))), 6) AS bce FROM _c""",
)
def q_binary_cross_entropy(spark, sf_dir):
    pr = X.probabilities(spark, sf_dir)
    return pr.agg(F.avg(M.binary_cross_entropy("p", F.col("label") % 2)).alias("bce")).select(r6("bce").alias("bce"))


@register("argmax_class", f"SELECT vec_id, CAST(pred AS BIGINT) AS pred FROM ({LOGIT_PRED_SQL})")
def q_argmax_class(spark, sf_dir):
    return _logit_preds(spark, sf_dir).select("vec_id", i64("pred").alias("pred"))


@register("threshold_predict", f"SELECT vec_id, CAST(CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS BIGINT) AS pred FROM ({PROBABILITIES_SQL})")
def q_threshold_predict(spark, sf_dir):
    return M.threshold_predict(X.probabilities(spark, sf_dir)).select("vec_id", i64("pred").alias("pred"))


@register("filter_errors", f"SELECT doc_id, CAST(y AS BIGINT) AS y, CAST(pred AS BIGINT) AS pred FROM ({PREDICTIONS_SQL}) WHERE y <> pred")
def q_filter_errors(spark, sf_dir):
    return M.filter_errors(X.predictions(spark, sf_dir)).select("doc_id", i64("y").alias("y"), i64("pred").alias("pred"))


@register(
    "align_predictions",
    f"SELECT h.doc_id, CAST(h.label AS BIGINT) AS y, CAST(l.toxic AS BIGINT) AS pred FROM labels l JOIN ({HEADLINES_SQL}) h ON l.doc_id = h.doc_id",
)
def q_align_predictions(spark, sf_dir):
    preds = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("pred"))
    truth = X.headlines(spark, sf_dir).select("doc_id", F.col("label").alias("y"))
    return M.align_predictions(preds, truth, "doc_id").select("doc_id", i64("y").alias("y"), i64("pred").alias("pred"))


@register(
    "error_text_lookup",
    f"SELECT p.doc_id, md5(d.text) AS text_md5 FROM ({PREDICTIONS_SQL}) p JOIN documents d ON p.doc_id = d.doc_id WHERE p.y <> p.pred",
)
def q_error_text_lookup(spark, sf_dir):
    texts = X.corpus(spark, sf_dir).select("doc_id", "text")
    return M.error_text_lookup(X.predictions(spark, sf_dir), texts, "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


@register(
    "epoch_loss",
    """WITH _b AS (SELECT value, floor((row_number() OVER (ORDER BY event_id) - 1) / 128) AS batch_id FROM events),
    _m AS (SELECT batch_id, avg(value) AS bm, sum(value) AS bs, count(*) AS bn FROM _b GROUP BY batch_id)
    SELECT round(avg(bm), 6) AS epoch_loss, round(sum(bs) / sum(bn)::DOUBLE, 6) AS row_mean_loss, count(*) AS n_batches FROM _m""",
)
def q_epoch_loss(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "value")
    batched = O.batch_assign(ev, [F.col("event_id")], 128)
    el = R.epoch_loss(batched, "batch_id", "value")
    return el.select(r6("epoch_loss").alias("epoch_loss"), r6("row_mean_loss").alias("row_mean_loss"), "n_batches")
