"""Predictions, losses and classification metrics.

Everything is an aggregation: the data is reduced map-side to one row per
(true, predicted) cell before any shuffle, so metric cost does not depend on
class skew.  The label set (k classes) is the only thing multiplied out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def threshold_predict(df: DataFrame, p_col: str = "p", out: str = "pred", threshold: float = 0.5) -> DataFrame:
    """Class 1 iff probability > threshold (strict)."""
    return df.withColumn(out, (F.col(p_col) > F.lit(threshold)).cast("int"))


def filter_errors(df: DataFrame, y_col: str = "y", pred_col: str = "pred") -> DataFrame:
    """P10: rows whose prediction differs from the truth."""
    return df.filter(F.col(y_col) != F.col(pred_col))


def align_predictions(preds: DataFrame, truth: DataFrame, id_col: str) -> DataFrame:
    """Pair each prediction with its truth by id (never by position)."""
    return preds.join(truth, id_col, "inner")


def error_text_lookup(preds: DataFrame, texts: DataFrame, id_col: str, y_col: str = "y", pred_col: str = "pred") -> DataFrame:
    """Original text of every wrong prediction."""
    return filter_errors(preds, y_col, pred_col).join(texts, id_col, "inner")


def confusion_cells(df: DataFrame, y_col: str = "y", pred_col: str = "pred") -> DataFrame:
    """A5 (long form): count per (true, predicted) over the sorted union of labels,
    zero cells included."""
    counts = df.groupBy(F.col(y_col).alias("y"), F.col(pred_col).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    # The distinct labels are found first (distributed); only the k-label set is gathered,
    # and the k x k grid it spans is the matrix itself.
    labels = counts.select(F.explode(F.array("y", "pred")).alias("v")).distinct()
    label_set = labels.agg(F.array_sort(F.collect_list("v")).alias("_ls"))
    grid = label_set.select(F.explode("_ls").alias("y"), "_ls").select("y", F.explode("_ls").alias("pred"))
    return grid.join(counts, ["y", "pred"], "left").select("y", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def confusion_matrix(df: DataFrame, y_col: str = "y", pred_col: str = "pred") -> DataFrame:
    """A5 (wide form): one row per true label, one column per predicted label."""
    cells = confusion_cells(df, y_col, pred_col)
    return cells.groupBy("y").pivot("pred").agg(F.first("n")).orderBy("y")


def per_class(df: DataFrame, y_col: str = "y", pred_col: str = "pred") -> DataFrame:
    """Per-class precision, recall, F1 and support; 0 where undefined."""
    # From the counts that occur: each (y, pred) count adds to the support of y and the predictions of pred.
    counts = df.groupBy(F.col(y_col).alias("y"), F.col(pred_col).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    hit, none = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0), F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("support"), none.alias("predicted"), hit.cast("long").alias("tp")),
        F.struct(F.col("pred").alias("label"), none.alias("support"), F.col("n").alias("predicted"), none.alias("tp")),
    )
    j = counts.select(F.inline(sides)).groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    tp, sup, prd = F.col("tp").cast("double"), F.col("support").cast("double"), F.col("predicted").cast("double")
    return j.select(
        "label",
        metric_or_zero(tp, prd).alias("precision"),
        metric_or_zero(tp, sup).alias("recall"),
        metric_or_zero(2 * tp, 2 * tp + (prd - tp) + (sup - tp)).alias("f1"),
        F.col("support").cast("long").alias("support"),
    )


def metric_or_zero(num, den) -> Column:
    """A10: ``num / den``, or 0.0 when it cannot be computed."""
    return F.coalesce(F.try_divide(_c(num).cast("double"), _c(den).cast("double")), F.lit(0.0))


def accuracy(df: DataFrame, y_col: str = "y", pred_col: str = "pred") -> DataFrame:
    """Share of rows predicted right."""
    return df.agg(F.avg((F.col(y_col) == F.col(pred_col)).cast("double")).alias("accuracy"))


def binary_prf(df: DataFrame, y_col: str = "y", pred_col: str = "pred", pos_label: int = 1) -> DataFrame:
    """Precision, recall and F1 of the positive class."""
    y, p = F.col(y_col) == pos_label, F.col(pred_col) == pos_label
    agg = df.agg(
        F.sum((y & p).cast("long")).alias("tp"),
        F.sum((~y & p).cast("long")).alias("fp"),
        F.sum((y & ~p).cast("long")).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return agg.select(
        metric_or_zero(tp, tp + fp).alias("precision"),
        metric_or_zero(tp, tp + fn).alias("recall"),
        metric_or_zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def weighted_prf(df: DataFrame, y_col: str = "y", pred_col: str = "pred") -> DataFrame:
    """Per-class precision/recall/F1 averaged with support weights."""
    pc = per_class(df, y_col, pred_col)
    s = F.sum("support").cast("double")
    return pc.agg(
        metric_or_zero(F.sum(F.col("precision") * F.col("support")), s).alias("precision"),
        metric_or_zero(F.sum(F.col("recall") * F.col("support")), s).alias("recall"),
        metric_or_zero(F.sum(F.col("f1") * F.col("support")), s).alias("f1"),
    )


def classification_report(df: DataFrame, y_col: str = "y", pred_col: str = "pred", names: dict | None = None, digits: int = 4) -> DataFrame:
    """Per-class rows plus accuracy, macro avg and weighted avg rows, rounded."""
    pc = per_class(df, y_col, pred_col)
    if names:
        m = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
        cls_name = F.coalesce(F.try_element_at(m, F.col("label")), F.col("label").cast("string"))
    else:
        cls_name = F.col("label").cast("string")
    rows = pc.select(cls_name.alias("row"), F.lit(0).alias("row_order"), "label", "precision", "recall", "f1", "support")
    s = F.sum("support")
    sd = s.cast("double")
    tp_share = F.sum(F.col("recall") * F.col("support")) / sd  # sum of tp / n
    summary = pc.agg(
        tp_share.alias("acc"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / sd).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / sd).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / sd).alias("wf"),
        s.alias("n"),
    )
    null = F.lit(None).cast("double")
    acc = summary.select(F.lit("accuracy").alias("row"), F.lit(1).alias("row_order"), F.lit(None).cast("int").alias("label"), null.alias("precision"), null.alias("recall"), F.col("acc").alias("f1"), F.col("n").alias("support"))
    mac = summary.select(F.lit("macro avg").alias("row"), F.lit(2).alias("row_order"), F.lit(None).cast("int").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("n").alias("support"))
    wei = summary.select(F.lit("weighted avg").alias("row"), F.lit(3).alias("row_order"), F.lit(None).cast("int").alias("label"), F.col("wp").alias("precision"), F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").alias("support"))
    rep = rows.unionByName(acc).unionByName(mac).unionByName(wei)
    return rep.select(
        "row", "row_order", "label",
        *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")],
        F.col("support").cast("long").alias("support"),
    )


def log_softmax_terms(z) -> Column:
    """log-sum-exp of an array, max-shifted."""
    zc = _c(z)
    m = F.array_max(zc)
    return m + F.log(F.aggregate(zc, F.lit(0.0), lambda a, v: a + F.exp(v - m)))


def cross_entropy(z, y, smoothing: float = 0.0) -> Column:
    """A11 / A12 per row: lse(z) - (1-e) z[y] - e mean(z) (``smoothing`` e = 0 -> plain CE).

    ``y`` is a 0-based class index.
    """
    zc = _c(z)
    lse = log_softmax_terms(zc)
    zy = F.element_at(zc, _c(y).cast("int") + 1)
    if not smoothing:
        return lse - zy
    mean_z = F.aggregate(zc, F.lit(0.0), lambda a, v: a + v) / F.size(zc)
    return lse - F.lit(1.0 - smoothing) * zy - F.lit(float(smoothing)) * mean_z


def binary_cross_entropy(p, y, eps: float = 1e-7) -> Column:
    """A13 per row, probability input: p clipped to [eps, 1-eps], eps inside the logs."""
    pc = F.least(F.greatest(_c(p), F.lit(eps)), F.lit(1.0 - eps))
    yc = _c(y).cast("double")
    return -(yc * F.log(pc + F.lit(eps)) + (F.lit(1.0) - yc) * F.log(F.lit(1.0) - pc + F.lit(eps)))


def report_text(df: DataFrame, cols, digits: int = 4) -> DataFrame:
    """K5: metric columns rounded and formatted with ``digits`` decimals."""
    out = df
    for c in cols:
        out = out.withColumn(c, F.format_number(F.round(F.col(c), digits), digits))
    return out


def metric_callback(df: DataFrame, y_col: str = "y", pred_col: str = "pred") -> DataFrame:
    """U4: the trainer's metric hook: accuracy and weighted P/R/F1 as one row
    (accuracy equals the support-weighted recall, so one aggregation gives all four)."""
    pc = per_class(df, y_col, pred_col)
    s = F.sum("support").cast("double")
    return pc.agg(
        metric_or_zero(F.sum(F.col("recall") * F.col("support")), s).alias("accuracy"),
        metric_or_zero(F.sum(F.col("precision") * F.col("support")), s).alias("precision"),
        metric_or_zero(F.sum(F.col("recall") * F.col("support")), s).alias("recall"),
        metric_or_zero(F.sum(F.col("f1") * F.col("support")), s).alias("f1"),
    )
