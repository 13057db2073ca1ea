"""Run logs with gaps, missing and NaN values; sequences with repeated ids; sinks; sparse metrics."""

import math

import pytest
from pyspark.sql import functions as F

from ledeframe.operators import metrics as M
from ledeframe.operators import runlog as R
from ledeframe.operators import train as T
from ledeframe.operators import vectors as VE
from ledeframe.operators import vocab as V
from ledeframe.sources import sinks as K

NAN = float("nan")


def log(spark, values, step=1):
    rows = [("r", (k + 1) * step, v, v) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "run_id string, epoch int, val_loss double, f1 double")


def test_a_missing_loss_is_no_evaluation(spark):
    df = log(spark, [1.0, None, 0.8, 0.7, 0.6, 0.5])
    assert R.early_stop(df, patience=3).first()["stop_epoch"] is None
    assert R.best_epoch(df, patience=3).first()["best_epoch"] == 6
    assert R.dual_criterion(df, patience=3).first()["loss_epoch"] == 6
    assert [(r["epoch"], r["is_best"]) for r in R.checkpoint_retention(df, keep=1).orderBy("epoch").collect()] == [(6, True)]
    kept = R.checkpoint_retention(log(spark, [1.0, None, 0.2, None, 0.9]), keep=2).orderBy("epoch").collect()
    assert [(r["epoch"], r["is_best"]) for r in kept] == [(3, True), (4, False), (5, False)]


def test_nan_never_improves(spark):
    assert R.early_stop(log(spark, [NAN] * 5), patience=3).first()["stop_epoch"] == 3
    up = R.running_best(log(spark, [0.5, NAN, 0.6, 0.7]), mode="max").orderBy("epoch").collect()
    assert [r["improved"] for r in up] == [True, False, True, True] and up[-1]["best_before"] == 0.6
    assert R.best_epoch(log(spark, [NAN, 0.4, NAN]), patience=9).first()["best_epoch"] == 2
    assert R.best_epoch(log(spark, [NAN, NAN]), patience=9).first()["best_epoch"] is None


def test_the_training_loop_and_the_log_agree_on_nan(spark):
    rows = [("train" if k % 2 else "val", [NAN, 1.0], float(k % 2)) for k in range(8)]
    feats = spark.createDataFrame(rows, "split string, x array<double>, y double")
    res = T.train_epochs(feats, 2, T.TrainConfig(max_epochs=6, patience=3, warmup_share=0.0))
    assert res.stop_epoch == 3 and res.best_epoch is None
    assert R.early_stop(T.log_frame(spark, res), patience=3).first()["stop_epoch"] == 3


def test_patience_counts_evaluations(spark):
    df = log(spark, [0.9, 0.8, 0.7, 0.75], step=2)
    got = R.early_stop(df, patience=2).first()
    assert got["stop_epoch"] is None and got["epochs_run"] == 4 and got["last_epoch"] == 8
    assert R.best_epoch(df, patience=2).first()["best_epoch"] == 6
    kept = R.checkpoint_retention(log(spark, [0.1, 0.2, 0.3, 0.4], step=2), keep=2).orderBy("epoch").collect()
    assert [r["epoch"] for r in kept] == [2, 6, 8]
    lr = R.plateau_lr(log(spark, [1.0, None, 1.0, 1.0, 1.0], step=3), patience=2, base_lr=1.0).orderBy("epoch").collect()
    assert [r["lr"] for r in lr] == [1.0, 1.0, 1.0, 0.5, 0.5]


def test_runs_are_compared(spark):
    df = log(spark, [0.9, 0.3]).union(log(spark, [0.5, 0.4]).withColumn("run_id", F.lit("s"))).union(log(spark, [None, NAN]).withColumn("run_id", F.lit("t")))
    got = {r["run_id"]: (r["best_epoch"], r["place"]) for r in R.compare_runs(df, patience=5).collect()}
    assert got == {"r": (2, 1), "s": (2, 2), "t": (None, 3)}


def test_repeated_ids_keep_their_own_sequences(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "c"), (1, "c"), (2, None), (3, "")], "doc_id long, text string")
    vocab = spark.createDataFrame([("a", 1, 1, 2), ("b", 1, 1, 3), ("c", 1, 1, 4)], "word string, n int, df int, id int")
    got = sorted((r["doc_id"], r["text"] or "", r["ids"]) for r in V.token_to_id(df, vocab, 100).collect())
    assert got == [(1, "a b", [2, 3]), (1, "c", [4]), (1, "c", [4]), (2, "", []), (3, "", [])]
    short = V.token_to_id(df, vocab, 100, max_len=1).where("text = 'a b'").first()
    assert short["ids"] == [2]


def test_attention_over_padding_only(spark):
    df = spark.createDataFrame([(1, [0, 0], [[1.0, 0.0], [0.0, 1.0]])], "doc_id long, pos_ids array<int>, vecs array<array<double>>")
    out = VE.with_attention_pool(df, "vecs", [0.3, -0.2], 2, mask_pad=True).first()
    assert out["attn"] == [0.0, 0.0] and out["pooled"] == [0.0, 0.0]


def test_attention_bias(spark):
    df = spark.createDataFrame([(1, [5, 6], [[1.0, 0.0], [0.0, 1.0]])], "doc_id long, pos_ids array<int>, vecs array<array<double>>")
    out = VE.with_attention_pool(df, "vecs", [0.3, -0.2], 2, b=[0.1, 0.4]).first()
    e = [math.exp(math.tanh(0.4)), math.exp(math.tanh(0.2))]
    assert out["attn"] == pytest.approx([v / sum(e) for v in e])


def test_metrics_sink_wants_every_column(spark, tmp_dir):
    with pytest.raises(ValueError, match="train_loss"):
        K.metrics_sink_csv(log(spark, [0.1]), tmp_dir + "/m")


def test_metrics_of_many_classes_build_no_grid(spark):
    df = spark.range(20_000).select(F.col("id").alias("y"), (F.col("id") + (F.col("id") % 2)).alias("pred"))
    got = M.weighted_prf(df).first()
    assert 0 < got["f1"] < 1
    plan = M.per_class(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_best_weights_are_saved_only_when_they_improve(spark, tmp_dir):
    sink = K.BestWeightsSink(spark, tmp_dir + "/w", "r")
    for epoch, loss in enumerate([0.5, 0.6, NAN, 0.4, None, 0.4], 1):
        sink(epoch, [float(epoch), 0.0], 1.0, {"val_loss": loss, "val_f1": 0.1})
    assert [r["epoch"] for r in sink.manifest().orderBy("epoch").collect()] == [1, 4]
    assert sink.load_best() == ([4.0, 0.0], 1.0)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from ledeframe.session import ensure_checkpoint_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=context, conf={}))
