"""End-to-end flows of the reference scripts, composed from the operators.

* ``loop_flow`` (hand-written loop style): read CSV -> known categories ->
  label map -> drop null / blank titles -> clean -> stratified split ->
  vocabulary on train -> ids -> mean-pooled word vectors -> T1 with early
  stopping -> best epoch -> validation report; the epoch metrics are written
  as CSV per run.
* ``trainer_flow`` (trainer-object style): drop nulls -> label map -> seeded
  random split -> batched user map -> model columns -> Spark ML fit -> metrics.
* ``sequence_flow`` (sequence-model style): read CSV -> clean -> vocabulary on
  all rows -> ids -> pad -> stratified split -> embedding matrix -> attention
  pooling -> MLP classifier -> threshold -> report and confusion matrix.

Each returns DataFrames (and paths) rather than printing; everything heavy runs
on Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledeframe.functions.sequence import pad_sequence
from ledeframe.functions.text import clean_alnum, clean_headline
from ledeframe.operators import hygiene as H
from ledeframe.operators import labels as L
from ledeframe.operators import metrics as M
from ledeframe.operators import split as SP
from ledeframe.operators import train as T
from ledeframe.operators import vectors as VE
from ledeframe.operators import vocab as V
from ledeframe.session import scratch_path
from ledeframe.sources import sinks as K
from ledeframe.sources import tables as S


def _features(df: DataFrame, vocab: DataFrame, vectors: DataFrame, max_words: int, max_len: int, dim: int, text_col: str, attention_w=None) -> DataFrame:
    enc = V.token_to_id(df, vocab, max_words, text_col, "doc_id").withColumn("ids", pad_sequence("ids", max_len))
    matrix = VE.embedding_matrix(vocab, vectors, max_words, dim)
    seqs = VE.vector_sequences(enc.select("doc_id", "ids"), matrix)
    if attention_w is not None:
        pooled = VE.with_attention_pool(seqs, "vecs", attention_w, dim)
    else:
        pooled = VE.with_mean_pool(seqs, "vecs", "pos_ids", dim)
    return enc.select("doc_id", "label", "split").join(pooled.select("doc_id", F.col("pooled").alias("x")), "doc_id")


def loop_flow(
    spark: SparkSession,
    csv_path: str,
    vectors: DataFrame,
    dim: int,
    encoding: str = "ISO-8859-1",
    max_words: int = 8000,
    max_len: int = 64,
    cfg: T.TrainConfig | None = None,
    val_share: float = 0.2,
    seed: int = 42,
) -> dict:
    cfg = cfg or T.TrainConfig(max_epochs=15, lr=0.5, patience=4, l2=0.05, run_id="loop")
    raw = S.csv_scan(spark, csv_path, encoding=encoding)
    rows = H.filter_domain(raw, "category", L.HEADLINE_LABELS)  # unknown categories first
    rows = L.label_map(rows, "category")
    rows = H.drop_null_subset(rows, ["title"])
    rows = H.filter_not_blank(rows, "title")  # before cleaning, as the reference does
    rows = rows.withColumn("title", clean_headline("title"))
    rows = SP.stratified_split(rows, "label", "doc_id", val_share, seed, materialize=True)
    vocab = V.vocab_top_n(rows.filter(F.col("split") == "train"), max_words, "title", "doc_id")
    feats = _features(rows, vocab, vectors, max_words, max_len, dim, "title")
    res = T.train_epochs(feats.select("doc_id", "split", F.col("label").alias("y"), "x"), dim, cfg)
    log = T.log_frame(spark, res)
    w, b = res.weights[(res.best_epoch or len(res.weights)) - 1]
    val = T.batch_score(feats.filter(F.col("split") == "val").select(F.col("label").alias("y"), "x"), w, b)
    report = M.classification_report(val.select("y", "pred"), names={0: "non-political", 1: "political"})
    metrics = log.select("run_id", "epoch", "train_loss", "val_loss", F.col("val_f1").alias("f1_score"))
    metrics_path = K.metrics_sink_csv(metrics, scratch_path(spark, "loop-metrics"))
    return {"log": log, "report": report, "metrics_path": metrics_path, "best_epoch": res.best_epoch, "stop_epoch": res.stop_epoch}


def sequence_flow(
    spark: SparkSession,
    csv_path: str,
    vectors: DataFrame,
    dim: int,
    attention_w: list[float],
    max_words: int = 2000,
    max_len: int = 30,
    val_share: float = 0.2,
    seed: int = 42,
) -> dict:
    raw = S.csv_scan(spark, csv_path)
    rows = H.null_as_text(raw, "title").withColumn("clean", clean_alnum("title"))
    rows = L.label_map(rows, "category", on_unknown="drop")
    vocab = V.vocab_top_n(rows, max_words, "clean", "doc_id")  # fit on all rows, as the reference does
    rows = SP.stratified_split(rows, "label", "doc_id", val_share, seed)
    feats = _features(rows, vocab, vectors, max_words, max_len, dim, "clean", attention_w)
    model = T.fit_classifier(feats.filter(F.col("split") == "train").select(F.col("label").alias("y"), "x"), dim, kind="mlp", hidden=16, max_iter=50)
    val = feats.filter(F.col("split") == "val").select(F.col("label").alias("y"), "x")
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(val).withColumn("p", F.get(vector_to_array("probability"), 1))
    preds = M.threshold_predict(scored, "p", "pred").select("y", "pred")
    return {"report": M.classification_report(preds), "confusion": M.confusion_cells(preds, "y", "pred")}


def trainer_flow(
    spark: SparkSession,
    csv_path: str,
    vectors: DataFrame,
    dim: int,
    batch_fn=None,
    max_words: int = 8000,
    max_len: int = 128,
    val_share: float = 0.2,
    seed: int = 42,
) -> dict:
    """Trainer-object style: drop nulls -> fixed label map (unknown stays null) ->
    seeded random split -> batched user map -> keep the model's columns ->
    Spark ML fit -> metric callback on the held-out rows."""
    from ledeframe.operators import udf as U

    raw = S.csv_scan(spark, csv_path)
    rows = H.drop_null_any(raw, ["doc_id", "title", "category"])
    rows = L.label_map(rows, "category").filter(F.col("label").isNotNull())
    rows = SP.random_split(rows, "doc_id", seed=seed, val_share=val_share)
    if batch_fn is not None:
        rows = U.map_batches(rows, batch_fn, rows.schema)  # same columns out
    vocab = V.vocab_top_n(rows.filter(F.col("split") == "train"), max_words, "title", "doc_id")
    feats = _features(rows, vocab, vectors, max_words, max_len, dim, "title")
    model_in = H.prune_columns(feats.withColumnRenamed("label", "y"), ["y", "x", "split"])
    model = T.fit_classifier(model_in.filter(F.col("split") == "train"), dim, kind="logistic", max_iter=50)
    scored = model.transform(model_in.filter(F.col("split") == "val"))
    metrics = M.metric_callback(scored.select(F.col("y").cast("int").alias("y"), F.col("prediction").cast("int").alias("pred")))
    return {"model": model, "metrics": metrics, "sizes": SP.split_sizes(rows, "label")}
