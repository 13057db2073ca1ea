"""Stand-in inputs built from the given tables (the reference ships no data).

Each function reads the parquet tables under ``sf_dir`` and derives one of the
reference's data shapes, so every query's work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledeframe.functions.mathfn import sigmoid
from ledeframe.session import spread, spread_if_coarse, table


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled texts: ``documents``."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of ``documents``, for work on single rows: dealt out anew only where the files are few."""
    return spread_if_coarse(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled headlines: documents joined with labels; category from ``quality``."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("title")), "doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(
        "doc_id",
        "title",
        F.when(F.col("quality") == 1, "political").otherwise("non-political").alias("category"),
        F.col("quality").alias("label"),
    )


def headlines_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; ``category`` is null where a document has no label (null rules)."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("title"), "lang"), "doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        "title",
        "lang",
        F.when(F.col("quality") == 1, "political").when(F.col("quality") == 0, "non-political").alias("category"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-class predictions: y = quality, pred = toxic."""
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"), F.col("toxic").alias("pred"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-class logits: class j gets the sum of the embedding's elements j, j + 10, ...; truth = label."""
    emb = table(spark, sf_dir, "embeddings").withColumn("_e", F.col("embedding").cast("array<double>"))
    own = lambda j: F.filter("_e", lambda _, i: i % 10 == j)
    z = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: F.aggregate(own(j), F.lit(0.0), lambda a, v: a + v))
    return emb.select("vec_id", z.alias("z"), "label")


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability = sigmoid of the element sum of each embedding."""
    emb = table(spark, sf_dir, "embeddings")
    s = F.aggregate(F.col("embedding"), F.lit(0.0), lambda a, v: a + v.cast("double"))
    return emb.select("vec_id", sigmoid(s).alias("p"), "label")


def epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch metrics: run = user, epochs numbered by (ts, event_id), val_loss = value, f1 = props.k / 100."""
    from ledeframe.operators.runlog import epoch_axis

    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        "ts",
        "event_id",
        F.col("value").alias("val_loss"),
        (F.get_json_object("props", "$.k").cast("double") / F.lit(100.0)).alias("f1"),
    )
    return epoch_axis(ev, "run_id", [F.col("ts"), F.col("event_id")], "epoch")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with optional keys: even epochs carry ``loss``, odd ones ``eval_loss``."""
    log = epoch_log(spark, sf_dir)
    key = F.when(F.col("epoch") % 2 == 0, F.lit("loss")).otherwise(F.lit("eval_loss"))
    return log.select(
        "run_id",
        F.col("epoch").alias("seq"),
        F.create_map(key, F.col("val_loss"), F.lit("epoch"), F.col("epoch").cast("double")).alias("log"),
    )


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word vectors: the vocabulary word whose id equals ``vec_id`` (id >= 2) gets that embedding."""
    from ledeframe.operators.vocab import vocab_fit

    vocab = vocab_fit(corpus(spark, sf_dir).select("doc_id", "text"), "text")
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("id"), F.col("embedding").alias("vec"))
    return vocab.join(emb, "id").select("word", "vec")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position sequences: seq = vec_id div 10, pos = vec_id mod 10."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.floor(F.col("vec_id") / 10).alias("seq"), (F.col("vec_id") % 10).cast("int").alias("pos"), F.col("embedding").alias("vec")
    )
