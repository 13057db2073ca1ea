"""Sinks (K1-K3): error samples, epoch metrics, model plus manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def error_sink_csv(df: DataFrame, path: str, text_col: str = "text") -> str:
    """K1: write the misclassified texts, one column ``text``, header, no index."""
    (
        df.select(F.col(text_col).alias("text"))
        .write.mode("overwrite")
        .options(header=True, quote='"', escape='"')
        .csv(path)
    )
    return path


def metrics_sink_csv(df: DataFrame, path: str, cols=("epoch", "train_loss", "val_loss", "f1_score"), partition_by: str | None = "run_id") -> str:
    """K2: epoch metrics as CSV with a header, one folder per run.  Writing a run again replaces that run and leaves
    the others.  A column that is absent is an error."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"metrics without the columns {missing}")
    keep = ([partition_by] if partition_by else []) + list(cols)
    w = df.select(*keep).write.mode("overwrite").options(header=True)
    if partition_by:
        w = w.partitionBy(partition_by).option("partitionOverwriteMode", "dynamic")
    w.csv(path)
    return path


def read_metrics_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read back what ``metrics_sink_csv`` wrote (partition column recovered from folders)."""
    return spark.read.schema(schema).options(header=True).csv(path)


def model_sink(model, path: str, spark: SparkSession, manifest: dict) -> DataFrame:
    """K3: save a Spark ML model and one manifest row next to it; returns the manifest."""
    model.write().overwrite().save(path + "/model")
    row = dict(manifest)
    row["path"] = path + "/model"
    man = spark.createDataFrame([row])
    man.write.mode("overwrite").parquet(path + "/manifest")
    return spark.read.parquet(path + "/manifest")


class BestWeightsSink:
    """K3, best only: an epoch-end listener that saves the weights whenever the validation loss strictly
    improves, and keeps a manifest of (run_id, epoch, val_loss, f1, path)."""

    def __init__(self, spark: SparkSession, path: str, run_id: str):
        self.spark, self.path, self.run_id = spark, path, run_id
        self.best, self.saved = float("inf"), []

    def __call__(self, epoch: int, w: list, b: float, metrics: dict) -> None:
        loss = metrics["val_loss"]
        if loss is None or not loss < self.best:
            return
        self.best = loss
        to = f"{self.path}/epoch={epoch}"
        self.spark.createDataFrame([(w, b)], "w array<double>, b double").write.mode("overwrite").parquet(to)
        self.saved.append((self.run_id, epoch, loss, metrics["val_f1"], to))

    def manifest(self) -> DataFrame:
        rows = self.spark.createDataFrame(self.saved, "run_id string, epoch int, val_loss double, f1 double, path string")
        rows.write.mode("overwrite").parquet(f"{self.path}/manifest")
        return self.spark.read.parquet(f"{self.path}/manifest")

    def load_best(self) -> tuple[list, float]:
        row = self.spark.read.parquet(self.saved[-1][-1]).first()
        return list(row["w"]), row["b"]


class Checkpoints:
    """K3, full state: a folder of epoch states, each written whole before an entry names it.

    A state goes to a folder of its own; the entry is one small file that appears by a rename. What was
    cut off while it was written has no entry, or its folder is not whole, and is passed over.
    """

    STATE = (
        "epoch int, best double, since int, best_epoch int, stop_epoch int, weights array<struct<w: array<double>, b: double>>, "
        "log array<struct<run_id: string, epoch: int, train_loss: double, val_loss: double, val_f1: double, val_accuracy: double, lr: double, l2_penalty: double>>"
    )

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _entries(self) -> list[tuple[int, str]]:
        """(epoch, folder) of the entries, the newest first."""
        if not self.fs.exists(self._path("entries")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path("entries"))]
        return sorted(((int(n.split("-")[0]), n) for n in names if n.split("-")[0].isdigit()), reverse=True)

    def commit(self, state: dict) -> None:
        name = f"{state['epoch']:08d}-{uuid.uuid4().hex[:12]}"
        self.spark.createDataFrame([state], self.STATE).coalesce(1).write.parquet(f"{self.path}/states/{name}")
        self.fs.mkdirs(self._path("entries"))
        aside = self._path(f"aside-{name}")
        self.fs.create(aside).close()
        self.fs.rename(aside, self._path(f"entries/{name}"))
        for _, old in self._entries()[self.keep :]:
            self.fs.delete(self._path(f"entries/{old}"), False)
            self.fs.delete(self._path(f"states/{old}"), True)

    def newest(self) -> dict | None:
        """The state of the newest entry whose folder was finished; None without any."""
        for _, name in self._entries():
            if self.fs.exists(self._path(f"states/{name}/_SUCCESS")):
                return self.spark.read.schema(self.STATE).parquet(f"{self.path}/states/{name}").first().asDict(recursive=True)
        return None
