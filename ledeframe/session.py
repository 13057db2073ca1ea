"""Session helpers: building a local session, table loading, shared scratch folders.

On a cluster the session is built by the platform; the library only *reads* its
settings.  ``spark.checkpoint.dir`` names the shared folder used to cut lineage
(``DataFrame.checkpoint``) and to hold tables the operators write.  A private
folder is created only when that setting is absent, which is the case in local
tests and benchmarks.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ledeframe") -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        # Intermediate checkpoints (lineage cuts) are removed once their data is unreachable.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ship_code() -> None:
    """Pickle this package's functions by value, so Python workers (executors) can run
    user-function operators without the package being importable there."""
    from pyspark import cloudpickle

    import ledeframe

    cloudpickle.register_pickle_by_value(ledeframe)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting a private one only when none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        # One machine (tests, bench): any folder is shared.
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledeframe-ckpt-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint area for tables an operator writes."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + f"/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably in the shared checkpoint folder.

    Used where a result is read more than once and must be identical each time
    (e.g. partition-local ids) or is a small fitted artifact.  Not persisted
    first: a cached plan keeps its shuffle partition count (AQE may not coalesce
    it), while the checkpoint write only re-reads the last stage from shuffle
    files.  Never ``localCheckpoint``: executors may be lost.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition ``df`` by ``key``, so per-row text work runs in parallel whatever the
    file layout.  Spark drops a later repartition on the same key, so document-keyed
    plans pay nothing extra."""
    return df.repartition(F.col(key))


def spread_if_coarse(df: DataFrame, key: str) -> DataFrame:
    """``spread`` where the files give fewer tasks than there are cores; otherwise ``df`` as it is, without a shuffle."""
    return spread(df, key) if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism else df
