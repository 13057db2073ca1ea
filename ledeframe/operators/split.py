"""Exact, reproducible splits.

Rows are ordered inside each class by a seeded hash of the id (F13).  The
per-class quota is found with a histogram over the first ``bucket_bits`` hash
bits: whole buckets below the boundary go to the first side, whole buckets
above it to the other, and only the rows of each class's boundary bucket are
ranked.  No window ever sees a whole class, so a class holding most rows does
not become one task, and rows away from the boundary are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledeframe.functions.rand import seeded_bits
from ledeframe.session import cut_lineage


def class_quotas(counts: DataFrame, label_col: str, val_share: float) -> DataFrame:
    """Per-class train/val sizes: n_val = ceil(share * n); train allocated first by
    largest remainder (ties by label ascending), the remainder of each class is val.

    ``counts`` has one row per class (``label_col``, ``c``), however many there are: totals are
    scalar subqueries and the remainders are ranked with the distributed row index.
    """
    from ledeframe.operators.order import with_row_index

    counts = cut_lineage(counts)
    q = counts.withColumn("_n", counts.agg(F.sum("c").alias("n")).scalar())
    q = q.withColumn("_nval", F.ceil(F.lit(float(val_share)) * F.col("_n").cast("double")))
    q = q.withColumn("_ntrain", F.col("_n") - F.col("_nval"))
    q = q.withColumn("_cont", F.col("c").cast("double") / F.col("_n").cast("double") * F.col("_ntrain").cast("double"))
    q = q.withColumn("_fl", F.floor("_cont")).withColumn("_rem", F.col("_cont") - F.col("_fl"))
    order = [F.col("_rem").desc(), F.col(label_col).asc_nulls_first()]
    need = q.agg((F.first("_ntrain") - F.sum("_fl")).alias("need")).scalar()
    q = with_row_index(q, order, "_rk0").withColumn("_rk", F.col("_rk0") + 1)
    q = q.withColumn("train_n", (F.col("_fl") + F.when(F.col("_rk") <= need, 1).otherwise(0)).cast("long"))
    q = q.withColumn("val_n", (F.col("c") - F.col("train_n")).cast("long"))
    return q.select(label_col, F.col("c").cast("long").alias("class_n"), "train_n", "val_n")


def _quota_split(
    df: DataFrame,
    label_col: str,
    id_col: str,
    quota_col: str,
    first_side: str,
    other_side: str,
    quotas: DataFrame,
    seed: int,
    bucket_bits: int,
    name: str,
    materialize: bool = False,
) -> DataFrame:
    keyed = df.withColumn("_h", seeded_bits(seed, id_col)).withColumn(
        "_b", F.shiftrightunsigned(F.col("_h"), 32 - bucket_bits)
    )
    if materialize:
        # The input is read three times (histogram, rows away from the boundary,
        # boundary rows); an expensive upstream is computed once instead.
        keyed = cut_lineage(keyed)
    hist = keyed.groupBy(F.col(label_col).alias("_lab"), "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    upto = Window.partitionBy("_lab").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("_incl", F.sum("_cnt").over(upto)).withColumn("_before", F.col("_incl") - F.col("_cnt"))
    q = quotas.select(F.col(label_col).alias("_lab"), F.col(quota_col).alias("_q"))
    bound = (
        hist.join(q, hist["_lab"].eqNullSafe(q["_lab"]))
        .filter((F.col("_before") < F.col("_q")) & (F.col("_q") <= F.col("_incl")))
        .select(hist["_lab"], "_q", F.col("_b").alias("_bb"), F.col("_before").alias("_bbefore"))
    )
    # One row per class: broadcast by the planner when its bytes allow, else a shuffle join whose
    # hot classes are split at run time.
    joined = keyed.join(bound, keyed[label_col].eqNullSafe(bound["_lab"]), "left").drop("_lab")
    on_edge = F.col("_bb").isNotNull() & (F.col("_b") == F.col("_bb"))
    away = joined.filter(~on_edge).withColumn(
        name, F.when(F.col("_bb").isNotNull() & (F.col("_b") < F.col("_bb")), F.lit(first_side)).otherwise(F.lit(other_side))
    )
    rank = Window.partitionBy(label_col).orderBy("_h", id_col)  # boundary-bucket rows only
    edge = joined.filter(on_edge).withColumn(
        name,
        F.when(F.col("_bbefore") + F.row_number().over(rank) <= F.col("_q"), F.lit(first_side)).otherwise(F.lit(other_side)),
    )
    cols = df.columns + [name]
    return away.select(*cols).unionByName(edge.select(*cols))


def stratified_split(
    df: DataFrame,
    label_col: str,
    id_col: str,
    val_share: float = 0.2,
    seed: int = 42,
    bucket_bits: int = 20,
    name: str = "split",
    materialize: bool = False,
) -> DataFrame:
    """Label-stratified train/val split with exact per-class sizes.

    In each class the first ``train_n`` rows in md5(seed|id) order are train.
    ``materialize`` checkpoints the input once when it is expensive to recompute
    (the split reads it several times).
    """
    if materialize:
        df = cut_lineage(df)
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("c"))
    quotas = class_quotas(counts, label_col, val_share)
    return _quota_split(df, label_col, id_col, "train_n", "train", "val", quotas, seed, bucket_bits, name)


def random_split(
    df: DataFrame, id_col: str, seed: int, val_share: float = 0.2, bucket_bits: int = 20, name: str = "split"
) -> DataFrame:
    """Unstratified split, n_val = ceil(share * n); the first n_val rows in
    md5(seed|id) order are val.  The seed is required."""
    keyed = df.withColumn("_one", F.lit(1))
    counts = keyed.agg(F.count(F.lit(1)).alias("c")).withColumn("_one", F.lit(1))
    quotas = counts.select(
        "_one", F.ceil(F.lit(float(val_share)) * F.col("c").cast("double")).cast("long").alias("val_n")
    )
    out = _quota_split(keyed, "_one", id_col, "val_n", "val", "train", quotas, seed, bucket_bits, name)
    return out.drop("_one")


def split_sizes(df: DataFrame, label_col: str, split_col: str = "split") -> DataFrame:
    """Rows per split and class."""
    return df.groupBy(split_col, label_col).agg(F.count(F.lit(1)).alias("n_rows"))
