"""Label encoding and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The two-class headline mapping.
HEADLINE_LABELS = {"non-political": 0, "political": 1}


def label_classes(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-null classes sorted ascending -> 0..k-1 (one row per class), by the distributed row index."""
    from ledeframe.operators.order import with_row_index

    classes = df.select(col).where(F.col(col).isNotNull()).distinct()
    return with_row_index(classes, [F.col(col)], "_ix").select(col, F.col("_ix").cast("int").alias("label"))


def label_encode(df: DataFrame, col: str, out: str = "label") -> DataFrame:
    """Attach the sorted-class index (a LabelEncoder fit on this column).

    The class table has one row per class; the planner broadcasts it when its bytes
    allow, and otherwise splits a hot class at run time.
    """
    return df.join(label_classes(df, col).withColumnRenamed("label", out), col, "inner")


def label_map(df: DataFrame, col: str, mapping: dict | None = None, out: str = "label", on_unknown: str = "null") -> DataFrame:
    """Fixed mapping; unknown or null -> null label, or dropped with ``on_unknown='drop'``."""
    mapping = mapping or HEADLINE_LABELS
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    res = df.withColumn(out, F.try_element_at(m, F.col(col)).cast("int"))
    return res.filter(F.col(out).isNotNull()) if on_unknown == "drop" else res


def label_decode(df: DataFrame, col: str, names: dict | None = None, out: str = "label_name") -> DataFrame:
    """Index -> display name."""
    names = names or {v: k for k, v in HEADLINE_LABELS.items()}
    m = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn(out, F.try_element_at(m, F.col(col)))


def class_cardinality(df: DataFrame, col: str) -> DataFrame:
    """A1: number of distinct (non-null) labels."""
    return df.agg(F.countDistinct(col).alias("n_classes"))
