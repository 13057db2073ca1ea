"""Pieces shared by the corpus operators.

Words are maximal runs of anything but the six ASCII blanks (space and U+0009 to
U+000D) everywhere in this package. Operators take only the columns they are
told to use, so further columns of any name pass by unseen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledeframe.session import cut_lineage, scratch_path, ship_code, table

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: Column) -> Column:
    """The words as an array; null has none."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts lineage as a checkpoint does, in a third
    of the space. The table goes when the session ends."""
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.parquet(path)


def give_back() -> None:
    """Returns what a Python worker has freed to the system (where the C library can), as workers live on between tasks."""
    import ctypes
    import gc

    gc.collect()
    getattr(ctypes.CDLL(None), "malloc_trim", int)(0)


def hex64(value: Column) -> Column:
    """16 lowercase hex digits of a long read as unsigned."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): root is the smallest node reachable over undirected ``edges``.

    Alternating large and small stars: every round links each node's larger
    neighbours to the smallest one it knows, then does the same for its smaller
    ones, so paths shrink geometrically. Only the minimum per node is aggregated
    (with partial aggregation) and joined back, so a node with very many edges
    never has its neighbours collected; the edge set is checkpointed each round.
    Nodes without an edge to another node are absent. Empty edges give an empty
    table; null ends are ignored.
    """
    u, v = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    stars = edges.where(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct()
    stars = cut_lineage(stars)

    def digest(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    before = digest(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        after = digest(stars)
        if after == before:
            break
        before = after
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


__all__ = ["BLANK", "WORD", "connected_components", "cut_lineage", "documents", "give_back", "hex64", "ship_code", "table", "unused", "word_count", "words_of", "written"]
