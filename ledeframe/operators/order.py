"""Global order without a single-task window (O1, O2, W7) and skew-safe running aggregates.

``row_number()`` without ``partitionBy`` sends every row to one task.  Two
replacements:

* ``hash_order_index`` for a uniform hash order (seeded shuffles): a bucket
  histogram gives each bucket its offset and rows are ranked inside buckets.
* ``with_row_index`` for any unique order: rows are range-partitioned on the
  key, sorted inside each partition, tagged with a partition-local id, and
  shifted by the row count of all earlier partitions.  The per-partition count
  table has one row per partition, so broadcasting it is bounded by the
  partition count, not the data.  The tagged table is checkpointed to the
  shared folder first: the local ids are read twice and must come from the
  same run.

``PrefixScans`` applies the same range-partition idea to per-group prefix scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledeframe.functions.rand import seeded_bits
from ledeframe.session import cut_lineage


def with_row_index(df: DataFrame, order: list, name: str = "row_index", num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based global position ``name`` following ``order`` (a unique key)."""
    ranged = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    tagged = (
        ranged
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    tagged = cut_lineage(tagged)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy("_pid")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
        .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select("_pid", "_off", "_m0")
    )
    return (
        tagged.join(F.broadcast(offsets), "_pid")
        .withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("long"))
        .drop("_pid", "_mid", "_off", "_m0")
    )


def hash_order_index(df: DataFrame, seed: int, id_col: str, name: str, group_col: str | None = None, salt=(), bucket_bits: int = 20) -> DataFrame:
    """0-based position in md5(seed|salt|id) order (ties by id), per ``group_col`` if given.

    The hash is uniform, so no sampling or checkpoint is needed: the first
    ``bucket_bits`` bits pick a bucket, a per-bucket count (partial aggregation,
    at most groups x 2^bits rows) gives every bucket its starting offset, and
    rows are ranked only inside their bucket (about n / 2^bits rows per window).
    Deterministic for any partitioning and on recomputation.
    """
    keyed = df.withColumn("_h", seeded_bits(seed, *salt, id_col)).withColumn(
        "_b", F.shiftrightunsigned(F.col("_h"), 32 - bucket_bits)
    )
    gkeys = [group_col] if group_col else []
    hist = keyed.groupBy(*gkeys, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    upto = (Window.partitionBy(*gkeys) if gkeys else Window.partitionBy()).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hist.withColumn("_off", F.coalesce(F.sum("_cnt").over(upto), F.lit(0))).drop("_cnt")
    in_bucket = Window.partitionBy(*gkeys, "_b").orderBy("_h", id_col)
    ranked = keyed.withColumn("_r", F.row_number().over(in_bucket))
    return (
        ranked.join(offsets, gkeys + ["_b"])
        .withColumn(name, (F.col("_off") + F.col("_r") - 1).cast("long"))
        .drop("_h", "_b", "_r", "_off")
    )


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = 42, name: str = "shuffle_index") -> DataFrame:
    """O1: a full, reproducible shuffle with a fresh 0-based index.

    The order is md5(seed|id), so it is the same for any partitioning and on
    recomputation (``rand()`` would not be).
    """
    return hash_order_index(df, seed, id_col, name)


def epoch_shuffle(df: DataFrame, id_col: str, epochs: int, seed: int = 42, name: str = "shuffle_index") -> DataFrame:
    """O2: a new seeded order per epoch (md5(seed|epoch|id)); one row per (epoch, input row)."""
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    return hash_order_index(rows, seed, id_col, name, group_col="epoch", salt=("epoch",))


def batch_assign(df: DataFrame, order: list, batch_size: int, name: str = "batch_id", position: str = "position") -> DataFrame:
    """Position in ``order`` (0-based) and batch = position // batch_size."""
    indexed = with_row_index(df, order, position)
    return indexed.withColumn(name, F.floor(F.col(position) / F.lit(batch_size)).cast("long"))


class PrefixScans:
    """Running values per group over one partitioning, safe when one group holds most rows.

    Rows are range-partitioned on (group, order) and checkpointed once, so a huge
    group is spread over many partitions, and any number of scans can follow.  Each
    (partition, group) piece is scanned locally; the pieces' totals (one row per
    piece: at most partitions + groups rows) are scanned per group to give each
    piece its carry-in.  No window ever holds more than one partition's rows.
    """

    _FNS = {"min": F.min, "max": F.max, "sum": F.sum}

    def __init__(self, df: DataFrame, group_col: str, order: list, num_partitions: int | None = None):
        self.group_col, self.order = group_col, list(order)
        keys = [F.col(group_col), *self.order]
        # AQE may merge adjacent range partitions at run time; order is preserved.
        ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
        self.table = cut_lineage(ranged.sortWithinPartitions(*keys).withColumn("_pid", F.spark_partition_id()))

    def scan(self, rows: DataFrame, specs: list) -> DataFrame:
        """``rows`` (``table`` or what was derived from it, ``_pid`` kept) with a column per spec
        ``(out, value_col, fn, inclusive)``: fn is min|max|sum and ``inclusive=False`` means
        "rows strictly before this one"."""
        piece = Window.partitionBy("_pid", self.group_col).orderBy(*self.order)
        local = rows
        for out, val, fn, incl in specs:
            frame = piece.rowsBetween(Window.unboundedPreceding, 0 if incl else -1)
            local = local.withColumn(f"_l_{out}", self._FNS[fn](val).over(frame))
        seg = rows.groupBy("_pid", self.group_col).agg(*[self._FNS[fn](val).alias(f"_s_{out}") for out, val, fn, _ in specs])
        before = Window.partitionBy(self.group_col).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        carry = seg.select(
            F.col("_pid").alias("_cpid"),
            F.col(self.group_col).alias("_cgrp"),
            *[self._FNS[fn](f"_s_{out}").over(before).alias(f"_c_{out}") for out, _, fn, _ in specs],
        )
        joined = local.join(carry, (local["_pid"] == carry["_cpid"]) & local[self.group_col].eqNullSafe(carry["_cgrp"]), "inner")
        for out, _, fn, _ in specs:
            c, lo = F.col(f"_c_{out}"), F.col(f"_l_{out}")
            if fn == "min":
                v = F.least(c, lo)
            elif fn == "max":
                v = F.greatest(c, lo)
            else:
                v = F.when(c.isNull() & lo.isNull(), F.lit(None)).otherwise(F.coalesce(c, F.lit(0)) + F.coalesce(lo, F.lit(0)))
            joined = joined.withColumn(out, v)
        return joined.drop("_cpid", "_cgrp", *[f"_{x}_{spec[0]}" for spec in specs for x in ("l", "c")])


def running_aggregate(df: DataFrame, group_col: str, order: list, specs: list, num_partitions: int | None = None) -> DataFrame:
    """One scan of ``PrefixScans``: ``df`` with running min / max / sum columns per group."""
    scans = PrefixScans(df, group_col, order, num_partitions)
    return scans.scan(scans.table, specs).drop("_pid")


def shuffled_batches(df: DataFrame, id_col: str, batch_size: int, epoch: int = 1, seed: int = 42, name: str = "batch_id") -> DataFrame:
    """W7 over a per-epoch seeded shuffle (a shuffled data loader): position in
    md5(seed|epoch|id) order, batch = position // batch_size.  Uses the hash-bucket
    index, so no sampling or checkpoint; the same batches for any partitioning."""
    keyed = df.withColumn("_epoch", F.lit(epoch))
    out = hash_order_index(keyed, seed, id_col, "position", salt=("_epoch",))
    return out.withColumn(name, F.floor(F.col("position") / F.lit(batch_size)).cast("long")).drop("_epoch")


def epoch_positions(df: DataFrame, order: list, epochs, seed: int = 42, batch_size: int | None = None, name: str = "position") -> DataFrame:
    """O2 / W7 in closed form: ``df`` with one column ``{name}_{epoch}`` per epoch, the row's place in that epoch's shuffle
    (and ``batch_{epoch}``).

    The rows are numbered once in ``order`` (a unique key); every epoch's shuffle is a keyed permutation
    of those numbers (``functions.permute``), so an epoch costs a projection: no sort, no exchange, no copy
    of the rows. The same for any partitioning.
    """
    from ledeframe.functions.permute import permuted

    indexed = with_row_index(df, order, "_index")
    n = indexed.count()
    for epoch in epochs:
        indexed = indexed.withColumn(f"{name}_{epoch}", permuted(F.col("_index"), n, seed, F.lit(epoch)))
        if batch_size:
            indexed = indexed.withColumn(f"batch_{epoch}", F.floor(F.col(f"{name}_{epoch}") / F.lit(batch_size)).cast("long"))
    return indexed.drop("_index")
