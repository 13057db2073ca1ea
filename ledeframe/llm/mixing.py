"""Mixing sources to target weights by weighted fair queueing.

Every source puts its documents in a seeded shuffled order, up to three times over.
A copy's virtual finish time is its source's words up to its end divided by the
source's target, so all sources advance at the pace of their targets. The mix is
the start of all copies in order of finish time, cut where the words reach the
total budget.

Both orders are prefix scans over range partitions, so a source that holds a third
of the documents is spread over many tasks; only slim rows (no texts) move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledeframe.llm.common import cut_lineage, unused, word_count
from ledeframe.operators.order import running_aggregate, with_row_index

MOST_COPIES = 3


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, target) from rows of (source, size).

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the sum of
    all sizes; a target stops at three times its source's size and the excess goes to
    the others by weight until none is above. Each round caps every source that is
    above, from two sums; the driver sees only those.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = with_row_index(totals, [F.col("source").isNull(), F.col("source")], "rank")
    ranked = cut_lineage(ranked.withColumn("weight", (F.col("rank") % 3 + 1).cast("long")).drop("rank"))
    budget = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    cap, level, capped = F.col("source_size") * MOST_COPIES, 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > cap if capped >= 0 else F.lit(False)
        row = ranked.agg(
            F.count_if(above).alias("n"),
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        if row["n"] == capped or not row["open"]:
            break
        capped, level = row["n"], float(budget - row["held"]) / float(row["open"])
    return ranked.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest (of the text), size, source_size, target, copies, taken.

    size is the number of words (null text: 0); taken is size times copies. Rows
    without words are never taken. The order depends on id, size and source alone, so
    reruns agree; repeated rows follow each other and are taken as often as they fit.
    Null ids and null sources are values like others (a null source comes last). No
    rows give no rows.
    """
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("digest"),
    )
    shuffled = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    slim = cut_lineage(slim.withColumn("_key", shuffled))
    goals = targets(slim)
    order = [F.col("_key"), F.col("doc_id"), F.col("size"), F.col("digest")]
    placed = running_aggregate(slim, "source", order, [("upto", "size", "sum", True)])
    goal = goals.withColumnRenamed("source", "_source")
    timed = placed.join(goal, placed["source"].eqNullSafe(goal["_source"])).drop("_source")
    copy = lambda c: F.when(F.col("size") > 0, (c * F.col("source_size") + F.col("upto")).cast("double") / F.col("target"))
    timed = cut_lineage(timed.withColumn("_ends", F.array(*[copy(F.lit(c)) for c in range(MOST_COPIES)])))

    line = timed.where("size > 0").select("size", "_key", "doc_id", "source", F.posexplode("_ends").alias("c", "end"))
    tie = ["end", "_key", "doc_id", "source", "c"]
    queue = running_aggregate(line.withColumn("_all", F.lit(0)), "_all", [F.col(c) for c in tie], [("words", "size", "sum", True)])
    budget = slim.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # Nulls sort first in structs as in the queue's order.
    last = queue.where(F.col("words") <= budget).agg(F.max(F.struct(*tie)).alias("last"))

    def taken(c):
        here = F.struct(F.get("_ends", F.lit(c)).alias("end"), "_key", "doc_id", "source", F.lit(c).alias("c"))
        return F.when((F.col("size") > 0) & F.col("last").isNotNull() & (here <= F.col("last")), 1).otherwise(0)

    out = timed.join(F.broadcast(last), F.lit(True), "left")  # one row: where the mix ends
    out = out.withColumn("copies", sum((taken(c) for c in range(1, MOST_COPIES)), taken(0)))
    return out.select("doc_id", "digest", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, all columns unchanged
    (rows repeated with the same id and text are written from one of them)."""
    id_, other, digest, times, copy = (unused(docs, c) for c in ("mix_id", "mix_other", "mix_digest", "mix_copies", "mix_copy"))
    plan = mix(docs, id_col, text_col, source_col, seed).where("copies > 0")
    plan = plan.groupBy(F.col("doc_id").alias(id_), F.col("digest").alias(other)).agg(F.sum("copies").cast("int").alias(times))
    rows = docs.withColumn(digest, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    hit = rows.join(plan, rows[id_col].eqNullSafe(plan[id_]) & (rows[digest] == plan[other])).dropDuplicates([id_col, digest])
    return hit.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[hit[c] for c in docs.columns])
