"""CSV records from files that are read in splits, whatever stands between quotes.

A quoted field may hold line breaks, so a split that begins in the middle of a file does
not know whether its first line begins a record. Every line is a map from the state before
it (outside, or inside quotes) to the state behind it. Maps compose: the
last line of a split that ends in one state whatever came before, and the number of lines
that swap the states since, give the map of the split, and the maps of a file's splits in
order give the state in which each of them begins. Then every split cuts its lines into
records on its own, and only pieces of records that go on past the end of a split meet
across splits.

Lines are shuffled once, by split; the maps of the splits are a slim second scan. No
window holds more than the lines of one split, or one row per split of one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A character of these is one byte or begins with a byte of 0x80 and more, so lines can be found byte by byte.
LINEWISE = ("utf-8", "utf8", "us-ascii", "ascii", "iso-8859", "latin", "windows-125", "cp125")


def _inside_after(line: Column, delimiter: str, inside: bool) -> Column:
    """1 if a line ends inside quotes, else 0, given where it began. A quote opens a field only where one begins, is one
    of two that stand for a quote inside a quoted field, and is text in a field that began without one."""
    starts, within, closed, text = 3, 1, 2, 0  # before a record, inside, behind a quote inside, in or behind a field
    before_quotes = lambda: F.slice(F.split(line, '"'), 1, F.size(F.split(line, '"')) - 1)
    opens = lambda state, s: s.endswith(delimiter) | ((s == "") & state.isin(closed, starts))
    step = lambda state, s: F.when(state == within, closed).when(opens(state, s), within).otherwise(text)
    end = F.aggregate(before_quotes(), F.lit(within if inside else starts), step, lambda state: (state == within).cast("int"))
    return F.when(F.instr(line, '"') > 0, end).otherwise(int(inside))


def _lines(spark: SparkSession, path, encoding: str, delimiter: str) -> DataFrame:
    """(file, block, line, value, outer, inner): block is where the split begins, line grows within it; outer and inner are
    the states behind a line that begins outside and inside."""
    value = F.col("value") if encoding.lower() in ("utf-8", "utf8") else F.decode(F.col("value").cast("binary"), encoding)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        value.alias("value"),
    )
    return lines.select("*", _inside_after(F.col("value"), delimiter, False).alias("outer"), _inside_after(F.col("value"), delimiter, True).alias("inner"))


def _swap() -> Column:
    return ((F.col("outer") == 1) & (F.col("inner") == 0)).cast("int")


def _fixed(swaps: Column) -> Column:
    """For a line that ends in one state in any case: that state with all swaps up to it taken back."""
    return F.when(F.col("outer") == F.col("inner"), (F.col("outer") + swaps) % 2)


def _starts(lines: DataFrame) -> DataFrame:
    """(file, block, start): the state in which each split begins."""
    telling = lines.where("outer != 0 or inner != 1").select("file", "block", "line", "outer", "inner")
    upto = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    run = telling.select("*", F.sum(_swap()).over(upto).alias("swaps"))
    run = run.select("*", F.last(_fixed(F.col("swaps")), ignorenulls=True).over(upto).alias("fixed"))
    maps = run.groupBy("file", "block").agg(F.max_by(F.struct("swaps", "fixed"), "line").alias("m")).select("file", "block", "m.*")
    splits = lines.select("file", "block").distinct().join(maps, ["file", "block"], "left")
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parity = F.coalesce(F.col("swaps"), F.lit(0)) % 2
    run = splits.select("file", "block", parity.alias("swap"), ((F.col("fixed") + F.col("swaps")) % 2).alias("end"))
    run = run.select("*", F.sum("swap").over(upto).alias("upto"), F.coalesce(F.sum("swap").over(behind), F.lit(0)).alias("before"))
    # A split that ends in one state in any case fixes it; its own swaps are part of that.
    fixed = F.last(F.when(F.col("end").isNotNull(), (F.col("end") + F.col("upto")) % 2), ignorenulls=True).over(behind)
    return run.select("file", "block", ((F.coalesce(fixed, F.lit(0)) + F.col("before")) % 2).alias("start"))


def csv_records(spark: SparkSession, path, encoding: str = "UTF-8", delimiter: str = ",") -> DataFrame:
    """(file, first, record): the records of CSV files as text, blank lines left out; ``first`` marks the first of a file.

    Lines end at LF or CR LF; inside quotes both stay as they are. A quote that is never closed takes in the rest of the file.
    """
    if not encoding.lower().startswith(LINEWISE):
        raise ValueError(f"lines cannot be found byte by byte in {encoding}")
    lines = _lines(spark, path, encoding, delimiter)
    placed = lines.repartition("file", "block").join(_starts(lines), ["file", "block"])
    upto = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    run = placed.select("*", F.sum(_swap()).over(upto).alias("swaps"), F.coalesce(F.sum(_swap()).over(behind), F.lit(0)).alias("earlier"))
    run = run.select("*", F.last(_fixed(F.col("swaps")), ignorenulls=True).over(behind).alias("fixed"))
    before = (F.coalesce("fixed", "start") + F.col("earlier")) % 2
    run = run.select("file", "block", "line", "value", before.alias("before"), F.when(before == 0, F.col("outer")).otherwise(F.col("inner")).alias("after"))
    begins = (F.col("before") == 0) & ~F.col("value").isin("", "\r")
    run = run.select("*", F.sum(begins.cast("int")).over(upto).alias("n")).where(begins | (F.col("before") == 1))

    first = (F.col("block") == 0) & (F.col("n") == 1)
    whole = (F.col("before") == 0) & (F.col("after") == 0)
    single = run.where(whole).select("file", first.alias("first"), F.col("value").alias("record"))
    pieces = run.where(~whole).groupBy("file", "block", "n").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("line", "value")))["value"], "\n").alias("text"), F.max_by("after", "line").alias("open")
    )
    inside = pieces.where("n > 0 and open = 0").select("file", first.alias("first"), F.col("text").alias("record"))
    # A record that goes on: its begin, the splits it fills and the head of the one it ends in.
    along = Window.partitionBy("file").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, 0)
    parts = pieces.where("n = 0 or open = 1").select("*", first.alias("first"), F.sum((F.col("n") > 0).cast("int")).over(along).alias("g"))
    across = parts.groupBy("file", "g").agg(
        F.max("first").alias("first"), F.array_join(F.array_sort(F.collect_list(F.struct("block", "n", "text")))["text"], "\n").alias("record")
    )
    records = single.unionByName(inside).unionByName(across.select("file", "first", "record"))
    return records.withColumn("record", F.regexp_replace("record", "\r$", ""))
