"""Vocabulary and id sequences.

Ids follow the Keras tokenizer contract: 0 = padding, 1 = out-of-vocabulary,
real words from 2 by count descending, ties by first appearance (document id,
then position).  Ids >= ``max_words`` are mapped to 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledeframe.functions.text import tokenizer_words
from ledeframe.operators.order import with_row_index
from ledeframe.session import cut_lineage

PAD_ID = 0
OOV_ID = 1
FIRST_WORD_ID = 2
ROWS = 4096  # documents per task where their words are exploded


def _tokens(df: DataFrame, text_col: str, tokens) -> Column:
    return tokens(text_col) if callable(tokens) else F.col(tokens)


def by_document(df: DataFrame, id_col: str, num_partitions: int | None = None) -> DataFrame:
    """Hash-partition rows by document id."""
    # Without an explicit count AQE may coalesce the partitions at run time (never
    # below the cluster's parallelism), and still keeps rows clustered by id.
    if num_partitions:
        return df.repartition(num_partitions, F.col(id_col))
    return df.repartition(F.col(id_col))


def partitions_for(df: DataFrame, id_col: str) -> int | None:
    """A partition for every ``ROWS`` rows, so a task's words do not grow with the table; None, which leaves the
    number to Spark, while that is no more than its parallelism. Counting reads ids alone."""
    n = -(-df.select(id_col).count() // ROWS)
    return n if n > df.sparkSession.sparkContext.defaultParallelism else None


def word_counts(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", tokens=tokenizer_words) -> DataFrame:
    """Per word: occurrences ``n``, documents ``df`` and first appearance ``(first_doc, first_pos)``.

    Rows are clustered by document, ``ROWS`` of them to a partition, so the (word, document) aggregation runs
    inside each partition with no exchange and its hash map does not grow with the table; the word-level aggregation is
    partial before its shuffle, so a very frequent word costs one row per map
    task, not one per occurrence.
    """
    keyed = by_document(df, id_col, partitions_for(df, id_col))
    exploded = keyed.select(
        F.col(id_col).alias("_doc"), F.posexplode(_tokens(keyed, text_col, tokens)).alias("_pos", "word")
    )
    per_doc = exploded.groupBy("word", "_doc").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_p"))
    return per_doc.groupBy("word").agg(
        F.sum("_n").alias("n"),
        F.count(F.lit(1)).alias("df"),
        F.min("_doc").alias("first_doc"),
        F.min_by("_p", "_doc").alias("first_pos"),
    )


def _rank_order() -> list[Column]:
    return [F.col("n").desc(), F.col("first_doc").asc(), F.col("first_pos").asc()]


def vocab_fit(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", tokens=tokenizer_words) -> DataFrame:
    """A2 + W12: the full vocabulary ``(word, n, df, id)``, ranked without a one-task window."""
    counts = word_counts(df, text_col, id_col, tokens)
    ranked = with_row_index(counts, _rank_order(), "_r")
    return ranked.select("word", "n", "df", (F.col("_r") + FIRST_WORD_ID).cast("int").alias("id"))


def vocab_top_n(df: DataFrame, max_words: int, text_col: str = "text", id_col: str = "doc_id", tokens=tokenizer_words, freeze: bool = True) -> DataFrame:
    """O3: only the words that get an id below ``max_words`` (``max_words - 2`` words).

    ``orderBy().limit(k)`` is a distributed top-k (each task keeps k rows), so
    the ranking window afterwards sees at most k rows.  The fitted vocabulary
    (at most k rows) is materialised once (``freeze``) so that every consumer
    (encoding, embedding matrix) reads the same small table instead of
    recomputing the corpus aggregation.
    """
    k = max(max_words - FIRST_WORD_ID, 0)
    top = word_counts(df, text_col, id_col, tokens).orderBy(*_rank_order()).limit(k)
    w = Window.orderBy(*_rank_order())  # over <= k rows only
    fitted = top.select("word", "n", "df", (F.row_number().over(w) + FIRST_WORD_ID - 1).cast("int").alias("id"))
    return cut_lineage(fitted) if freeze else fitted


def token_to_id(
    df: DataFrame,
    vocab: DataFrame,
    max_words: int,
    text_col: str = "text",
    id_col: str = "doc_id",
    out: str = "ids",
    tokens=tokenizer_words,
    num_partitions: int | None = None,
    max_len: int | None = None,
) -> DataFrame:
    """Word -> id; unknown words and ids >= ``max_words`` -> 1; only the first ``max_len``
    tokens if it is given (cut before anything is exploded).

    Plan: a row's tokens are exploded once, inside the partitions of one shuffle, and looked up
    with a broadcast hash join against the cut vocabulary (at most ``max_words - 2`` rows by
    construction, so the broadcast is bounded by a parameter, not by the data).  The
    ids are regrouped in position order by (id, tokens' hash) in the same partitions; the row's own
    columns ride on its first token, so the text is shuffled and tokenised once. Rows that
    repeat an id keep their own sequences.
    """
    cut = vocab.filter(F.col("id") < max_words).select("word", F.col("id").alias("_id"))
    words = _tokens(df, text_col, tokens)
    rows = df.select(F.struct(*df.columns).alias("_row"), (F.slice(words, 1, max_len) if max_len is not None else words).alias("_tokens"))
    keys = ["_doc", "_text"]
    keyed = rows.select(F.col(f"_row.{id_col}").alias("_doc"), F.xxhash64("_tokens").alias("_text"), "_row", "_tokens")
    num_partitions = num_partitions or partitions_for(df, id_col)
    keyed = keyed.repartition(num_partitions, *keys) if num_partitions else keyed.repartition(*keys)
    exploded = keyed.select(*keys, "_row", F.posexplode_outer("_tokens").alias("_pos", "word"))
    first = F.col("_pos").isNull() | (F.col("_pos") == 0)
    exploded = exploded.select(*keys, "_pos", "word", F.when(first, F.col("_row")).alias("_row"))
    looked = exploded.join(F.broadcast(cut), "word", "left")
    place = F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("_id", F.lit(OOV_ID)).alias("id")))
    # A set of places: rows with one id and the same tokens share their sequence; each of them is a row again.
    seqs = looked.groupBy(*keys).agg(F.sort_array(F.collect_set(place))["id"].alias("_ids"), F.collect_list("_row").alias("_rows"))
    out_rows = seqs.select("_ids", F.explode("_rows").alias("_row"))
    return out_rows.select("_row.*", F.col("_ids").alias(out))


def longest_sequence(df: DataFrame, ids_col: str = "ids", cap: int = 128, group_cols=()) -> DataFrame:
    """Longest encoding, capped, as ``pad_len`` (one row, or one per group,
    e.g. per split: the reference pads train and validation separately)."""
    return df.groupBy(*group_cols).agg(F.least(F.max(F.size(ids_col)), F.lit(cap)).cast("int").alias("pad_len"))


def pad_to_longest(df: DataFrame, ids_col: str = "ids", cap: int = 128, group_cols=(), out: str | None = None) -> DataFrame:
    """F8: pad every sequence to the longest of its group (capped) instead of a constant.

    The per-group lengths are one row per group, joined back."""
    from ledeframe.functions.sequence import pad_sequence

    lens = longest_sequence(df, ids_col, cap, group_cols)
    if group_cols:
        j = df.join(lens, list(group_cols))
    else:
        j = df.withColumn("pad_len", lens.scalar())
    return j.withColumn(out or ids_col, pad_sequence(ids_col, "pad_len"))
