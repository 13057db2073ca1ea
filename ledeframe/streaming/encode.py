"""Encode arriving headlines with an already-fitted vocabulary, micro-batch by micro-batch.

The reference has no stream; this only runs the batch operators (clean, ids,
pad, mask) on each micro-batch through ``foreachBatch``.  Each batch overwrites
its own ``batch_id`` partition, so a replayed batch leaves one copy (the
checkpointed offsets make the replay exact).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledeframe.functions.sequence import attention_mask, pad_sequence
from ledeframe.functions.text import clean_alnum
from ledeframe.operators.vocab import token_to_id
from ledeframe.session import cut_lineage, scratch_path


def encode_stream(
    spark: SparkSession,
    source: str,
    schema: str,
    vocab: DataFrame,
    max_words: int,
    max_len: int,
    out_path: str,
    text_col: str = "text",
    id_col: str = "doc_id",
    checkpoint_location: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the stream; the vocabulary is frozen once (at most ``max_words`` rows)."""
    frozen = cut_lineage(vocab.filter(F.col("id") < max_words).select("word", "id"))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        cleaned = batch.withColumn("_clean", clean_alnum(text_col))
        enc = token_to_id(cleaned, frozen, max_words, "_clean", id_col)
        out = enc.select(
            id_col,
            pad_sequence("ids", max_len).alias("ids"),
            attention_mask("ids", max_len).alias("mask"),
            F.lit(batch_id).cast("long").alias("batch_id"),
        )
        (
            out.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(out_path)
        )

    writer = (
        spark.readStream.schema(schema)
        .parquet(source)
        .writeStream.foreachBatch(per_batch)
        .option("checkpointLocation", checkpoint_location or scratch_path(spark, "encode-stream"))
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
