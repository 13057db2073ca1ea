"""The micro-batch encoder gives the same ids as the batch plan."""

import os

from pyspark.sql import functions as F

from ledeframe.functions.sequence import pad_sequence
from ledeframe.functions.text import clean_alnum
from ledeframe.operators import vocab as V
from ledeframe.streaming.encode import encode_stream

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark, tmp_dir):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    cleaned = docs.withColumn("c", clean_alnum("text"))
    vocab = V.vocab_top_n(cleaned, 2000, "c")
    out = os.path.join(tmp_dir, "encoded")
    q = encode_stream(
        spark, f"{SF}/docu*.parquet", "doc_id long, text string, lang string, source string, n_chars long",
        vocab, 2000, 30, out, checkpoint_location=os.path.join(tmp_dir, "ckpt"),
    )
    q.awaitTermination(300)
    got = {r.doc_id: list(r.ids) for r in spark.read.parquet(out).collect()}
    ref = V.token_to_id(cleaned, vocab, 2000, "c").select("doc_id", pad_sequence("ids", 30).alias("ids"))
    want = {r.doc_id: list(r.ids) for r in ref.collect()}
    assert got == want and len(got) == docs.count()
    assert spark.read.parquet(out).select(F.max(F.size("mask"))).first()[0] == 30
