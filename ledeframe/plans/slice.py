"""The flagship query (sequence-model data path, short form).

headlines -> clean (F2) -> vocabulary top-n (A2/O3) -> ids (J4) -> pad (F7)
-> stratified split (W9) -> per split and class: rows and known-token shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledeframe.functions.sequence import pad_sequence
from ledeframe.functions.text import clean_alnum
from ledeframe.operators.split import stratified_split
from ledeframe.operators.vocab import token_to_id, vocab_top_n
from ledeframe.plans import fixtures
from ledeframe.plans.catalog import HEADLINES_SQL, i64, r6, register, sql_clean_alnum, sql_encode, sql_stratified, sql_vocab


def encoded_headlines(spark: SparkSession, sf_dir: str, max_words: int = 2000, max_len: int = 30) -> DataFrame:
    h = fixtures.headlines(spark, sf_dir).withColumn("clean", clean_alnum("title"))
    vocab = vocab_top_n(h, max_words, "clean", "doc_id")
    enc = token_to_id(h, vocab, max_words, "clean", "doc_id", "ids")
    return enc.select("doc_id", "label", "ids", pad_sequence("ids", max_len).alias("padded"))


def split_then_encode(df: DataFrame, text_col: str, max_words: int, fit_on: str = "train", val_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Q6: stratified split, vocabulary of the train rows (``fit_on='train'``) or of all (``'all'``), ids of every row."""
    if fit_on not in ("train", "all"):
        raise ValueError(f"fit_on: {fit_on}")
    sp = stratified_split(df, "label", "doc_id", val_share, seed, materialize=True)
    seen = sp.filter(F.col("split") == "train") if fit_on == "train" else sp
    return token_to_id(sp, vocab_top_n(seen, max_words, text_col, "doc_id"), max_words, text_col, "doc_id")


def encode_split_summary(spark: SparkSession, sf_dir: str, max_words: int = 2000, max_len: int = 30, seed: int = 42, val_share: float = 0.2) -> DataFrame:
    enc = encoded_headlines(spark, sf_dir, max_words, max_len)
    sp = stratified_split(enc, "label", "doc_id", val_share, seed, materialize=True)  # encoding is costly to recompute
    known = F.try_divide(F.size(F.filter("ids", lambda x: x >= 2)).cast("double"), F.size("ids").cast("double"))
    return sp.groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(known).alias("mean_known_share"),
        F.avg(F.size(F.filter("padded", lambda x: x >= 2))).alias("mean_known_in_window"),
    ).select("split", i64("label").alias("label"), "n_rows", r6("mean_known_share").alias("mean_known_share"), r6("mean_known_in_window").alias("mean_known_in_window"))


ENCODE_SPLIT_SUMMARY_SQL = f"""
WITH {sql_vocab(HEADLINES_SQL, sql_clean_alnum('title'))},
{sql_encode(2000)},
_e AS (SELECT _src.doc_id, _src.label, enc.ids,
              (enc.ids || list_transform(range(30), lambda x: 0))[1:30] AS padded
       FROM _src JOIN enc ON _src.doc_id = enc.doc),
{sql_stratified('SELECT * FROM _e', 'label', 'doc_id')}
SELECT split, CAST(label AS BIGINT) AS label, count(*) AS n_rows,
       round(avg(len(list_filter(ids, lambda x: x >= 2))::DOUBLE / nullif(len(ids), 0)::DOUBLE), 6) AS mean_known_share,
       round(avg(len(list_filter(padded, lambda x: x >= 2))::DOUBLE), 6) AS mean_known_in_window
FROM split_rows GROUP BY split, label
"""

register("encode_split_summary", ENCODE_SPLIT_SUMMARY_SQL)(encode_split_summary)
