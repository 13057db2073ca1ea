"""Registered queries: vocabulary and fixed-length encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledeframe.functions import sequence as SQ
from ledeframe.functions.text import clean_alnum
from ledeframe.operators import hygiene as H
from ledeframe.operators import vocab as V
from ledeframe.plans import fixtures as X
from ledeframe.plans.catalog import (
    HEADLINES_SQL,
    arr_text,
    i64,
    register,
    sql_clean_alnum,
    sql_encode,
    sql_stratified,
    sql_vocab,
)

DOCS_SQL = "SELECT doc_id, text FROM documents"


def _docs(spark, sf_dir):
    return X.corpus(spark, sf_dir).select("doc_id", "text")


def _encoded_docs(spark, sf_dir, max_words):
    docs = _docs(spark, sf_dir)
    return V.token_to_id(docs, V.vocab_top_n(docs, max_words, "text"), max_words, "text")


def sql_pad(expr: str, n) -> str:
    return f"(({expr}) || list_transform(range({n}), lambda x: 0))[1:{n}]"


def sql_mask(expr: str, n: int) -> str:
    return f"list_transform(range({n}), lambda j: CASE WHEN j < least(len({expr}), {n}) THEN 1 ELSE 0 END)"


@register(
    "vocab_fit",
    f"WITH {sql_vocab(DOCS_SQL, 'text')} SELECT word, n, df, CAST(id AS BIGINT) AS id FROM vocab",
)
def q_vocab_fit(spark, sf_dir):
    v = V.vocab_fit(_docs(spark, sf_dir), "text")
    return v.select("word", i64("n").alias("n"), i64("df").alias("df"), i64("id").alias("id"))


@register(
    "vocab_rank",
    f"WITH {sql_vocab(DOCS_SQL, sql_clean_alnum('text'))} SELECT word, CAST(id AS BIGINT) AS id FROM vocab",
)
def q_vocab_rank(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("clean", clean_alnum("text"))
    return V.vocab_fit(docs, "clean").select("word", i64("id").alias("id"))


@register(
    "vocab_top_n",
    f"WITH {sql_vocab(DOCS_SQL, 'text')} SELECT word, n, CAST(id AS BIGINT) AS id FROM vocab WHERE id < 2000",
)
def q_vocab_top_n(spark, sf_dir):
    v = V.vocab_top_n(_docs(spark, sf_dir), 2000, "text")
    return v.select("word", i64("n").alias("n"), i64("id").alias("id"))


@register(
    "token_to_id",
    f"WITH {sql_vocab(DOCS_SQL, 'text')}, {sql_encode(2000)} SELECT doc AS doc_id, array_to_string(ids, ',') AS ids FROM enc",
)
def q_token_to_id(spark, sf_dir):
    return _encoded_docs(spark, sf_dir, 2000).select("doc_id", arr_text("ids").alias("ids"))


@register(
    "longest_sequence",
    f"WITH {sql_vocab(DOCS_SQL, 'text')}, {sql_encode(8000)} SELECT CAST(least(max(len(ids)), 128) AS BIGINT) AS pad_len FROM enc",
)
def q_longest_sequence(spark, sf_dir):
    return V.longest_sequence(_encoded_docs(spark, sf_dir, 8000), "ids", 128).select(i64("pad_len").alias("pad_len"))


@register(
    "truncate_sequence",
    f"WITH {sql_vocab(DOCS_SQL, 'text')}, {sql_encode(8000)} SELECT doc AS doc_id, array_to_string(ids[1:120], ',') AS ids FROM enc",
)
def q_truncate_sequence(spark, sf_dir):
    enc = _encoded_docs(spark, sf_dir, 8000)
    return enc.select("doc_id", arr_text(SQ.truncate_sequence("ids", 120)).alias("ids"))


@register(
    "pad_sequence",
    f"WITH {sql_vocab(DOCS_SQL, 'text')}, {sql_encode(2000)} SELECT doc AS doc_id, array_to_string({sql_pad('ids', 30)}, ',') AS ids FROM enc",
)
def q_pad_sequence(spark, sf_dir):
    enc = _encoded_docs(spark, sf_dir, 2000)
    return enc.select("doc_id", arr_text(SQ.pad_sequence("ids", 30)).alias("ids"))


@register(
    "pad_to_longest",
    f"""WITH {sql_vocab(HEADLINES_SQL, 'title')}, {sql_encode(8000)},
    {sql_stratified(HEADLINES_SQL, 'label', 'doc_id')},
    _e AS (SELECT enc.doc, enc.ids, sr.split FROM enc JOIN split_rows sr ON enc.doc = sr.doc_id),
    _L AS (SELECT split, least(max(len(ids)), 128) AS n FROM _e GROUP BY split)
    SELECT _e.doc AS doc_id, _e.split, CAST(_L.n AS BIGINT) AS pad_len,
           array_to_string((_e.ids || list_transform(range(_L.n), lambda x: 0))[1:_L.n], ',') AS ids
    FROM _e JOIN _L ON _e.split = _L.split""",
)
def q_pad_to_longest(spark, sf_dir):
    """F8 + A14 per split: each split padded to its own longest encoding (cap 128)."""
    from ledeframe.operators.split import stratified_split

    h = X.headlines(spark, sf_dir)
    enc = V.token_to_id(h, V.vocab_top_n(h, 8000, "title", "doc_id"), 8000, "title", "doc_id")
    sp = stratified_split(enc.select("doc_id", "label", "ids"), "label", "doc_id", 0.2, 42, materialize=True)
    padded = V.pad_to_longest(sp, "ids", 128, group_cols=["split"], out="padded")
    return padded.select("doc_id", "split", i64("pad_len").alias("pad_len"), arr_text("padded").alias("ids"))


@register(
    "attention_mask",
    f"WITH {sql_vocab(DOCS_SQL, 'text')}, {sql_encode(2000)} SELECT doc AS doc_id, array_to_string({sql_mask('ids', 64)}, ',') AS mask FROM enc",
)
def q_attention_mask(spark, sf_dir):
    enc = _encoded_docs(spark, sf_dir, 2000)
    return enc.select("doc_id", arr_text(SQ.attention_mask("ids", 64)).alias("mask"))


@register(
    "frame_sequence",
    f"""WITH {sql_vocab(DOCS_SQL, 'text')}, {sql_encode(2000)}
    SELECT doc AS doc_id, array_to_string({sql_pad('list_concat([2000], ids[1:62], [2001])', 64)}, ',') AS ids,
           array_to_string({sql_mask('list_concat([2000], ids[1:62], [2001])', 64)}, ',') AS mask FROM enc""",
)
def q_frame_sequence(spark, sf_dir):
    enc = _encoded_docs(spark, sf_dir, 2000)
    framed = SQ.frame_sequence("ids", 64, cls_id=2000, sep_id=2001)
    mask = SQ.attention_mask(F.concat(F.array(F.lit(2000)), F.slice("ids", 1, 62), F.array(F.lit(2001))), 64)
    return enc.select("doc_id", arr_text(framed).alias("ids"), arr_text(mask).alias("mask"))


@register(
    "prune_columns",
    f"""WITH {sql_vocab(HEADLINES_SQL, 'title')}, {sql_encode(2000)}
    SELECT array_to_string({sql_pad('enc.ids', 48)}, ',') AS ids, array_to_string({sql_mask('enc.ids', 48)}, ',') AS mask,
           CAST(_src.label AS BIGINT) AS label
    FROM enc JOIN _src ON enc.doc = _src.doc_id""",
)
def q_prune_columns(spark, sf_dir):
    h = X.headlines(spark, sf_dir)
    enc = V.token_to_id(h, V.vocab_top_n(h, 2000, "title", "doc_id"), 2000, "title", "doc_id")
    model_in = enc.select(
        "doc_id", "title", "category",
        SQ.pad_sequence("ids", 48).alias("ids"), SQ.attention_mask("ids", 48).alias("mask"), "label",
    )
    pruned = H.prune_columns(model_in, ["ids", "mask", "label"])
    return pruned.select(arr_text("ids").alias("ids"), arr_text("mask").alias("mask"), i64("label").alias("label"))
