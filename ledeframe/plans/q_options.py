"""Registered queries: options that change an order of steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledeframe.functions.text import clean_alnum
from ledeframe.operators import hygiene as H
from ledeframe.operators import metrics as M
from ledeframe.operators import train as T
from ledeframe.plans import fixtures as X
from ledeframe.plans.catalog import HEADLINES_SQL, i64, r6, register, sql_clean_alnum, sql_keras_tokens, sql_stratified, sql_vocab
from ledeframe.plans.q_rows import _CLEAN_HEADLINE_SQL, _URL_TEXTS_SQL, _url_texts
from ledeframe.plans.q_train import T1_FULL, _final_eval_sql, headline_features
from ledeframe.plans.q_vectors import DIM, MAX_WORDS
from ledeframe.plans.slice import split_then_encode
from ledeframe.session import table

# --- Q2: report on the last epoch's weights -------------------------------------------


@register("final_evaluation_last", _final_eval_sql(T1_FULL, which="last"))
def q_final_evaluation_last(spark, sf_dir):
    """T9 at the last epoch that ran, as the reference's plots and error list have it."""
    feats = headline_features(spark, sf_dir)
    w, b = T.chosen_weights(T.train_epochs(feats, DIM, T1_FULL), which="last")
    val = T.batch_score(feats.filter(F.col("split") == "val"), w, b)
    rep = M.classification_report(val.select(F.col("y").cast("int").alias("y"), F.col("pred")))
    return rep.select("row", "row_order", i64("label").alias("label"), "precision", "recall", "f1", "support")


# --- Q6: vocabulary of the train rows alone -------------------------------------------


def _known_sql(fit_on: str) -> str:
    rows = "split_rows" if fit_on == "all" else "(SELECT * FROM split_rows WHERE split = 'train')"
    tokens = sql_keras_tokens(sql_clean_alnum("title"))
    return f"""WITH {sql_stratified(HEADLINES_SQL, 'label', 'doc_id')},
{sql_vocab(f"SELECT * FROM {rows}", sql_clean_alnum('title'))},
_k AS (SELECT split, label, doc_id, {tokens} AS ts FROM split_rows),
_m AS (SELECT doc_id, count(v.word)::DOUBLE / count(*) AS share, count(*) - count(v.word) AS unknown
       FROM (SELECT doc_id, unnest(ts) AS word FROM _k) t LEFT JOIN (SELECT word FROM vocab WHERE id < {MAX_WORDS}) v ON v.word = t.word GROUP BY doc_id)
SELECT split, CAST(label AS BIGINT) AS label, count(*) AS n_rows, round(avg(share), 6) AS mean_known_share, coalesce(sum(unknown), 0)::BIGINT AS unknown_tokens
FROM _k LEFT JOIN _m USING (doc_id) GROUP BY split, label"""


@register("vocab_fit_on_train", _known_sql("train"))
def q_vocab_fit_on_train(spark, sf_dir):
    """A2 / J4 with a vocabulary that has seen the train rows only: known words per split and class."""
    h = X.headlines(spark, sf_dir).withColumn("clean", clean_alnum("title"))
    enc = split_then_encode(h, "clean", MAX_WORDS, fit_on="train")
    known = F.size(F.filter("ids", lambda x: x >= 2))
    rows = enc.select("split", "label", F.try_divide(known.cast("double"), F.size("ids").cast("double")).alias("share"), (F.size("ids") - known).alias("unknown"))
    return rows.groupBy("split", i64("label").alias("label")).agg(
        F.count(F.lit(1)).alias("n_rows"), r6(F.avg("share")).alias("mean_known_share"), i64(F.sum("unknown")).alias("unknown_tokens")
    )


# --- Q8: blank titles, before and after cleaning ------------------------------------------

_WITH_URLS_SQL = f"{_URL_TEXTS_SQL} UNION ALL SELECT 'url', page_id, url FROM pages"


@register(
    "filter_not_blank_cleaned",
    f"""SELECT src, count(*) AS n_rows, count(*) FILTER (length(clean) = 0) AS emptied FROM (
        SELECT src, {_CLEAN_HEADLINE_SQL} AS clean FROM ({_WITH_URLS_SQL}) WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0) GROUP BY src""",
)
def q_filter_not_blank_cleaned(spark, sf_dir):
    """P5 then F3, then P5 again: rows per source, and those that only the second filter sees."""
    urls = table(spark, sf_dir, "pages").select(F.lit("url").alias("src"), F.col("page_id").alias("id"), F.col("url").alias("text"))
    raw = _url_texts(spark, sf_dir).unionByName(urls)
    first, second = (H.clean_titles(raw, "text", blank_after=again) for again in (False, True))
    counts = first.groupBy("src").agg(F.count(F.lit(1)).alias("n_rows"))
    left = second.groupBy("src").agg(F.count(F.lit(1)).alias("left"))
    return counts.join(left, "src", "left").select("src", "n_rows", (F.col("n_rows") - F.coalesce("left", F.lit(0))).alias("emptied"))
