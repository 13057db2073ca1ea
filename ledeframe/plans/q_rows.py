"""Registered queries: sources, sinks K1, row hygiene, text functions, labels."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ledeframe.functions import text as TX
from ledeframe.operators import hygiene as H
from ledeframe.operators import labels as L
from ledeframe.operators.metrics import error_text_lookup
from ledeframe.plans import fixtures as X
from ledeframe.plans.catalog import (
    HEADLINES_RAW_SQL,
    HEADLINES_SQL,
    i64,
    register,
    sql_clean_alnum,
    sql_keras_tokens,
)
from ledeframe.session import scratch_path, table
from ledeframe.sources import sinks as K
from ledeframe.sources import tables as S


def _write_headlines_csv(df, path, encoding="UTF-8"):
    (
        df.select("doc_id", "title", "category")
        .write.mode("overwrite")
        .options(header=True, quote='"', escape='"', encoding=encoding,
                 ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .csv(path)
    )
    return path


# --- sources ---------------------------------------------------------------


@register("csv_scan", f"SELECT doc_id, md5(title) AS title_md5, category FROM ({HEADLINES_SQL})")
def q_csv_scan(spark, sf_dir):
    path = _write_headlines_csv(X.headlines(spark, sf_dir), scratch_path(spark, "headlines-csv"))
    df = S.csv_scan(spark, path)
    return df.select("doc_id", F.md5("title").alias("title_md5"), "category")


@register("csv_scan_encoding", f"SELECT doc_id, md5(title) AS title_md5, category FROM ({HEADLINES_SQL})")
def q_csv_scan_encoding(spark, sf_dir):
    path = _write_headlines_csv(X.headlines(spark, sf_dir), scratch_path(spark, "headlines-latin1"), "ISO-8859-1")
    df = S.csv_scan_encoding(spark, path)
    return df.select("doc_id", F.md5("title").alias("title_md5"), "category")


@register("scan_first_file", "SELECT doc_id, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM labels")
def q_scan_first_file(spark, sf_dir):
    paths = [os.path.join(sf_dir, "labels.parquet"), os.path.join(sf_dir, "documents.parquet")]
    df = S.scan_first_file(spark, paths)
    return df.select("doc_id", i64("quality").alias("quality"), i64("toxic").alias("toxic"))


@register("columns_to_dataset", f"SELECT doc_id, category, CAST(label AS BIGINT) AS label FROM ({HEADLINES_SQL})")
def q_columns_to_dataset(spark, sf_dir):
    df = S.columns_to_dataset(spark, X.headlines(spark, sf_dir), ["doc_id", "category", "label"])
    return df.select("doc_id", "category", i64("label").alias("label"))


@register(
    "error_sink_csv",
    "SELECT md5(d.text) AS text_md5 FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.quality <> l.toxic",
)
def q_error_sink_csv(spark, sf_dir):
    errs = error_text_lookup(X.predictions(spark, sf_dir), X.corpus(spark, sf_dir).select("doc_id", "text"), "doc_id")
    path = K.error_sink_csv(errs, scratch_path(spark, "errors-csv"))
    back = S.csv_scan(spark, path, "text string", na_values=False)
    return back.select(F.md5("text").alias("text_md5"))


# --- projections and null rules ---------------------------------------------


@register("project_columns", f"SELECT md5(title) AS title_md5, category FROM ({HEADLINES_RAW_SQL})")
def q_project_columns(spark, sf_dir):
    df = H.project_columns(X.headlines_raw(spark, sf_dir), ["title", "category"])
    return df.select(F.md5("title").alias("title_md5"), "category")


@register("drop_null_subset", f"SELECT doc_id, category FROM ({HEADLINES_RAW_SQL}) WHERE title IS NOT NULL AND category IS NOT NULL")
def q_drop_null_subset(spark, sf_dir):
    return H.drop_null_subset(X.headlines_raw(spark, sf_dir), ["title", "category"]).select("doc_id", "category")


@register("drop_null_any", f"SELECT md5(title) AS title_md5, category FROM ({HEADLINES_RAW_SQL}) WHERE title IS NOT NULL AND category IS NOT NULL")
def q_drop_null_any(spark, sf_dir):
    df = H.drop_null_any(X.headlines_raw(spark, sf_dir), ["title", "category"])
    return df.select(F.md5("title").alias("title_md5"), "category")


@register("filter_domain", f"SELECT doc_id, category FROM ({HEADLINES_RAW_SQL}) WHERE category IN ('non-political', 'political')")
def q_filter_domain(spark, sf_dir):
    return H.filter_domain(X.headlines_raw(spark, sf_dir), "category", L.HEADLINE_LABELS).select("doc_id", "category")


@register(
    "filter_not_blank",
    f"SELECT doc_id FROM ({HEADLINES_RAW_SQL}) WHERE length(regexp_replace(title, '^\\s+|\\s+$', '', 'g')) > 0",
)
def q_filter_not_blank(spark, sf_dir):
    return H.filter_not_blank(X.headlines_raw(spark, sf_dir), "title").select("doc_id")


@register("null_as_text", f"SELECT doc_id, coalesce(CAST(category AS VARCHAR), 'nan') AS category FROM ({HEADLINES_RAW_SQL})")
def q_null_as_text(spark, sf_dir):
    return H.null_as_text(X.headlines_raw(spark, sf_dir), "category").select("doc_id", "category")


@register(
    "label_to_int",
    f"""SELECT doc_id, CAST(CAST(CASE category WHEN 'non-political' THEN '0' WHEN 'political' THEN '1' END AS INTEGER) AS BIGINT) AS label
        FROM ({HEADLINES_RAW_SQL})""",
)
def q_label_to_int(spark, sf_dir):
    raw = X.headlines_raw(spark, sf_dir)
    as_text = raw.withColumn("label_text", F.when(F.col("category") == "political", "1").when(F.col("category") == "non-political", "0"))
    return H.label_to_int(as_text, "label_text", "label").select("doc_id", i64("label").alias("label"))


# --- text functions ----------------------------------------------------------


@register(
    "strip_text",
    "SELECT doc_id, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text_md5, "
    "CAST(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS BIGINT) AS n_chars FROM documents",
)
def q_strip_text(spark, sf_dir):
    t = TX.strip_text("text")
    return X.corpus(spark, sf_dir).select("doc_id", F.md5(t).alias("text_md5"), i64(F.length(t)).alias("n_chars"))


@register(
    "clean_alnum",
    f"SELECT doc_id, md5({sql_clean_alnum('text')}) AS text_md5, CAST(length({sql_clean_alnum('text')}) AS BIGINT) AS n_chars FROM documents",
)
def q_clean_alnum(spark, sf_dir):
    t = TX.clean_alnum("text")
    return X.corpus(spark, sf_dir).select("doc_id", F.md5(t).alias("text_md5"), i64(F.length(t)).alias("n_chars"))


_CLEAN_HEADLINE_SQL = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'http\\S+', '', 'g'), "
    "'[^a-zA-Z0-9\\s.,!?]', '', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
)


_URL_TEXTS_SQL = """
SELECT 'doc' AS src, doc_id AS id, text FROM documents
UNION ALL SELECT 'page', page_id, 'Read ' || url || ' now, ok?' FROM pages
UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations
"""


def _url_texts(spark, sf_dir):
    """Texts with links: documents, page URLs inside a sentence, conversation turns."""
    docs = X.corpus(spark, sf_dir).select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"), "text")
    pages = table(spark, sf_dir, "pages").select(
        F.lit("page").alias("src"), F.col("page_id").alias("id"), F.concat(F.lit("Read "), F.col("url"), F.lit(" now, ok?")).alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.lit("turn").alias("src"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )
    return docs.unionByName(pages).unionByName(turns)


@register(
    "clean_headline",
    f"SELECT src, id, md5({_CLEAN_HEADLINE_SQL}) AS text_md5, CAST(length({_CLEAN_HEADLINE_SQL}) AS BIGINT) AS n_chars FROM ({_URL_TEXTS_SQL})",
)
def q_clean_headline(spark, sf_dir):
    t = TX.clean_headline("text")
    return _url_texts(spark, sf_dir).select("src", "id", F.md5(t).alias("text_md5"), i64(F.length(t)).alias("n_chars"))


@register(
    "tokenizer_normalize",
    f"SELECT doc_id, CAST(len({sql_keras_tokens('text')}) AS BIGINT) AS n_tokens, md5(array_to_string({sql_keras_tokens('text')}, ' ')) AS tokens_md5 FROM documents",
)
def q_tokenizer_normalize(spark, sf_dir):
    t = TX.tokenizer_words("text")
    return X.corpus(spark, sf_dir).select("doc_id", i64(F.size(t)).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


_SPLIT_SQL = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"


@register(
    "split_words",
    f"SELECT doc_id, CAST(len({_SPLIT_SQL}) AS BIGINT) AS n_words, md5(array_to_string({_SPLIT_SQL}, '|')) AS words_md5 FROM documents",
)
def q_split_words(spark, sf_dir):
    t = TX.split_words("text")
    return X.corpus(spark, sf_dir).select("doc_id", i64(F.size(t)).alias("n_words"), F.md5(F.array_join(t, "|")).alias("words_md5"))


@register("join_words", f"SELECT doc_id, md5(array_to_string({_SPLIT_SQL}, ' ')) AS text_md5 FROM documents")
def q_join_words(spark, sf_dir):
    t = TX.join_words(TX.split_words("text"))
    return X.corpus(spark, sf_dir).select("doc_id", F.md5(t).alias("text_md5"))


# --- labels --------------------------------------------------------------------


@register(
    "label_encode",
    "SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS BIGINT) AS label FROM documents WHERE lang IS NOT NULL",
)
def q_label_encode(spark, sf_dir):
    df = L.label_encode(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang")
    return df.select("doc_id", "lang", i64("label").alias("label"))


@register(
    "label_map",
    f"SELECT doc_id, CAST(CASE category WHEN 'non-political' THEN 0 WHEN 'political' THEN 1 END AS BIGINT) AS label FROM ({HEADLINES_RAW_SQL})",
)
def q_label_map(spark, sf_dir):
    return L.label_map(X.headlines_raw(spark, sf_dir), "category").select("doc_id", i64("label").alias("label"))


@register(
    "label_decode",
    "SELECT doc_id, CAST(quality AS BIGINT) AS y, CASE quality WHEN 0 THEN 'non-political' WHEN 1 THEN 'political' END AS y_name FROM labels",
)
def q_label_decode(spark, sf_dir):
    df = L.label_decode(X.predictions(spark, sf_dir), "y", out="y_name")
    return df.select("doc_id", i64("y").alias("y"), "y_name")


@register("class_cardinality", "SELECT count(DISTINCT lang) AS n_classes FROM documents")
def q_class_cardinality(spark, sf_dir):
    return L.class_cardinality(table(spark, sf_dir, "documents"), "lang")
