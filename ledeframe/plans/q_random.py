"""Registered queries: seeded randomness, shuffles, batches, splits, augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledeframe.functions.rand import seeded_uniform
from ledeframe.functions.text import split_words
from ledeframe.operators import augment as AU
from ledeframe.operators import order as O
from ledeframe.operators import split as SP
from ledeframe.plans import fixtures as X
from ledeframe.plans.catalog import (
    HEADLINES_SQL,
    i64,
    r6,
    register,
    sql_bits,
    sql_stratified,
    sql_uniform,
)
from ledeframe.session import table


@register("seeded_uniform", f"SELECT doc_id, round({sql_uniform(42, 'doc_id')}, 6) AS u FROM documents")
def q_seeded_uniform(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", r6(seeded_uniform(42, "doc_id")).alias("u"))


@register(
    "seeded_shuffle",
    f"SELECT doc_id, CAST(row_number() OVER (ORDER BY {sql_bits(42, 'doc_id')}, doc_id) - 1 AS BIGINT) AS shuffle_index FROM documents",
)
def q_seeded_shuffle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return O.seeded_shuffle(docs, "doc_id", 42).select("doc_id", i64("shuffle_index").alias("shuffle_index"))


@register(
    "epoch_shuffle",
    f"""SELECT CAST(e.epoch AS BIGINT) AS epoch, l.doc_id,
           CAST(row_number() OVER (PARTITION BY e.epoch ORDER BY {sql_bits(42, 'e.epoch', 'l.doc_id')}, l.doc_id) - 1 AS BIGINT) AS shuffle_index
        FROM labels l, (SELECT range AS epoch FROM range(1, 4)) e""",
)
def q_epoch_shuffle(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id")
    out = O.epoch_shuffle(rows, "doc_id", epochs=3, seed=42)
    return out.select(i64("epoch").alias("epoch"), "doc_id", i64("shuffle_index").alias("shuffle_index"))


def _sql_half(k: int, a: str, b: str) -> str:
    moved, by, size = ("r", "c", a) if k % 2 else ("c", "r", b)
    bits = f"(('0x' || substr(md5('42|' || e || '|{k}|' || {by}{k - 1}), 1, 8))::BIGINT)"
    return f"({moved}{k - 1} + {bits}) % {size} AS {moved}{k}, {by}{k - 1} AS {by}{k}"


@register(
    "epoch_permutation",
    f"""WITH RECURSIVE _n AS (SELECT count(*) AS n, CASE WHEN count(*) < 2 THEN 1 ELSE ceil(sqrt(count(*)))::BIGINT END AS a FROM labels),
_g AS (SELECT n, a, greatest(1, CAST(ceil(n::DOUBLE / a) AS BIGINT)) AS b FROM _n),
_i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS x FROM labels),
_w AS (SELECT e::BIGINT AS e, doc_id, x, 0 AS k FROM _i, (SELECT unnest(range(1, 4)) AS e)
  UNION ALL
  SELECT e, doc_id, r6 * b + c6, k + 1 FROM (SELECT e, doc_id, k, b, x // b AS r0, x % b AS c0, {", ".join(_sql_half(k, "a", "b") for k in range(1, 7))} FROM _w, _g WHERE k = 0 OR x >= n))
SELECT doc_id, max(x) FILTER (e = 1) AS position_1, max(x) FILTER (e = 2) AS position_2, max(x) FILTER (e = 3) AS position_3, max(x // 32) FILTER (e = 1) AS batch_1,
       max(x // 32) FILTER (e = 2) AS batch_2, max(x // 32) FILTER (e = 3) AS batch_3 FROM _w, _g WHERE k > 0 AND x < n GROUP BY doc_id""",
)
def q_epoch_permutation(spark, sf_dir):
    """O2 / W7 in closed form: place and batch of every row in three epochs, from one numbering."""
    out = O.epoch_positions(table(spark, sf_dir, "labels").select("doc_id"), [F.col("doc_id")], (1, 2, 3), 42, 32)
    return out.select("doc_id", *[i64(f"{c}_{e}").alias(f"{c}_{e}") for c in ("position", "batch") for e in (1, 2, 3)])


@register(
    "batch_assign",
    """SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS position,
              CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 128) AS BIGINT) AS batch_id FROM events""",
)
def q_batch_assign(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id")
    out = O.batch_assign(ev, [F.col("event_id")], 128)
    return out.select("event_id", i64("position").alias("position"), i64("batch_id").alias("batch_id"))


@register(
    "stratified_split",
    f"WITH {sql_stratified(HEADLINES_SQL, 'label', 'doc_id')} SELECT doc_id, CAST(label AS BIGINT) AS label, split FROM split_rows",
)
def q_stratified_split(spark, sf_dir):
    sp = SP.stratified_split(X.headlines(spark, sf_dir), "label", "doc_id", 0.2, 42)
    return sp.select("doc_id", i64("label").alias("label"), "split")


@register(
    "random_split",
    f"""WITH _s AS (SELECT doc_id FROM documents),
         _r AS (SELECT doc_id, row_number() OVER (ORDER BY {sql_bits(7, 'doc_id')}, doc_id) AS r, count(*) OVER () AS n FROM _s)
    SELECT doc_id, CASE WHEN r <= ceil(0.2::DOUBLE * n::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM _r""",
)
def q_random_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return SP.random_split(docs, "doc_id", seed=7, val_share=0.2).select("doc_id", "split")


@register(
    "split_sizes",
    f"WITH {sql_stratified(HEADLINES_SQL, 'label', 'doc_id')} SELECT split, CAST(label AS BIGINT) AS label, count(*) AS n_rows FROM split_rows GROUP BY split, label",
)
def q_split_sizes(spark, sf_dir):
    sp = SP.stratified_split(X.headlines(spark, sf_dir), "label", "doc_id", 0.2, 42)
    return SP.split_sizes(sp, "label").select("split", i64("label").alias("label"), "n_rows")


_WORDS = "list_filter(regexp_split_to_array(title, '\\s+'), lambda w: w <> '')"


@register(
    "delete_random_word",
    f"""WITH {sql_stratified(HEADLINES_SQL, 'label', 'doc_id')},
    _w AS (SELECT doc_id, split, title, {_WORDS} AS ws,
                  {sql_uniform(42, 'doc_id', "'coin'")} AS coin,
                  floor({sql_uniform(42, 'doc_id', "'pick'")} * len({_WORDS})) AS k FROM split_rows)
    SELECT doc_id, split,
           md5(CASE WHEN split = 'train' AND coin < 0.3 AND len(ws) > 3
                    THEN array_to_string(list_filter(ws, lambda w, i: i - 1 <> k), ' ') ELSE title END) AS title_md5
    FROM _w""",
)
def q_delete_random_word(spark, sf_dir):
    sp = SP.stratified_split(X.headlines(spark, sf_dir), "label", "doc_id", 0.2, 42)
    aug = AU.delete_random_word(sp, "title", "doc_id", seed=42, apply_to=F.col("split") == "train", out="aug")
    return aug.select("doc_id", "split", F.md5("aug").alias("title_md5"))


_DOC_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"


@register(
    "mask_random_tokens",
    f"""WITH _w AS (SELECT doc_id, {_DOC_WORDS} AS ws, {sql_uniform(42, 'doc_id', "'1'", "'row'")} AS ur FROM documents),
    _m AS (SELECT doc_id, CASE WHEN ur < 0.5 THEN list_transform(ws, lambda t, i: CASE WHEN {sql_uniform(42, 'doc_id', "'1'", 'i - 1')} <= 0.1 THEN '[MASK]' ELSE t END) ELSE ws END AS ms FROM _w)
    SELECT doc_id, md5(array_to_string(ms, ' ')) AS tokens_md5, CAST(len(list_filter(ms, lambda t: t = '[MASK]')) AS BIGINT) AS n_masked FROM _m""",
)
def q_mask_random_tokens(spark, sf_dir):
    docs = X.corpus(spark, sf_dir).select("doc_id", split_words("text").alias("tokens"))
    m = AU.mask_random_tokens(docs, "tokens", "doc_id", epoch=1, seed=42)
    return m.select(
        "doc_id",
        F.md5(F.array_join("tokens", " ")).alias("tokens_md5"),
        i64(F.size(F.filter("tokens", lambda t: t == AU.MASK_TOKEN))).alias("n_masked"),
    )
