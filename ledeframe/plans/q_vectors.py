"""Registered queries: word-vector sources, embedding matrix, coverage, pooling, F14-F16."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ledeframe.functions.mathfn import clip_norm, clip_norm_global, sigmoid
from ledeframe.functions.sequence import pad_sequence
from ledeframe.functions.text import clean_alnum
from ledeframe.operators import vectors as VE
from ledeframe.operators import vocab as V
from ledeframe.plans import fixtures as X
from ledeframe.plans.catalog import (
    HEADLINES_SQL,
    LOGITS_SQL,
    PROBABILITIES_SQL,
    i64,
    r6,
    register,
    sql_clean_alnum,
    sql_encode,
    sql_keras_tokens,
    sql_vocab,
)
from ledeframe.session import scratch_path

DIM = 64
MAX_WORDS = 2000
MAX_LEN = 30


def _seeded_weights(seed: int, dim: int) -> list[float]:
    """Fixed attention weights for the pooling check: md5(seed|j) uniforms shifted to [-0.5, 0.5)."""
    out = []
    for j in range(dim):
        h = hashlib.md5(f"{seed}|{j}".encode()).hexdigest()[:8]
        out.append(int(h, 16) / 4294967296.0 - 0.5)
    return out


ATTN_W = _seeded_weights(7, DIM)


def sql_checksum(expr: str) -> str:
    return f"list_reduce(list_transform({expr}, lambda x, i: x::DOUBLE * i), lambda a, b: a + b, 0.0::DOUBLE)"


def sql_word_vectors() -> str:
    return f"""
_dv_tl AS (SELECT doc_id AS doc, {sql_keras_tokens('text')} AS toks FROM documents),
_dv_toks AS (SELECT _dv_tl.doc, u.w, u.i FROM _dv_tl, unnest(_dv_tl.toks) WITH ORDINALITY AS u(w, i)),
_dv_wc AS (SELECT w AS word, count(*) AS n, min(struct_pack(d := doc, p := i)) AS f FROM _dv_toks GROUP BY w),
_dv AS (SELECT word, CAST(row_number() OVER (ORDER BY n DESC, f.d, f.p) + 1 AS INTEGER) AS id FROM _dv_wc),
word_vectors AS (SELECT _dv.word, e.embedding AS vec FROM _dv JOIN embeddings e ON _dv.id = e.vec_id)
"""


def sql_matrix(max_words: int = MAX_WORDS, dim: int = DIM) -> str:
    return f"""
_cut AS (SELECT word, id FROM vocab WHERE id < {max_words} UNION ALL SELECT '<OOV>', 1),
_mv AS (SELECT c.id, list_transform(w.vec, lambda x: x::DOUBLE) AS vec FROM _cut c JOIN word_vectors w ON c.word = w.word),
matrix AS (SELECT CAST(r.range AS INTEGER) AS id, _mv.vec IS NOT NULL AS has_vector,
                  coalesce(_mv.vec, list_transform(range({dim}), lambda x: 0.0::DOUBLE)) AS vec
           FROM range(0, {max_words}) r LEFT JOIN _mv ON _mv.id = r.range)
"""


HEADLINE_VOCAB_SQL = sql_vocab(HEADLINES_SQL, sql_clean_alnum("title"))

SEQ_SQL = f"""
{HEADLINE_VOCAB_SQL}, {sql_encode(MAX_WORDS)}, {sql_word_vectors()}, {sql_matrix()},
_pd AS (SELECT doc AS doc_id, (ids || list_transform(range({MAX_LEN}), lambda x: 0))[1:{MAX_LEN}] AS ids FROM enc),
_ex AS (SELECT _pd.doc_id, u.id, u.pos - 1 AS pos FROM _pd, unnest(_pd.ids) WITH ORDINALITY AS u(id, pos)),
_lk AS (SELECT _ex.doc_id, _ex.pos, _ex.id, m.vec FROM _ex LEFT JOIN matrix m ON m.id = _ex.id),
seqs AS (SELECT doc_id, list(id ORDER BY pos) AS pos_ids, list(vec ORDER BY pos) AS vecs FROM _lk GROUP BY doc_id)
"""


def _headline_parts(spark, sf_dir):
    h = X.headlines(spark, sf_dir).withColumn("clean", clean_alnum("title"))
    vocab = V.vocab_top_n(h, MAX_WORDS, "clean", "doc_id")
    enc = V.token_to_id(h, vocab, MAX_WORDS, "clean", "doc_id", max_len=MAX_LEN).select("doc_id", pad_sequence("ids", MAX_LEN).alias("ids"))
    return h, vocab, enc


def _matrix(spark, sf_dir, vocab):
    return VE.embedding_matrix(vocab, X.word_vectors(spark, sf_dir), MAX_WORDS, DIM)


def _seqs(spark, sf_dir):
    _, vocab, enc = _headline_parts(spark, sf_dir)
    return VE.vector_sequences(enc, _matrix(spark, sf_dir, vocab))


WV_SELECT = f"SELECT word, CAST(len(vec) AS BIGINT) AS dim, round({sql_checksum('vec')}, 6) AS checksum FROM word_vectors"


def _wv_out(df):
    return df.select("word", i64(F.size("vec")).alias("dim"), r6(VE.checksum("vec")).alias("checksum"))


@register("word_vector_scan", f"WITH {sql_word_vectors()} {WV_SELECT}")
def q_word_vector_scan(spark, sf_dir):
    wv = X.word_vectors(spark, sf_dir)
    lines = wv.select(F.concat_ws(" ", F.col("word"), F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")).alias("value"))
    path = scratch_path(spark, "word-vectors-txt")
    lines.write.mode("overwrite").text(path)
    from ledeframe.sources.tables import word_vector_scan

    return _wv_out(word_vector_scan(spark, path))


@register("vector_table_scan", f"WITH {sql_word_vectors()} {WV_SELECT}")
def q_vector_table_scan(spark, sf_dir):
    path = scratch_path(spark, "word-vectors-parquet")
    X.word_vectors(spark, sf_dir).write.mode("overwrite").parquet(path)
    from ledeframe.sources.tables import vector_table_scan

    return _wv_out(vector_table_scan(spark, path))


@register(
    "embedding_matrix",
    f"WITH {HEADLINE_VOCAB_SQL}, {sql_word_vectors()}, {sql_matrix()} SELECT CAST(id AS BIGINT) AS id, has_vector, round({sql_checksum('vec')}, 6) AS checksum FROM matrix",
)
def q_embedding_matrix(spark, sf_dir):
    _, vocab, _ = _headline_parts(spark, sf_dir)
    m = _matrix(spark, sf_dir, vocab)
    return m.select(i64("id").alias("id"), "has_vector", r6(VE.checksum("vec")).alias("checksum"))


@register(
    "vector_membership",
    f"WITH {HEADLINE_VOCAB_SQL}, {sql_word_vectors()} SELECT v.word, CAST(v.id AS BIGINT) AS id FROM vocab v WHERE v.id < {MAX_WORDS} AND v.word IN (SELECT word FROM word_vectors)",
)
def q_vector_membership(spark, sf_dir):
    _, vocab, _ = _headline_parts(spark, sf_dir)
    return VE.vector_membership(vocab, X.word_vectors(spark, sf_dir), MAX_WORDS).select("word", i64("id").alias("id"))


@register(
    "embedding_coverage",
    f"""WITH {HEADLINE_VOCAB_SQL}, {sql_word_vectors()},
    _c AS (SELECT count(*) FILTER (WHERE v.id < {MAX_WORDS} AND v.word IN (SELECT word FROM word_vectors)) AS covered,
                  count(*) + 1 AS index_size, count(*) FILTER (WHERE v.id < {MAX_WORDS}) + 1 AS top_size FROM vocab v)
    SELECT covered, index_size, round(covered::DOUBLE / index_size::DOUBLE, 6) AS coverage, round(covered::DOUBLE / top_size::DOUBLE, 6) AS coverage_top FROM _c""",
)
def q_embedding_coverage(spark, sf_dir):
    h = X.headlines(spark, sf_dir).withColumn("clean", clean_alnum("title"))
    full = V.vocab_fit(h, "clean", "doc_id")
    cov = VE.embedding_coverage(full, X.word_vectors(spark, sf_dir), MAX_WORDS)
    return cov.select("covered", "index_size", r6("coverage").alias("coverage"), r6("coverage_top").alias("coverage_top"))


@register(
    "embed_lookup",
    f"WITH {SEQ_SQL} SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(id AS BIGINT) AS id, round({sql_checksum('vec')}, 6) AS checksum FROM _lk",
)
def q_embed_lookup(spark, sf_dir):
    _, vocab, enc = _headline_parts(spark, sf_dir)
    lk = VE.embed_lookup(enc, _matrix(spark, sf_dir, vocab))
    return lk.select("doc_id", i64("pos").alias("pos"), i64("id").alias("id"), r6(VE.checksum("vec")).alias("checksum"))


def sql_weighted_sum(vecs: str, weights: str, dim: int = DIM) -> str:
    return (
        f"list_transform(range({dim}), lambda j: list_reduce(list_transform(list_zip({vecs}, {weights}), "
        f"lambda p: p[1][j + 1] * p[2]), lambda a, b: a + b, 0.0::DOUBLE))"
    )


_MEAN_W = "list_transform(pos_ids, lambda x: CASE WHEN x <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


@register(
    "mean_pool",
    f"""WITH {SEQ_SQL},
    _w AS (SELECT doc_id, vecs, {_MEAN_W} AS w, list_reduce({_MEAN_W}, lambda a, b: a + b, 0.0::DOUBLE) AS n FROM seqs),
    _p AS (SELECT doc_id, list_transform({sql_weighted_sum('vecs', 'w')}, lambda s: CASE WHEN n > 0 THEN s / n ELSE 0.0 END) AS pooled FROM _w)
    SELECT doc_id, round({sql_checksum('pooled')}, 6) AS checksum FROM _p""",
)
def q_mean_pool(spark, sf_dir):
    pooled = VE.with_mean_pool(_seqs(spark, sf_dir), "vecs", "pos_ids", DIM)
    return pooled.select("doc_id", r6(VE.checksum("pooled")).alias("checksum"))


_ATTN_LIT = "[" + ", ".join(repr(x) for x in ATTN_W) + "]::DOUBLE[]"


@register(
    "attention_pool",
    f"""WITH {SEQ_SQL},
    _s AS (SELECT doc_id, vecs, list_transform(vecs, lambda v: tanh(list_reduce(list_transform(list_zip(v, {_ATTN_LIT}), lambda p: p[1] * p[2]), lambda a, b: a + b, 0.0::DOUBLE))) AS sc FROM seqs),
    _e AS (SELECT doc_id, vecs, list_transform(sc, lambda x: exp(x - list_max(sc))) AS ex FROM _s),
    _a AS (SELECT doc_id, vecs, list_transform(ex, lambda x: x / list_reduce(ex, lambda a, b: a + b, 0.0::DOUBLE)) AS a FROM _e)
    SELECT doc_id, round({sql_checksum(sql_weighted_sum('vecs', 'a'))}, 6) AS checksum, round(list_max(a), 6) AS max_weight FROM _a""",
)
def q_attention_pool(spark, sf_dir):
    pooled = VE.with_attention_pool(_seqs(spark, sf_dir), "vecs", ATTN_W, DIM)
    return pooled.select("doc_id", r6(VE.checksum("pooled")).alias("checksum"), r6(F.array_max("attn")).alias("max_weight"))


@register("first_token_pool", f"WITH {SEQ_SQL} SELECT doc_id, round({sql_checksum('vecs[1]')}, 6) AS checksum FROM seqs")
def q_first_token_pool(spark, sf_dir):
    s = _seqs(spark, sf_dir)
    return s.select("doc_id", r6(VE.checksum(VE.first_token_pool("vecs"))).alias("checksum"))


@register("sigmoid", f"SELECT vec_id, round(p, 6) AS p FROM ({PROBABILITIES_SQL})")
def q_sigmoid(spark, sf_dir):
    return X.probabilities(spark, sf_dir).select("vec_id", r6("p").alias("p"))


@register(
    "softmax",
    """WITH _q AS (SELECT vec_id // 10 AS seq, vec_id % 10 AS pos,
                      list_reduce(list_transform(embedding, lambda v: v::DOUBLE), lambda a, b: a + b, 0.0::DOUBLE) AS s FROM embeddings),
    _e AS (SELECT seq, pos, exp(s - max(s) OVER (PARTITION BY seq)) AS ex FROM _q)
    SELECT CAST(seq AS BIGINT) AS seq, CAST(pos AS BIGINT) AS pos, round(ex / sum(ex) OVER (PARTITION BY seq), 6) AS weight FROM _e""",
)
def q_softmax(spark, sf_dir):
    sq = X.sequences(spark, sf_dir).withColumn("s", F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double")))
    out = VE.position_softmax(sq, "seq", "s")
    return out.select(i64("seq").alias("seq"), i64("pos").alias("pos"), r6("weight").alias("weight"))


def sql_norm(expr: str) -> str:
    return f"sqrt(list_reduce(list_transform({expr}, lambda v: v * v), lambda a, b: a + b, 0.0::DOUBLE))"


@register(
    "clip_norm",
    f"""WITH _z AS (SELECT vec_id, z, {sql_norm('z')} AS nz, {sql_norm('z[1:5]')} AS n1, {sql_norm('z[6:10]')} AS n2 FROM ({LOGITS_SQL})),
    _c AS (SELECT vec_id, list_transform(z, lambda v: v * least(1.0, 1.0 / nz)) AS c1,
                  list_transform(z, lambda v: v * least(1.0, 1.0 / (sqrt(n1 * n1 + n2 * n2) + 1e-6))) AS c2 FROM _z)
    SELECT vec_id, round({sql_norm('c1')}, 6) AS norm_per_array, round({sql_norm('c2')}, 6) AS norm_global FROM _c""",
)
def q_clip_norm(spark, sf_dir):
    lg = X.logits(spark, sf_dir)
    per = clip_norm("z", 1.0)
    a, b = clip_norm_global([F.slice("z", 1, 5), F.slice("z", 6, 5)], 1.0, eps=1e-6)
    staged = lg.select("vec_id", per.alias("c1"), F.concat(a, b).alias("c2"))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v))
    return staged.select("vec_id", r6(norm("c1")).alias("norm_per_array"), r6(norm("c2")).alias("norm_global"))
