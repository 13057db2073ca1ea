"""Word vectors, the embedding matrix and pooling.

The embedding matrix has at most ``max_words`` rows (a parameter), so it is
the side that gets broadcast; the vector file (far larger than the vocabulary)
is first reduced by a semi-join against the cut vocabulary.  Per-document
vector sequences are bounded by the padded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledeframe.operators.vocab import OOV_ID, by_document


def _cut(vocab: DataFrame, max_words: int) -> DataFrame:
    return vocab.filter(F.col("id") < max_words).select("word", "id")


def vector_membership(vocab: DataFrame, vectors: DataFrame, max_words: int) -> DataFrame:
    """Vocabulary words (id < max_words) that have a vector."""
    cut = _cut(vocab, max_words)
    return cut.join(vectors.select("word"), "word", "left_semi")


def embedding_matrix(vocab: DataFrame, vectors: DataFrame, max_words: int, dim: int, oov_token: str = "<OOV>") -> DataFrame:
    """One row per id in [0, max_words): the word's vector, zeros when absent.

    Id 1 is the OOV token (zeros unless the vector table has that token).
    """
    spark = vocab.sparkSession
    cut = _cut(vocab, max_words).unionByName(spark.createDataFrame([(oov_token, OOV_ID)], "word string, id int"))
    # Reduce the (large) vector table to vocabulary words first; the cut vocabulary
    # has at most max_words rows, so broadcasting it is bounded by the parameter.
    needed = vectors.join(F.broadcast(cut.select("word")), "word", "left_semi")
    with_vec = cut.join(needed, "word", "inner").select("id", F.col("vec").cast("array<double>").alias("vec"))
    ids = spark.range(max_words).select(F.col("id").cast("int").alias("id"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    return ids.join(with_vec, "id", "left").select(
        "id", F.col("vec").isNotNull().alias("has_vector"), F.coalesce(F.col("vec"), zeros).alias("vec")
    )


def embedding_coverage(vocab: DataFrame, vectors: DataFrame, max_words: int) -> DataFrame:
    """A3: words with a vector among ids < max_words, over the size of the full word
    index (distinct words plus the OOV entry: the reference's denominator) and
    over the cut index."""
    mem = vector_membership(vocab, vectors, max_words).select("word", F.lit(1).alias("_hv"))
    j = vocab.join(mem, "word", "left")
    agg = j.agg(
        F.count("_hv").alias("covered"),
        (F.count(F.lit(1)) + 1).alias("index_size"),
        (F.count(F.when(F.col("id") < max_words, 1)) + 1).alias("top_size"),
    )
    return agg.select(
        "covered", "index_size",
        F.try_divide(F.col("covered").cast("double"), F.col("index_size").cast("double")).alias("coverage"),
        F.try_divide(F.col("covered").cast("double"), F.col("top_size").cast("double")).alias("coverage_top"),
    )


def position_softmax(df: DataFrame, group_col: str, score_col: str, out: str = "weight") -> DataFrame:
    """F15 (window form): exp(s - max) / sum(exp(s - max)) over each group's positions."""
    w = Window.partitionBy(group_col)
    shifted = F.exp(F.col(score_col) - F.max(score_col).over(w))
    return df.withColumn("_ex", shifted).withColumn(out, F.col("_ex") / F.sum("_ex").over(w)).drop("_ex")


def embed_lookup(df: DataFrame, matrix: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """T3 (long form): one row per (document, position) with that id's vector."""
    keyed = by_document(df, id_col)
    ex = keyed.select(id_col, F.posexplode(ids_col).alias("pos", "id"))
    return ex.join(F.broadcast(matrix.select("id", "vec")), "id", "left").select(id_col, "pos", "id", "vec")


def vector_sequences(df: DataFrame, matrix: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", out: str = "vecs") -> DataFrame:
    """T3 (array form): per row the array of its position vectors, in order; no ids give empty arrays.

    Rows are partitioned by id and ids' hash before exploding, so regrouping needs no
    exchange and rows that repeat a document's id keep their own sequences; a row repeated in
    full comes back as often. The group is one row's padded length (a parameter).
    """
    keys = [id_col, "_ids"]
    keyed = df.select(id_col, F.col(ids_col).alias("_seq"), F.xxhash64(ids_col).alias("_ids")).repartition(*keys)
    ex = keyed.select(*keys, F.posexplode_outer("_seq").alias("pos", "id"))
    looked = ex.join(F.broadcast(matrix.select("id", "vec")), "id", "left")
    begins = F.col("pos").isNull() | (F.col("pos") == 0)
    entry = F.when(F.col("pos").isNotNull(), F.struct("pos", "id", "vec"))
    seqs = looked.groupBy(*keys).agg(F.sort_array(F.collect_set(entry)).alias("_s"), F.count_if(begins).alias("_copies"))
    copies = seqs.select(id_col, F.col("_s.id").alias("pos_ids"), F.col("_s.vec").alias(out), F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_c"))
    return copies.drop("_c")


def _dim_sum(vecs: Column, weights: Column | None, dim: int) -> Column:
    """Sum over positions of (weight x vector), one pass with a dim-wide accumulator."""
    zero = F.array_repeat(F.lit(0.0), dim)
    if weights is None:
        return F.aggregate(vecs, zero, lambda acc, v: F.zip_with(acc, v, lambda a, x: a + x))
    pairs = F.arrays_zip(vecs.alias("v"), weights.alias("w"))
    return F.aggregate(pairs, zero, lambda acc, p: F.zip_with(acc, p["v"], lambda a, x: a + x * p["w"]))


def with_mean_pool(df: DataFrame, vecs_col: str, ids_col: str, dim: int, out: str = "pooled", include_pad: bool = False) -> DataFrame:
    """T5: mean of the word vectors of a document (non-pad positions unless ``include_pad``).

    Intermediate arrays are separate columns: Catalyst does not share common
    subexpressions inside lambdas, so inlining them would recompute per element.
    """
    ids = F.col(ids_col)
    w = F.transform(ids, lambda x: F.lit(1.0)) if include_pad else F.transform(ids, lambda x: F.when(x != 0, 1.0).otherwise(0.0))
    staged = df.withColumn("_w", w).withColumn("_n", F.aggregate("_w", F.lit(0.0), lambda a, x: a + x))
    staged = staged.withColumn("_sum", _dim_sum(F.col(vecs_col), F.col("_w"), dim))
    pooled = F.transform("_sum", lambda v: F.when(F.col("_n") > 0, v / F.col("_n")).otherwise(F.lit(0.0)))
    return staged.withColumn(out, pooled).drop("_w", "_n", "_sum")


def with_attention_pool(
    df: DataFrame,
    vecs_col: str,
    w: list[float],
    dim: int,
    b: list[float] | None = None,
    out: str = "pooled",
    weights_out: str = "attn",
    mask_pad: bool = False,
    ids_col: str = "pos_ids",
) -> DataFrame:
    """T4: e = tanh(x_pos . w + b_pos); a = softmax over positions; pooled = sum_pos a_pos x_pos.

    Pad positions take part by default, as in the reference layer; with
    ``mask_pad`` the positions whose id is 0 get weight 0 (nothing but padding: all zeros).
    """
    wl = F.array(*[F.lit(float(x)) for x in w])
    bl = F.array(*[F.lit(float(x)) for x in b]) if b else None

    def score(v, i):
        dot = F.aggregate(F.arrays_zip(v.alias("x"), wl.alias("k")), F.lit(0.0), lambda a, p: a + p["x"] * p["k"])
        bias = F.coalesce(F.get(bl, i), F.lit(0.0)) if bl is not None else F.lit(0.0)
        return F.tanh(dot + bias)

    staged = df.withColumn("_sc", F.transform(F.col(vecs_col), score))
    if mask_pad:
        masked = F.zip_with("_sc", F.col(ids_col), lambda sc, i: F.when(i == 0, F.lit(float("-inf"))).otherwise(sc))
        staged = staged.withColumn("_sc", masked)
    staged = staged.withColumn("_mx", F.array_max("_sc"))
    exp = lambda x: F.when(F.col("_mx") > float("-inf"), F.exp(x - F.col("_mx"))).otherwise(F.lit(0.0))
    staged = staged.withColumn("_ex", F.transform("_sc", exp))
    staged = staged.withColumn("_tot", F.aggregate("_ex", F.lit(0.0), lambda a, x: a + x))
    staged = staged.withColumn(weights_out, F.transform("_ex", lambda x: F.when(F.col("_tot") > 0, x / F.col("_tot")).otherwise(F.lit(0.0))))
    staged = staged.withColumn(out, _dim_sum(F.col(vecs_col), F.col(weights_out), dim))
    return staged.drop("_sc", "_mx", "_ex", "_tot")


def first_token_pool(vecs_col: str) -> Column:
    """The vector at position 0."""
    return F.get(F.col(vecs_col), 0)


def checksum(vec) -> Column:
    """A position-weighted element sum: a compact fingerprint of a vector."""
    v = F.col(vec) if isinstance(vec, str) else vec
    return F.aggregate(F.transform(v, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
