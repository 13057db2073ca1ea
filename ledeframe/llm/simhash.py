"""SimHash near-duplicates by covering locality-sensitive hashing.

Each text gets a 64-bit SimHash of its word shingles. For a radius r, bit i is
given a non-zero vector m(i) of r + 1 bits; table v (one for each non-zero
vector of r + 1 bits) keeps exactly the bits with odd <v, m(i)>. Two fingerprints
that differ in at most r bits restrict v by at most r equations, so some table
drops all differing bits and the pair meets there: no pair within the radius is
missed, for any data.

Inside a table's bucket no pairs are listed. A member of a bucket of two or more
publishes itself with up to r/2 of the dropped bits flipped; two members that
publish the same value differ in at most r bits, and any two members within r
publish a common one. So each published value links its publishers to the
smallest of them, and the number of rows is linear in the members whatever the
size of a bucket. The XXH64 of a published value's few publishers (at most 65
for r = 2) is bounded by geometry, not by the data.

Equal fingerprints are collapsed before any of this.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ledeframe.llm.common import connected_components, cut_lineage, hex64, ship_code, unused

BITS = 64


def simhash_bytes(text: bytes, shingle: int) -> int:
    """Unsigned SimHash of the lower-cased words of ``text`` (A-Z only are lowered)."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n]
    stops = ends[min(shingle, len(words)) - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        spans = zip(starts[at : at + (1 << 15)].tolist(), stops[at : at + (1 << 15)].tolist())
        hashes = np.array([digest(joined[i:j], 42) for i, j in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def simhash(docs: DataFrame, text_col: str = "text", shingle: int = 3, out: str = "fingerprint") -> DataFrame:
    """``docs`` with a long column ``out``. A null text counts as empty, whose fingerprint is zero."""
    ship_code()

    @arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        values = (simhash_bytes(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in texts)
        return pa.array(np.fromiter(values, np.uint64, len(texts)).view(np.int64))

    return docs.withColumn(out, fingerprint(F.col(text_col).cast("string")))


def covering_masks(radius: int) -> list[int]:
    """One mask of kept bits per table, 2^(radius + 1) - 1 of them."""
    top = 1 << (radius + 1)
    vectors = [i % (top - 1) + 1 for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (v & m).bit_count() % 2) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(prints: DataFrame, col: str, radius: int) -> DataFrame:
    """(a, b) links that join all distinct non-null values of ``col`` at most ``radius`` bits apart
    into the same components; every link is itself within the radius."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be an even number of bits")
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
    members = prints.select(F.col(col).alias("fp")).where("fp is not null").distinct().select("fp", F.inline(tables))
    full = members.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    near = members.join(full, ["t", "key"])

    def published(t):
        dropped = [1 << i for i in range(BITS) if not masks[t] >> i & 1]
        flips = [0] + [sum(c) for k in range(1, radius // 2 + 1) for c in combinations(dropped, k)]
        return F.array(*[F.lit(_signed(f)) for f in flips])

    flips = F.when(F.col("t") == 0, published(0))
    for t in range(1, len(masks)):
        flips = flips.when(F.col("t") == t, published(t))
    values = near.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    groups = values.groupBy("z").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    links = groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a != b").distinct()
    return links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, kept.

    component_id is the smallest id reachable over links of at most ``max_bits``
    bits; ids that are null are passed over for it (a group of null ids only has
    component_id null). kept is true on rows whose id is the component's (null ids
    only: on all of them). Texts without a word share fingerprint zero and are
    linked like others; repeated rows get equal results; no rows give no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = cut_lineage(simhash(base, "text", shingle, "fp").select("doc_id", "fp"))
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    comp = connected_components(near_links(first, "fp", max_bits), "a", "b")
    rooted = first.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each group left, all columns unchanged: the one of the
    smallest id (rows that repeat this id: one of them). Rows without an id stay, as nothing names them."""
    keys = simhash_groups(docs, id_col, text_col, shingle, max_bits).where("kept").select(F.col("doc_id").alias(id_col)).distinct()
    known = docs.where(F.col(id_col).isNotNull()).join(keys, id_col, "left_semi").dropDuplicates([id_col])
    return known.unionByName(docs.where(F.col(id_col).isNull()))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates left, all columns unchanged, whether ids
    are null, repeated or shared by different texts.

    The row is the one of the least id (nulls last), then of the least fingerprint and least
    SHA-256 of its text; of rows that repeat all of these one stays.
    """
    key = F.struct(
        F.col(id_col).cast("long").isNull().alias("none"),
        F.col(id_col).cast("long").alias("id"),
        F.col("fp").alias("fp"),
        F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("text"),
    )
    base = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    rows = cut_lineage(simhash(base, text_col, shingle, "fp").select("fp", key.alias("key")))
    first = rows.groupBy("fp").agg(F.min("key").alias("key"))
    comp = connected_components(near_links(first, "fp", max_bits), "a", "b")
    rooted = first.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    chosen = rooted.groupBy("root").agg(F.min("key").alias("key")).select("key.id", "key.text")
    known = unused(docs, "digest")
    text = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    marked = docs.withColumn(known, text)
    same = marked[id_col].cast("long").eqNullSafe(chosen["id"]) & (marked[known] == chosen["text"])
    return marked.join(chosen, same, "left_semi").dropDuplicates([id_col, known]).drop(known)
