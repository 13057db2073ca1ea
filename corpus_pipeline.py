"""A training corpus from raw documents, as stages that each read what the one before wrote.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledeframe.llm.bpe import decode, encode, load
from ledeframe.llm.common import documents, table, unused
from ledeframe.llm.mixing import take_mix
from ledeframe.llm.secrets import mask_secrets
from ledeframe.llm.simhash import one_of_each_group
from ledeframe.llm.toxicity import fit, labelled_sample, toxicity
from ledeframe.session import scratch_path

TOXIC_FROM = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC_FROM``. Null and empty texts score like any other text without a toxic
    string; rows are judged one by one, so repeated rows and ids go or stay together. Without labelled rows, and
    on an empty table, nothing is dropped."""
    score = unused(docs, "score")
    model = fit(*labelled_sample(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))
    return toxicity(docs, model, "text", score).where(F.col(score) < TOXIC_FROM).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 3-word-shingle SimHashes hang together at 2 bits or less: that with the least id
    (null ids last, then fingerprint and text hash). Null and wordless texts have fingerprint 0 and make one group, of
    rows repeated in full one stays, an empty table stays empty."""
    return one_of_each_group(docs, "doc_id", "text", shingle=3, max_bits=2)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets masked; n_chars follows the text, where it was not null. Null texts stay null, every row is kept, repeated ones
    alike; an empty table stays empty."""
    masked = mask_secrets(docs, "text")
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(dict(docs.dtypes)["n_chars"])))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: documents as often as it takes them, up to three times. Null is a source of its own (the last);
    null and wordless texts have no words to take and go; ties in the order are broken by a hash of the id, then
    id and source, so reruns agree; an empty table stays empty."""
    return take_mix(docs, "doc_id", "text", "source")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token ids, their number and digest, and the digest of the bytes they decode to; all other columns
    end here. Null and empty texts have no ids, repeated rows are encoded alike, an empty table stays empty."""
    vocabulary = load(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = encode(docs.select("doc_id", "source", "text"), vocabulary, public_tokenizers.PATTERN, "text", "ids", spaced=True).drop("text")
    return decode(ids, vocabulary, "ids", "decoded").select(
        "doc_id",
        "source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scans", mask),
    ("source_mixing", mix_sources),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # a fitted classifier, SimHash and BPE are beyond SQL; see tests/llm
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
