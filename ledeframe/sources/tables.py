"""Sources (S1-S6): CSV headline tables, word-vector files, vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledeframe.sources.csv_records import LINEWISE, csv_records

# The field texts pandas reads as missing by default.
PANDAS_NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

HEADLINE_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("category", T.StringType()),
    ]
)


def _na_to_null(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            cols.append(F.when(F.col(f.name).isin(PANDAS_NA_VALUES), F.lit(None)).otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def csv_scan(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str = HEADLINE_SCHEMA,
    encoding: str = "UTF-8",
    na_values: bool = True,
) -> DataFrame:
    """CSV with a header, RFC-4180 quoting (doubled quotes, embedded line breaks, kept as they are).

    Files are read in splits, so a large one is read by many tasks (``csv_records``); an
    encoding whose lines cannot be found byte by byte (UTF-16 and such) takes one task per file. An explicit
    schema, by position (no inference pass).  With ``na_values`` the texts pandas treats as
    missing become null, since Spark keeps them as strings.
    """
    options = {"quote": '"', "escape": '"', "mode": "FAILFAST"}
    if not encoding.lower().startswith(LINEWISE):
        df = spark.read.schema(schema).options(header=True, multiLine=True, encoding=encoding, **options).csv(path)
    else:
        ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        fields = csv_records(spark, path, encoding).where("not first").select(F.from_csv("record", ddl, options).alias("r"))
        df = fields.select("r.*")
    return _na_to_null(df) if na_values else df


def csv_scan_encoding(spark: SparkSession, path: str, schema: T.StructType | str = HEADLINE_SCHEMA, encoding: str = "ISO-8859-1") -> DataFrame:
    """The same scan decoding ISO-8859-1 bytes."""
    return csv_scan(spark, path, schema, encoding)


def scan_first_file(spark: SparkSession, paths, fmt: str = "parquet", **options) -> DataFrame:
    """S3: read only the first of the supplied files: paths in the order given, the files of a folder or pattern by name.

    The files are listed, not read, to find it. No file at all is an error.
    """
    for path in [paths] if isinstance(paths, str) else paths:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).inputFiles()
        if listed:
            return spark.read.format(fmt).options(**options).load(min(listed))
    raise ValueError("no input files")


def word_vector_scan(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``word v1 ... vd`` -> ``(word, vec array<float>)``; a repeated word
    keeps its last line (file name, split offset, then line order)."""
    lines = spark.read.text(path).select(
        F.col("value"),
        F.col("_metadata.file_path").alias("_f"),
        F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_m"),
    )
    parts = lines.select(F.filter(F.split(F.col("value"), r"(?U)\s+"), lambda x: x != "").alias("_p"), "_f", "_b", "_m")
    parts = parts.filter(F.size("_p") > 0)
    parsed = parts.select(
        F.col("_p")[0].alias("word"),
        F.slice("_p", 2, F.size("_p") - 1).cast("array<float>").alias("vec"),
        F.struct("_f", "_b", "_m").alias("_at"),
    )
    return parsed.groupBy("word").agg(F.max_by("vec", "_at").alias("vec"))


def vector_table_scan(spark: SparkSession, path: str, key_col: str = "word", vec_col: str = "vec") -> DataFrame:
    """A stored vector table ``(word, vec array<float>)``."""
    df = spark.read.parquet(path)
    return df.select(F.col(key_col).alias("word"), F.col(vec_col).cast("array<float>").alias("vec"))


def columns_to_dataset(spark: SparkSession, data, columns=None, schema=None) -> DataFrame:
    """A dataset from a DataFrame (column selection), a pandas frame, or a
    dict of equally long column lists (small literals only)."""
    if isinstance(data, DataFrame):
        return data.select(*(columns or data.columns))
    if isinstance(data, dict):
        import pandas as pd

        data = pd.DataFrame(data)
    df = spark.createDataFrame(data, schema=schema)
    return df.select(*(columns or df.columns))
