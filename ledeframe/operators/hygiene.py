"""Row hygiene: projections, null rules, domain and blank filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledeframe.functions.text import strip_text


def require_columns(df: DataFrame, cols) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")


def project_columns(df: DataFrame, cols=("title", "category")) -> DataFrame:
    """Keep the named columns (Catalyst prunes them at the scan)."""
    require_columns(df, cols)
    return df.select(*cols)


def drop_null_subset(df: DataFrame, subset) -> DataFrame:
    """Drop rows that are null in any of ``subset``."""
    require_columns(df, subset)
    return df.dropna(how="any", subset=list(subset))


def drop_null_any(df: DataFrame, cols=None) -> DataFrame:
    """Project (optional) then drop rows with any null."""
    out = project_columns(df, cols) if cols else df
    return out.dropna(how="any")


def filter_domain(df: DataFrame, col: str, allowed) -> DataFrame:
    """Keep rows whose ``col`` is one of ``allowed`` (null is not allowed)."""
    return df.filter(F.col(col).isin(list(allowed)))


def filter_not_blank(df: DataFrame, col: str = "title") -> DataFrame:
    """P5: drop rows whose text is empty after stripping whitespace (and nulls)."""
    return df.filter(F.length(strip_text(col)) > 0)


def null_as_text(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Cast to string; null becomes the text ``nan`` (pandas ``astype(str)``)."""
    return df.withColumn(out or col, F.coalesce(F.col(col).cast("string"), F.lit("nan")))


def label_to_int(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Cast a label to int.  Nulls stay null (an ANSI cast of junk raises)."""
    return df.withColumn(out or col, F.col(col).cast("int"))


def prune_columns(df: DataFrame, cols=("ids", "mask", "label")) -> DataFrame:
    """Keep only the model's columns."""
    return project_columns(df, cols)


def clean_titles(df: DataFrame, title_col: str = "title", blank_after: bool = False) -> DataFrame:
    """P5 and F3 in the reference's order: blank titles go, then titles are cleaned, which may empty some; with
    ``blank_after`` those go too (Q8). Null titles go with the blank ones."""
    from ledeframe.functions.text import clean_headline

    cleaned = filter_not_blank(df, title_col).withColumn(title_col, clean_headline(title_col))
    return filter_not_blank(cleaned, title_col) if blank_after else cleaned
