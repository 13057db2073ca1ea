"""User-function surface.

User code that is not expressible as columns runs on Arrow batches
(``mapInPandas`` / Arrow-optimised ``udf``), never row-at-a-time pickling.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledeframe.functions.sequence import attention_mask, frame_sequence, pad_sequence
from ledeframe.session import ship_code


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """``map(fn, batched=True)``: ``fn`` gets a pandas batch and returns it with
    added columns; ``schema`` is the output schema.  Runs per Arrow batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)

    ship_code()
    return df.mapInPandas(run, schema)


def map_rows(fn: Callable, return_type: str = "string"):
    """A per-value Python function as an Arrow-optimised UDF.

    Prefer a column expression (``ledeframe.functions``) where one exists; this
    is for arbitrary user code."""
    ship_code()
    return F.udf(fn, return_type, useArrow=True)


class RowEncoder:
    """The per-row encoder of the transformer scripts as composed columns:
    ``[cls] + ids[:n-2] + [sep]``, padded, with its attention mask.  Use with
    ``df.transform(RowEncoder(...))``; nothing is computed per row in Python."""

    def __init__(self, max_len: int, cls_id: int, sep_id: int, ids_col: str = "ids", label_col: str | None = "label"):
        self.max_len, self.cls_id, self.sep_id = max_len, cls_id, sep_id
        self.ids_col, self.label_col = ids_col, label_col

    def __call__(self, df: DataFrame) -> DataFrame:
        n = self.max_len
        real = F.concat(F.array(F.lit(self.cls_id)), F.slice(self.ids_col, 1, n - 2), F.array(F.lit(self.sep_id)))
        out = df.withColumn("input_ids", frame_sequence(self.ids_col, n, self.cls_id, self.sep_id)).withColumn(
            "attention_mask", attention_mask(real, n)
        )
        return out


def collate(df: DataFrame, batch_col: str, ids_col: str = "ids", out: str = "batch_ids") -> DataFrame:
    """Pad each row to the longest sequence of its batch.

    The batch maximum is a per-batch aggregate joined back on ``batch_col``
    (one row per batch)."""
    longest = df.groupBy(batch_col).agg(F.max(F.size(ids_col)).alias("batch_len"))
    j = df.join(longest, batch_col)
    return j.withColumn(out, pad_sequence(ids_col, "batch_len"))
