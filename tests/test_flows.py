"""End-to-end flows from a CSV written out of the given tables."""

import os

from pyspark.sql import functions as F

from ledeframe.plans import fixtures as X
from ledeframe.plans.flows import loop_flow, sequence_flow
from ledeframe.plans.q_vectors import ATTN_W

SF = "/root/testdata/sf0.001"


def _csv(spark, tmp_dir, encoding="UTF-8"):
    path = os.path.join(tmp_dir, "headlines")
    (
        X.headlines(spark, SF).select("doc_id", "title", "category")
        .write.mode("overwrite")
        .options(header=True, quote='"', escape='"', encoding=encoding, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .csv(path)
    )
    return path


def test_loop_flow(spark, tmp_dir):
    out = loop_flow(spark, _csv(spark, tmp_dir, "ISO-8859-1"), X.word_vectors(spark, SF), 64)
    log = out["log"].collect()
    assert len(log) >= 1 and [r.epoch for r in log] == list(range(1, len(log) + 1))
    rows = {r.row: r for r in out["report"].collect()}
    assert {"accuracy", "macro avg", "weighted avg"} <= set(rows)
    back = spark.read.options(header=True).csv(out["metrics_path"])
    assert back.count() == len(log)


def test_sequence_flow(spark, tmp_dir):
    out = sequence_flow(spark, _csv(spark, tmp_dir), X.word_vectors(spark, SF), 64, ATTN_W)
    cells = out["confusion"].collect()
    n_val = sum(c.n for c in cells)
    assert len(cells) >= 1 and n_val > 0
    acc = {r.row: r for r in out["report"].collect()}["accuracy"]
    assert acc.support == n_val
    assert out["report"].filter(F.col("row") == "weighted avg").count() == 1


def test_trainer_flow(spark, tmp_dir):
    from ledeframe.plans.flows import trainer_flow

    def strip_batch(pdf):
        return pdf.assign(title=pdf["title"].str.strip())

    out = trainer_flow(spark, _csv(spark, tmp_dir), X.word_vectors(spark, SF), 64, batch_fn=strip_batch)
    m = out["metrics"].first()
    assert 0.0 <= m.accuracy <= 1.0 and m.recall == m.accuracy
    sizes = {(r.split, r.label): r.n_rows for r in out["sizes"].collect()}
    n = sum(sizes.values())
    import math

    assert sum(v for (s, _), v in sizes.items() if s == "val") == math.ceil(0.2 * n)
