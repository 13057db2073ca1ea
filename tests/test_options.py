"""Options that change an order of steps: which weights, where the vocabulary is fitted, blank titles after cleaning."""

import pytest
from pyspark.sql import functions as F

from ledeframe.operators import hygiene as H
from ledeframe.operators import train as T
from ledeframe.plans.slice import split_then_encode


def test_weights_of_the_best_or_the_last_epoch():
    res = T.TrainResult(weights=[([1.0], 0.0), ([2.0], 0.0), ([3.0], 0.0)], best_epoch=2)
    assert T.chosen_weights(res) == ([2.0], 0.0) and T.chosen_weights(res, "last") == ([3.0], 0.0)
    res.best_epoch = None  # no epoch was evaluated
    assert T.chosen_weights(res) == ([3.0], 0.0)
    with pytest.raises(ValueError):
        T.chosen_weights(res, "first")


def test_a_vocabulary_of_the_train_rows_knows_no_word_of_the_others(spark):
    rows = [(i, i % 2, f"all own{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, label int, text string")
    train, every = (split_then_encode(df, "text", 500, fit_on=f).withColumn("known", F.expr("ids[1] >= 2")) for f in ("train", "all"))
    count = lambda d: {(r["split"], r["known"]): r["count"] for r in d.groupBy("split", "known").count().collect()}
    assert count(train) == {("train", True): 48, ("val", False): 12}
    assert count(every) == {("train", True): 48, ("val", True): 12}
    with pytest.raises(ValueError):
        split_then_encode(df, "text", 500, fit_on="val")


def test_titles_that_cleaning_empties(spark):
    df = spark.createDataFrame([(" http://x.y/z ",), ("Ok!",), ("  ",), (None,), ("§§",)], "title string")
    titles = lambda **k: sorted(r["title"] for r in H.clean_titles(df, **k).collect())
    assert titles() == ["", "", "Ok!"] and titles(blank_after=True) == ["Ok!"]
