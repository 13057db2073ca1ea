"""Hand-checked edge tables (inline rows) for the rules the given tables never hit."""

import math
import os

import pytest
from pyspark.sql import functions as F

from ledeframe.functions import text as TX
from ledeframe.functions.sequence import argmax_class, attention_mask, frame_sequence, pad_sequence
from ledeframe.operators import hygiene as H
from ledeframe.operators import labels as L
from ledeframe.operators import metrics as M
from ledeframe.operators import runlog as R
from ledeframe.operators import vectors as VE
from ledeframe.operators import vocab as V
from ledeframe.sources import tables as S

NBSP = " "


# --- dirty headlines / CSV edges --------------------------------------------------


def _write(path, text, encoding="utf-8"):
    with open(path, "wb") as f:
        f.write(text.encode(encoding))


DIRTY_CSV = (
    "doc_id,title,category\n"
    "1,,political\n"
    "2,Some title,\n"
    '3,"",political\n'
    '4,"   ",political\n'
    "5,NA,political\n"
    "6,http://x.example/a,political\n"
    '7,"!!! ??? ---",non-political\n'
    "8,Budget vote,sports\n"
    f'9,"{NBSP}Tax{NBSP}cut{NBSP}",political\n'
    "10,don't stop-now,non-political\n"
    '11,"a\tb\nc ""quoted""",political\n'
)


def test_csv_scan_nulls_quotes_newlines(spark, tmp_dir):
    p = os.path.join(tmp_dir, "dirty.csv")
    _write(p, DIRTY_CSV)
    df = S.csv_scan(spark, p)
    rows = {r.doc_id: r for r in df.collect()}
    assert len(rows) == 11
    assert rows[1].title is None and rows[3].title is None and rows[5].title is None  # empty, "", NA
    assert rows[2].category is None
    assert rows[4].title == "   "
    assert rows[11].title == 'a\tb\nc "quoted"'
    # Rows with a null in title or category go
    assert H.drop_null_subset(df, ["title", "category"]).count() == 7
    # Unknown category and null category go
    kept = {r.doc_id for r in H.filter_domain(df, "category", L.HEADLINE_LABELS).collect()}
    assert kept == {1, 3, 4, 5, 6, 7, 9, 10, 11}
    # Unknown -> null label, kept by default, dropped on request
    lm = {r.doc_id: r.label for r in L.label_map(df, "category").collect()}
    assert lm[8] is None and lm[2] is None and lm[10] == 0 and lm[9] == 1
    assert L.label_map(df, "category", on_unknown="drop").count() == 9
    # P5: null, spaces-only and NBSP-only text go; NBSP around words is stripped
    nb = {r.doc_id for r in H.filter_not_blank(df, "title").collect()}
    assert 4 not in nb and 1 not in nb and 9 in nb
    # Null title becomes 'nan'
    assert {r.doc_id: r.title for r in H.null_as_text(df, "title").collect()}[1] == "nan"


def test_csv_scan_latin1(spark, tmp_dir):
    p = os.path.join(tmp_dir, "latin.csv")
    _write(p, "doc_id,title,category\n1,Café à Zürich,political\n", "iso-8859-1")
    row = S.csv_scan_encoding(spark, p).first()
    assert row.title == "Café à Zürich"


def test_text_rules(spark):
    rows = [
        (1, f"{NBSP}Tax{NBSP}cut{NBSP}"),
        (2, "don't stop-now"),
        (3, "a\tb\nc"),
        (4, "http://x.example/a Big   News!! €5"),
        (5, "!!! ??? ---"),
    ]
    df = spark.createDataFrame(rows, "id long, t string")
    out = {
        r.id: r
        for r in df.select(
            "id",
            TX.strip_text("t").alias("f1"),
            TX.clean_alnum("t").alias("f2"),
            TX.clean_headline("t").alias("f3"),
            TX.tokenizer_words("t").alias("f4"),
            TX.split_words("t").alias("f5"),
            TX.join_words(TX.split_words("t")).alias("f6"),
        ).collect()
    }
    assert out[1].f1 == f"Tax{NBSP}cut"  # Unicode whitespace stripped like str.strip()
    assert out[2].f2 == "dont stopnow"  # punctuation deleted, nothing put in place
    assert out[2].f4 == ["don't", "stop", "now"]  # apostrophe kept by the tokenizer filter
    assert out[3].f4 == ["a", "b", "c"] and out[3].f5 == ["a", "b", "c"]
    assert out[4].f3 == "Big News!! 5"
    assert out[5].f2 == "  " and out[5].f4 == []  # the two separating spaces stay
    assert out[1].f5 == ["Tax", "cut"] and out[1].f6 == "Tax cut"


# --- tiny corpus: vocabulary, ids, padding ----------------------------------------


@pytest.fixture()
def tiny(spark):
    rows = [(0, "b a c a"), (1, "c b"), (2, ""), (3, "a d e f g h")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_vocab_ties_by_first_appearance(tiny):
    v = {r.word: (r.n, r.df, r.id) for r in V.vocab_fit(tiny, "text").collect()}
    assert v["a"] == (3, 2, 2)
    assert v["b"] == (2, 2, 3)  # tie with c, but b appears first
    assert v["c"] == (2, 2, 4)
    assert [w for w, _ in sorted(((w, x[2]) for w, x in v.items()), key=lambda t: t[1])][3:] == ["d", "e", "f", "g", "h"]
    top = {r.word: r.id for r in V.vocab_top_n(tiny, 5, "text").collect()}
    assert top == {"a": 2, "b": 3, "c": 4}


def test_encode_pad_mask_frame(tiny):
    vocab = V.vocab_top_n(tiny, 5, "text")
    enc = V.token_to_id(tiny, vocab, 5, "text")
    out = {
        r.doc_id: r
        for r in enc.select(
            "doc_id", "ids", pad_sequence("ids", 4).alias("p"), attention_mask("ids", 4).alias("m"),
            frame_sequence("ids", 4, cls_id=9, sep_id=8).alias("f"),
        ).collect()
    }
    assert out[0].ids == [3, 2, 4, 2]
    assert out[3].ids == [2, 1, 1, 1, 1, 1]  # d.. are beyond max_words -> OOV
    assert out[2].ids == [] and out[2].p == [0, 0, 0, 0] and out[2].m == [0, 0, 0, 0]
    assert out[1].p == [4, 3, 0, 0] and out[1].m == [1, 1, 0, 0]
    assert out[3].p == [2, 1, 1, 1]
    assert out[3].f == [9, 2, 1, 8] and out[2].f == [9, 8, 0, 0]
    assert all(len(r.p) == 4 for r in out.values())


# --- vector lines: last wins, matrix, coverage ----------------------------------


def test_vectors_last_wins_matrix_coverage(spark, tmp_dir):
    p = os.path.join(tmp_dir, "vec.txt")
    _write(p, "a 1 2 3\nb 4 5 6\na 7 8 9\nzz 1 1 1\n  c   0.5 0.25 -1  \n")
    vecs = {r.word: list(r.vec) for r in S.word_vector_scan(spark, p).collect()}
    assert vecs["a"] == [7.0, 8.0, 9.0] and vecs["c"] == [0.5, 0.25, -1.0] and len(vecs) == 4
    vocab = spark.createDataFrame([("a", 2), ("b", 3), ("c", 4), ("d", 5)], "word string, id int")
    vt = S.word_vector_scan(spark, p)
    m = {r.id: (r.has_vector, list(r.vec)) for r in VE.embedding_matrix(vocab, vt, 5, 3).collect()}
    assert sorted(m) == [0, 1, 2, 3, 4]
    assert m[0] == (False, [0.0, 0.0, 0.0]) and m[1][0] is False
    assert m[2] == (True, [7.0, 8.0, 9.0])
    cov = VE.embedding_coverage(vocab, vt, 5).first()
    assert cov.covered == 3 and cov.index_size == 5
    assert cov.coverage == pytest.approx(0.6) and cov.coverage_top == pytest.approx(0.75)


# --- metric edges ----------------------------------------------------------------


def _pred(spark, ys, ps):
    return spark.createDataFrame(list(zip(range(len(ys)), ys, ps)), "id long, y int, pred int")


def test_metrics_class_never_predicted(spark):
    df = _pred(spark, [0, 0, 1, 1], [0, 0, 0, 0])
    pc = {r.label: r for r in M.per_class(df).collect()}
    assert (pc[1].precision, pc[1].recall, pc[1].f1) == (0.0, 0.0, 0.0)
    assert pc[0].precision == 0.5 and pc[0].recall == 1.0 and pc[0].f1 == pytest.approx(2 / 3)
    w = M.weighted_prf(df).first()
    assert w.f1 == pytest.approx(1 / 3) and w.recall == pytest.approx(0.5)
    assert M.accuracy(df).first().accuracy == 0.5
    cells = M.confusion_cells(df).collect()
    assert len(cells) == 4 and sum(c.n for c in cells) == 4
    assert {(c.y, c.pred): c.n for c in cells}[(1, 1)] == 0  # zero cell kept


def test_metrics_class_never_true_single_all_wrong(spark):
    pc = {r.label: r for r in M.per_class(_pred(spark, [0, 0], [0, 1])).collect()}
    assert pc[1].support == 0 and pc[1].recall == 0.0 and pc[1].precision == 0.0
    assert pc[0].precision == 1.0 and pc[0].recall == 0.5
    single = M.classification_report(_pred(spark, [1, 1], [1, 1])).collect()
    assert {r.row for r in single} == {"1", "accuracy", "macro avg", "weighted avg"}
    assert all(r.f1 == 1.0 for r in single)
    wrong = _pred(spark, [0, 1], [1, 0])
    assert M.accuracy(wrong).first().accuracy == 0.0
    b = M.binary_prf(wrong).first()
    assert (b.precision, b.recall, b.f1) == (0.0, 0.0, 0.0)


def test_weighted_recall_equals_accuracy(spark):
    df = _pred(spark, [0, 1, 2, 2, 1, 0, 2], [0, 2, 2, 1, 1, 0, 0])
    assert M.weighted_prf(df).first().recall == pytest.approx(M.accuracy(df).first().accuracy)


def test_tied_and_large_logits(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], 1), ([1000.0, 1000.0], 0), ([5.0], 0)], "z array<double>, y int")
    rows = df.select(argmax_class("z").alias("a"), M.cross_entropy("z", "y").alias("ce")).collect()
    assert [r.a for r in rows] == [1, 0, 0]
    assert rows[1].ce == pytest.approx(math.log(2)) and rows[2].ce == pytest.approx(0.0)
    sm = df.select(M.cross_entropy("z", "y", smoothing=0.1).alias("ce")).collect()
    assert sm[1].ce == pytest.approx(math.log(2))


# --- loss runs: stopping, best epoch, plateau, warm-up ------------------------------

RUNS = {
    "improving": [5, 4, 3, 2],
    "flat": [1, 1, 1, 1, 1],
    "worse_then_better": [3, 4, 5, 2, 6],
    "exact_patience": [2, 3, 4],
    "one_epoch": [1],
}


@pytest.fixture()
def loss_log(spark):
    rows = [(run, e + 1, float(v)) for run, vs in RUNS.items() for e, v in enumerate(vs)]
    return spark.createDataFrame(rows, "run_id string, epoch int, val_loss double")


def test_early_stop_and_best(loss_log):
    st2 = {r.run_id: r for r in R.early_stop(loss_log, patience=2).collect()}
    assert st2["improving"].stop_epoch is None and st2["improving"].epochs_run == 4
    assert st2["flat"].stop_epoch == 3  # equal is not an improvement
    assert st2["exact_patience"].stop_epoch == 3
    assert st2["one_epoch"].stop_epoch is None and st2["one_epoch"].n_epochs == 1
    st3 = {r.run_id: r for r in R.early_stop(loss_log, patience=3).collect()}
    assert st3["worse_then_better"].stop_epoch is None
    best = {r.run_id: r.best_epoch for r in R.best_epoch(loss_log, patience=2).collect()}
    assert best["flat"] == 1 and best["improving"] == 4 and best["exact_patience"] == 1


def test_running_best_strict(loss_log):
    rb = {(r.run_id, r.epoch): r for r in R.running_best(loss_log).collect()}
    assert rb[("flat", 1)].improved and not rb[("flat", 2)].improved
    assert rb[("worse_then_better", 4)].improved and rb[("worse_then_better", 4)].best_before == 3.0


def test_plateau_two_cuts_in_a_row(spark):
    log = spark.createDataFrame([("r", 1, 1.0), ("r", 2, 1.0), ("r", 3, 1.0), ("s", 1, 1.0), ("s", 2, 0.99995)], "run_id string, epoch int, val_loss double")
    out = {(r.run_id, r.epoch): (r.lr, r.cut) for r in R.plateau_lr(log, patience=1, base_lr=1.0).collect()}
    assert out[("r", 1)] == (1.0, False)
    assert out[("r", 2)] == (0.5, True) and out[("r", 3)] == (0.25, True)
    assert out[("s", 2)] == (0.5, True)  # smaller than min_delta is no improvement


def test_warmup_schedule_ends(spark):
    steps = spark.createDataFrame([(10,)], "total_steps long")
    lr = {r.step: r.lr for r in R.warmup_schedule(steps, base_lr=1.0).collect()}
    assert lr[0] == 0.0 and lr[1] == pytest.approx(1.0) and lr[10] == 0.0 and lr[5] == pytest.approx(5 / 9)


def _simulate_plateau(vals, patience, base, factor, delta, min_lr):
    best, wait, lr, out = float("inf"), 0, base, []
    for v in vals:
        cut = False
        if v < best - delta:
            best, wait = v, 0
        else:
            wait += 1
            if wait >= patience and lr > min_lr:
                lr, wait, cut = max(lr * factor, min_lr), 0, True
        out.append((lr, cut))
    return out


def test_plateau_matches_state_machine(spark):
    import random

    rng = random.Random(5)
    runs = {}
    for r in range(12):
        n = rng.randint(1, 60)
        kind = r % 3
        if kind == 0:  # noisy
            vals = [round(rng.uniform(0, 1), 2) for _ in range(n)]
        elif kind == 1:  # slowly creeping down, steps smaller than min_delta
            vals = [1.0 - 3e-5 * i for i in range(n)]
        else:  # decreasing with plateaus and ties
            vals = [round(1.0 - 0.05 * (i // 4), 3) for i in range(n)]
        runs[f"r{r}"] = vals
    rows = [(k, i + 1, float(v)) for k, vs in runs.items() for i, v in enumerate(vs)]
    log = spark.createDataFrame(rows, "run_id string, epoch int, val_loss double")
    for patience, min_lr in ((1, 0.0), (2, 0.0), (3, 0.2)):
        got = {(r.run_id, r.epoch): (r.lr, r.cut) for r in R.plateau_lr(log, patience=patience, base_lr=1.0, min_lr=min_lr).collect()}
        for k, vs in runs.items():
            want = _simulate_plateau(vs, patience, 1.0, 0.5, 1e-4, min_lr)
            for i, (lr, cut) in enumerate(want):
                assert got[(k, i + 1)][1] == cut, (k, i + 1, patience)
                assert got[(k, i + 1)][0] == pytest.approx(lr), (k, i + 1, patience)


def _simulate_early_stop(vals, patience, delta, mode="min"):
    best, wait = (float("inf") if mode == "min" else float("-inf")), 0
    for i, v in enumerate(vals):
        better = v < best - delta if mode == "min" else v > best + delta
        if better:
            best, wait = v, 0
        else:
            wait += 1
            if wait >= patience:
                return i + 1
    return None


def test_early_stop_min_delta_matches_callback(spark):
    import random

    rng = random.Random(11)
    runs = {f"r{r}": [round(rng.uniform(0, 1), 3) if r % 2 else 1.0 - 4e-5 * i for i in range(rng.randint(1, 40))] for r in range(10)}
    rows = [(k, i + 1, float(v)) for k, vs in runs.items() for i, v in enumerate(vs)]
    log = spark.createDataFrame(rows, "run_id string, epoch int, val_loss double")
    for mode in ("min", "max"):
        got = {r.run_id: r.stop_epoch for r in R.early_stop(log, patience=3, mode=mode, min_delta=1e-4).collect()}
        want = {k: _simulate_early_stop(vs, 3, 1e-4, mode) for k, vs in runs.items()}
        assert got == want


def test_augmentation_defaults_to_train_rows(spark):
    from ledeframe.operators import augment as AU

    df = spark.createDataFrame([(i, "one two three four five six", "train" if i % 2 else "val") for i in range(40)], "id long, t string, split string")
    out = AU.delete_random_word(df, "t", "id", p=1.0, out="a").collect()
    assert all(r.a == r.t for r in out if r.split == "val")
    assert all(r.a != r.t for r in out if r.split == "train")
    toks = df.select("id", "split", F.split("t", " ").alias("w"))
    m = AU.mask_random_tokens(toks, "w", "id", row_p=1.0, token_p=1.0, out="m").collect()
    assert all(r.m == r.w for r in m if r.split == "val") and all(set(r.m) == {"[MASK]"} for r in m if r.split == "train")


def test_attention_mask_pad(spark):
    df = spark.createDataFrame([(1, [5, 0, 0], [[1.0, 0.0], [0.0, 1.0], [0.0, 1.0]])], "doc_id long, pos_ids array<int>, vecs array<array<double>>")
    out = VE.with_attention_pool(df, "vecs", [0.3, -0.2], 2, mask_pad=True).first()
    assert out.attn[1] == 0.0 and out.attn[2] == 0.0 and out.pooled == pytest.approx([1.0, 0.0])


def test_sweep_classifier(spark):
    from ledeframe.operators.train import sweep_classifier

    rows = [(i, float(i % 2), [float(i % 2) + 0.1 * (i % 7), 0.5 - 0.05 * (i % 5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, y double, x array<double>")
    model = sweep_classifier(df, 2, reg_params=(0.0, 0.5))
    assert len(model.validationMetrics) == 2


def test_foreign_model_scoring_matches_native(spark):
    import numpy as np

    from ledeframe.operators import train as T

    rows = [(i, [0.1 * (i % 5), -0.2 * (i % 3), 0.05 * i]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    w, b = [0.4, -0.3, 0.2], 0.1
    native = {r.id: r.p for r in T.batch_score(df, w, b).collect()}
    loads = []

    def load():
        loads.append(1)
        return np.array(w), b

    def predict(model, pdf):
        wv, bias = model
        z = np.stack(pdf["x"].to_numpy()) @ wv + bias
        return pdf[["id"]].assign(p=1.0 / (1.0 + np.exp(-z)))

    foreign = {r.id: r.p for r in T.score_foreign_model(df, load, predict, "id long, p double").collect()}
    assert foreign.keys() == native.keys()
    assert all(abs(foreign[k] - native[k]) < 1e-12 for k in native)


def test_csv_scan_of_plain_lines(spark, tmp_dir):
    p = os.path.join(tmp_dir, "plain.csv")
    _write(p, 'doc_id,title,category\n1,"a, b",political\n2,NA,non-political\n')
    rows = {r.doc_id: r for r in S.csv_scan(spark, p).collect()}
    assert rows[1].title == "a, b" and rows[2].title is None


def test_min_delta_pointer_doubling(spark):
    """No run is gathered; compare with the state machines."""
    import random

    rng = random.Random(23)
    runs = {}
    for r in range(8):
        n = rng.randint(1, 50)
        if r % 3 == 0:
            vals = [1.0 - 3e-5 * i for i in range(n)]  # creeping: sub-delta steps
        elif r % 3 == 1:
            vals = [round(1.0 - 0.013 * i + rng.uniform(0, 0.02), 4) for i in range(n)]
        else:
            vals = [round(rng.uniform(0, 1), 3) for _ in range(n)]
        runs[f"r{r}"] = vals
    rows = [(k, i + 1, float(v)) for k, vs in runs.items() for i, v in enumerate(vs)]
    log = spark.createDataFrame(rows, "run_id string, epoch int, val_loss double")
    got = {r.run_id: r.stop_epoch for r in R.early_stop(log, patience=3, min_delta=1e-4).collect()}
    assert got == {k: _simulate_early_stop(vs, 3, 1e-4) for k, vs in runs.items()}
    lr = {(r.run_id, r.epoch): (r.lr, r.cut) for r in R.plateau_lr(log, patience=2, base_lr=1.0).collect()}
    for k, vs in runs.items():
        for i, (want_lr, want_cut) in enumerate(_simulate_plateau(vs, 2, 1.0, 0.5, 1e-4, 0.0)):
            assert lr[(k, i + 1)][1] == want_cut and lr[(k, i + 1)][0] == pytest.approx(want_lr)
