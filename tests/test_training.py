"""Training: sweeps, mini-batches, the hidden layer, checkpoints."""

import random
import shutil

import numpy as np
import pytest

from ledeframe.operators import blocks as B
from ledeframe.operators import runlog as R
from ledeframe.operators import train as T
from ledeframe.sources import sinks as K

DIM = 5


def rows(n, seed=1, val=0.25):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        x = [rnd.gauss(0, 1) for _ in range(DIM)]
        y = int(x[0] - 0.5 * x[2] + rnd.gauss(0, 0.5) > 0)
        out.append((i, "val" if rnd.random() < val else "train", y, x))
    return out


@pytest.fixture(scope="module")
def feats(spark):
    return spark.createDataFrame(rows(300), "doc_id long, split string, y int, x array<double>").repartition(4).cache()


def same_log(a, b):
    assert len(a) == len(b)
    for r, s in zip(a, b):
        assert r.keys() == s.keys()
        for k in r:
            assert r[k] == s[k] or abs(r[k] - s[k]) < 1e-9, (k, r[k], s[k])


CONFIGS = [
    T.TrainConfig(max_epochs=7, lr=0.5, patience=3, l2=0.0, run_id="a"),
    T.TrainConfig(max_epochs=3, lr=1.5, patience=3, l2=0.1, clip=None, run_id="b"),
    T.TrainConfig(max_epochs=7, lr=-0.5, patience=1, l2=0.0, clip=None, warmup_share=0.0, run_id="c"),
]


def test_a_sweep_is_the_runs_on_their_own_in_one_scan_an_epoch(feats, monkeypatch):
    scans = []
    plain = B.block_pass
    monkeypatch.setattr(T, "block_pass", lambda f, model, *a, **k: scans.append(model.k) or plain(f, model, *a, **k))
    together = T.train_sweep(feats, DIM, CONFIGS)
    epochs = [len(r.log) for r in together]
    assert scans[0] == 3 and len(scans) == 1 + max(epochs)
    assert scans[1:] == [sum(n >= e for n in epochs) for e in range(1, max(epochs) + 1)]  # a run that ended leaves the block
    assert epochs[2] < 7  # stopped by its patience
    for cfg, res in zip(CONFIGS, together):
        alone = T.train_epochs(feats, DIM, cfg)
        same_log(res.log, alone.log)
        assert (res.stop_epoch, res.best_epoch) == (alone.stop_epoch, alone.best_epoch)


def by_hand(data, cfg, order):
    """Mini-batch epochs in plain numpy; ``order``: epoch -> train ids in shuffled order."""
    x = {i: np.array([*v, 1.0]) for i, _, _, v in data}
    y = {i: t for i, _, t, _ in data}
    w, losses, done = np.zeros(DIM + 1), [], 0
    n = sum(s == "train" for _, s, _, _ in data)
    batches = -(-n // cfg.batch_size)
    steps = -(-batches // cfg.accumulate)
    factors = T.lr_factors(steps * cfg.max_epochs, cfg.warmup_share)
    for e in range(1, cfg.max_epochs + 1):
        ids, total = order[e], 0.0
        cut = [ids[k : k + cfg.batch_size] for k in range(0, n, cfg.batch_size)]
        for s in range(steps):
            mean, some = np.zeros(DIM + 1), cut[s * cfg.accumulate : (s + 1) * cfg.accumulate]
            for batch in some:
                p = {i: 1 / (1 + np.exp(-x[i] @ w)) for i in batch}
                mean += sum((p[i] - y[i]) * x[i] for i in batch) / len(batch) / len(some)
                total += np.mean([-(y[i] * np.log(p[i] + 1e-7) + (1 - y[i]) * np.log(1 - p[i] + 1e-7)) for i in batch])
            mean[:DIM] += cfg.l2 * w[:DIM]
            mean *= min(1.0, cfg.clip / (np.sqrt((mean**2).sum()) + 1e-6))
            w, done = w - cfg.lr * factors[done] * mean, done + 1
        losses.append(total / batches)
    return w, losses


@pytest.mark.parametrize("size,k", [(32, 2), (50, 1), (7, 5), (1000, 1)])
def test_minibatches_by_hand_and_for_any_partitioning(spark, feats, size, k):
    from ledeframe.operators.order import shuffled_batches

    cfg = T.BatchConfig(max_epochs=2, lr=0.3, l2=0.02, batch_size=size, accumulate=k, patience=9, run_id="m")
    data = rows(300)
    train = feats.where("split = 'train'")
    order = {e: [r["doc_id"] for r in shuffled_batches(train, "doc_id", size, e, cfg.seed).orderBy("position").collect()] for e in (1, 2)}
    assert order[1] != order[2] and sorted(order[1]) == sorted(order[2])
    w, losses = by_hand(data, cfg, order)
    if size != 32:
        results = [T.train_minibatches(feats, "doc_id", DIM, cfg)]
    else:
        results = [T.train_minibatches(feats.repartition(n), "doc_id", DIM, cfg) for n in (1, 9)]
    for res in results:
        assert np.allclose([*res.weights[-1][0], res.weights[-1][1]], w, atol=1e-10)
        assert np.allclose([r["train_loss"] for r in res.log], losses, atol=1e-10)


@pytest.mark.parametrize("steps", [1, 2, 1000])
def test_steps_run_in_stretches(feats, monkeypatch, steps):
    """A job runs a stretch of steps, not one; how many makes no difference to the result."""
    from ledeframe.operators.order import shuffled_batches

    cfg = T.BatchConfig(max_epochs=2, lr=0.3, l2=0.02, batch_size=16, accumulate=3, patience=9, run_id="m")
    order = {e: [r["doc_id"] for r in shuffled_batches(feats.where("split = 'train'"), "doc_id", 16, e, cfg.seed).orderBy("position").collect()] for e in (1, 2)}
    w, losses = by_hand(rows(300), cfg, order)
    passes, plain = [], B.block_pass
    monkeypatch.setattr(T, "block_pass", lambda *a, **k: passes.append(1) or plain(*a, **k))
    if steps < 1000:
        monkeypatch.setattr(T, "STRETCH", steps * 16 * 3 * DIM)
    res = T.train_minibatches(feats, "doc_id", DIM, cfg)
    assert np.allclose([*res.weights[-1][0], res.weights[-1][1]], w, atol=1e-10)
    assert np.allclose([r["train_loss"] for r in res.log], losses, atol=1e-10)
    assert steps == 1 or len(passes) == 2  # the validation rows, once per epoch


def test_the_gradient_of_the_hidden_layer(spark):
    """Against differences of the loss."""
    data = rows(40, seed=3, val=0.0)
    df = spark.createDataFrame(data, "doc_id long, split string, y int, x array<double>").repartition(3)
    net = B.HiddenLayer(DIM, 3)
    params = T.start_weights(DIM, 3, seed=9) + 0.01
    got = B.block_pass(df, net, params)["train"]
    x, y, one = np.array([r[3] for r in data]), np.array([float(r[2]) for r in data]), np.ones(40)
    loss = lambda q: net.sums(q, x, y, one)[net.width]
    slopes = [(loss(params + h) - loss(params - h)) / 2e-6 for h in 1e-6 * np.eye(net.width)]
    assert np.allclose(got["gradient"], slopes, atol=1e-5) and got["n"] == 40
    res = T.train_network(df, DIM, 3, T.TrainConfig(max_epochs=40, lr=1.0, patience=50, clip=5.0, warmup_share=0.0), start=params)
    assert res.log[-1]["train_loss"] < 0.5 * res.log[0]["train_loss"]
    scored = T.network_score(df, DIM, 3, res.params[-1]).collect()
    want = net.probability(res.params[-1], np.array([r["x"] for r in scored]))
    assert np.allclose([r["p"] for r in scored], want)


def test_no_validation_rows_never_stop_a_run(spark):
    df = spark.createDataFrame([("train", [1.0, 0.0], 1), ("train", [0.0, 1.0], 0)], "split string, x array<double>, y int")
    cfg = T.TrainConfig(max_epochs=5, patience=2)
    res = T.train_epochs(df, 2, cfg)
    assert res.stop_epoch is None and len(res.log) == 5 and res.best_epoch is None
    assert R.early_stop(T.log_frame(spark, res), patience=2).first()["stop_epoch"] is None
    batches = T.train_minibatches(df.selectExpr("*", "x[0] AS doc_id"), "doc_id", 2, T.BatchConfig(max_epochs=3, patience=1, batch_size=1))
    assert len(batches.log) == 3 and batches.stop_epoch is None
    assert [len(r.log) for r in T.train_sweep(df, 2, [cfg])] == [5]


def test_no_rows_at_all(spark):
    none = spark.createDataFrame([], "doc_id long, split string, x array<double>, y int")
    assert T.train_sweep(none, 2, [T.TrainConfig(max_epochs=2)])[0].log[0]["train_loss"] is None
    res = T.train_minibatches(none, "doc_id", 2, T.BatchConfig(max_epochs=2))
    assert [r["train_loss"] for r in res.log] == [None, None] and res.weights[-1] == ([0.0, 0.0], 0.0)


class Cut(Exception):
    pass


def cut_after(n):
    def listener(epoch, w, b, metrics):
        if epoch == n:
            raise Cut

    return listener


def test_a_cut_run_goes_on_where_it_was(spark, feats, tmp_path):
    cfg = T.TrainConfig(max_epochs=9, lr=0.7, patience=3, clip=None, warmup_share=0.2, l2=0.01, run_id="r")
    whole = T.train_epochs(feats, DIM, cfg)
    store = lambda: K.Checkpoints(spark, f"{tmp_path}/run")
    assert store().newest() is None
    for n in (2, 4):
        with pytest.raises(Cut):
            T.train_epochs(feats, DIM, cfg, on_epoch_end=cut_after(n), checkpoints=store())
    res = T.train_epochs(feats, DIM, cfg, checkpoints=store())
    same_log(res.log, whole.log)
    assert (res.stop_epoch, res.best_epoch) == (whole.stop_epoch, whole.best_epoch)
    assert np.allclose(res.weights[-1][0], whole.weights[-1][0])
    again = T.train_epochs(feats, DIM, cfg, checkpoints=store())  # nothing left to do
    same_log(again.log, whole.log)
    assert len(list((tmp_path / "run" / "states").iterdir())) == 2


def test_torn_checkpoints_are_passed_over(spark, feats, tmp_path):
    cfg = T.TrainConfig(max_epochs=6, lr=0.5, patience=9, run_id="r")
    whole = T.train_epochs(feats, DIM, cfg)
    store = K.Checkpoints(spark, f"{tmp_path}/run", keep=3)
    with pytest.raises(Cut):
        T.train_epochs(feats, DIM, cfg, on_epoch_end=cut_after(3), checkpoints=store)
    names = sorted(p.name for p in (tmp_path / "run" / "entries").iterdir() if not p.name.startswith("."))
    (tmp_path / "run" / "states" / names[-1] / "_SUCCESS").unlink()  # the third was not finished
    shutil.copytree(tmp_path / "run" / "states" / names[0], tmp_path / "run" / "states" / "00000009-feed")  # a state without an entry
    assert store.newest()["epoch"] == 2
    same_log(T.train_epochs(feats, DIM, cfg, checkpoints=store).log, whole.log)
