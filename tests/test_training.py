"""Losses, gradients, windows, batches and training against plain Python."""

import math

import numpy as np
import pytest

from sonora.operators import model
from sonora.plans import components as C
from sonora.plans import training as T

LOSSES = [C.BceLoss(), C.BceLoss(3.0), C.FocalLoss(), C.FocalLoss(0.6, 0.0), C.DiceLoss(), C.TverskyLoss(0.3, 0.7, 0.5)]
RNG = np.random.RandomState(5)


def frames_of(spark, lengths):
    rows = [(k, i, [float(k), float(i), float(i % 3)], float(i % 4 == 0)) for k, n in lengths.items() for i in range(n)]
    return spark.createDataFrame(rows, "recording_id long, frame_idx int, features array<double>, label double").repartition(3)


@pytest.mark.parametrize("loss", LOSSES, ids=repr)
def test_loss_gradients(loss):
    x, y = RNG.normal(0, 2, (3, 7)), (RNG.rand(3, 7) > 0.6).astype(float)
    g, e = loss.gradient(x, y, loss.sums(x, y)), 1e-6
    for i, j in [(0, 0), (1, 3), (2, 6)]:
        up, down = x.copy(), x.copy()
        up[i, j] += e
        down[i, j] -= e
        assert g[i, j] == pytest.approx((loss(up, y) - loss(down, y)) / (2 * e), abs=1e-7)
    halves = loss.sums(x[:1], y[:1]) + loss.sums(x[1:], y[1:])
    assert loss.value(halves) == pytest.approx(loss(x, y))


def test_loss_values():
    x, y = np.array([[2.0, -1.0]]), np.array([[1.0, 0.0]])
    p = 1 / (1 + np.exp(-x))
    assert C.BceLoss()(x, y) == pytest.approx(-(math.log(p[0, 0]) + math.log(1 - p[0, 1])) / 2)
    assert C.DiceLoss(1.0)(x, y) == pytest.approx(1 - (2 * p[0, 0] + 1) / (p.sum() + 1 + 1))
    assert C.TverskyLoss(0.5, 0.5, 1.0)(x, y) == pytest.approx(1 - (p[0, 0] + 1) / (p[0, 0] + 0.5 * p[0, 1] + 0.5 * (1 - p[0, 0]) + 1))
    for make in (lambda: C.BceLoss(0.0), lambda: C.FocalLoss(2.0), lambda: C.FocalLoss(0.5, -1.0)):
        with pytest.raises(ValueError):
            make()
    for loss in LOSSES:  # saturated
        assert loss(np.full((1, 5), 800.0), np.ones((1, 5))) < 1e-6 and np.isfinite(loss(np.full((1, 5), -800.0), np.ones((1, 5))))


def test_backward_by_differences():
    weights, loss = model.random_weights(2, 3, seed=1), C.DiceLoss()
    x, y = RNG.rand(2, 2, 15), (RNG.rand(2, 15) > 0.5).astype(float)
    logits, inputs = model.forward(weights, x)
    assert logits.shape == (2, 15)
    grads = model.backward(weights, inputs, loss.gradient(logits, y, loss.sums(logits, y)))
    for layer, part in [(0, 0), (1, 0), (2, 1), (3, 0)]:
        a = weights[layer][part]
        at = tuple(RNG.randint(n) for n in a.shape)
        kept, found = a[at], []
        for e in (1e-6, -1e-6):
            a[at] = kept + e
            found.append(loss(model.forward(weights, x)[0], y))
        a[at] = kept
        assert grads[layer][part][at] == pytest.approx((found[0] - found[1]) / 2e-6, abs=1e-6)


def test_windows_are_whole(spark):
    lengths = {1: 23, 2: 9, 3: 10, 4: 0}
    got = {(r["recording_id"], r["start_frame"]): r for r in T.training_windows(frames_of(spark, lengths), 10, 4).collect()}
    assert set(got) == {(k, s) for k, n in lengths.items() for s in range(0, n - 9, 4)}
    for (k, s), r in got.items():
        assert r["features"] == [[float(k)] * 10, [float(i) for i in range(s, s + 10)], [float(i % 3) for i in range(s, s + 10)]]
        assert r["labels"] == [float(i % 4 == 0) for i in range(s, s + 10)]
    with pytest.raises(ValueError):
        T.training_windows(frames_of(spark, lengths), 10, 11)


def test_batches(spark):
    rows = spark.createDataFrame([(k, s) for k in range(7) for s in range(5)], "recording_id long, start_frame int")
    got = T.batched(rows, 8, seed=3).collect()
    sizes = [sum(r["batch"] == b for r in got) for b in range(5)]
    assert sizes == [8, 8, 8, 8, 3] and len({(r["recording_id"], r["start_frame"]) for r in got}) == 35
    assert sorted({r["batch"] for r in T.batched(rows, 8, seed=3, drop_last=True).collect()}) == [0, 1, 2, 3]
    assert {tuple(r) for r in T.batched(rows, 8, seed=4).collect()} != {tuple(r) for r in got}


def data_module(spark, **more):
    lengths = {k: 40 + 7 * k for k in range(12)} | {99: 5}
    recs = spark.createDataFrame([(k, n * 0.008) for k, n in lengths.items()], "recording_id long, duration_s double")
    return T.DataModule(recs, frames_of(spark, lengths), C.SnrExtractor(32000, n_bands=3), window_s=0.16, window_hop_s=0.08, batch_size=4, **more)


def test_data_module(spark):
    data = data_module(spark)
    with pytest.raises(RuntimeError):
        data.train_batches()
    data.setup("test")
    assert data.split is None
    data.setup("fit")
    parts = {n: {r["recording_id"] for r in data.part(n).collect()} for n in ("train", "val", "test")}
    assert T.disjoint(data.split) and sum(map(len, parts.values())) == 12 and all(parts.values())
    got = data.train_batches().collect()
    assert {r["recording_id"] for r in got} <= parts["train"] and len(got) % 4 == 0
    assert {r["recording_id"] for r in data.val_batches().collect()} == parts["val"]
    named = {"train": data.train_recordings, "val": data.val_recordings, "test": data.test_recordings}
    assert {n: {r["recording_id"] for r in d.collect()} for n, d in named.items()} == parts and data.n_recordings >= 12
    for name, held in (("train", data.train_dataset), ("val", data.val_dataset)):
        keys = [(r["recording_id"], r["start_frame"]) for r in held.collect()]
        assert len(set(keys)) == len(keys) and {k for k, _ in keys} == parts[name]
    assert {(r["recording_id"], r["start_frame"]) for r in got} <= {(r["recording_id"], r["start_frame"]) for r in data.train_dataset.collect()}
    none = data_module(spark, train_frac=1.0, val_frac=0.0, test_frac=0.0)
    none.setup()
    assert none.val_batches() is None and none.val_dataset is None
    for bad in ({"train_frac": 0.5}, {"train_frac": 0.0, "val_frac": 0.8}, {"batch_size": 0}):
        with pytest.raises((ValueError, TypeError)):
            T.DataModule(data.recordings, data.frames, data.extractor, **bad)
    with pytest.raises(ValueError):
        T.DataModule(data.recordings.filter("recording_id = 99"), data.frames, data.extractor).setup()


@pytest.mark.parametrize("loss", [C.BceLoss(2.0), C.FocalLoss(), C.DiceLoss(), C.TverskyLoss()], ids=repr)
def test_training_is_that_of_one_machine(spark, loss):
    x, y = RNG.rand(10, 2, 12), (RNG.rand(10, 12) > 0.5).astype(float)
    rows = [(x[i].tolist(), y[i].tolist(), i // 4) for i in range(10)]
    df = spark.createDataFrame(rows, "features array<array<double>>, labels array<double>, batch long").repartition(5)
    trained, history = C.TinySegCnn(2, 12, 3, seed=2), C.MetricsHistory()
    got = T.fit(trained, df, loss, epochs=3, lr=0.01, val_batches=df, callbacks=[history, C.LoggingCallback()], seed=7)
    weights, state, rng, losses = model.random_weights(2, 3, 2), {}, np.random.RandomState(7), []
    for _ in range(3):
        seen = []
        for b in rng.permutation([0, 1, 2]):
            part = slice(4 * b, min(10, 4 * b + 4))
            logits, inputs = model.forward(weights, x[part])
            sums = loss.sums(logits, y[part])
            seen.append((loss.value(sums), sums[0]))
            weights = model.adam(weights, model.backward(weights, inputs, loss.gradient(logits, y[part], sums)), state, 0.01)
        losses.append(sum(a * n for a, n in seen) / sum(n for _, n in seen))
    for a, b in zip(trained.weights, weights):
        assert a[0] == pytest.approx(b[0], abs=1e-9) and a[1] == pytest.approx(b[1], abs=1e-9)
    assert history.history["train_loss"] == pytest.approx(losses) and len(history.history["val_f1"]) == 3
    want, sizes = [], []
    for b in range(3):
        part = slice(4 * b, min(10, 4 * b + 4))
        logits, _ = model.forward(weights, x[part])
        tp, fp, fn = (int(c.sum()) for c in ((logits >= 0) & (y[part] == 1), (logits >= 0) & (y[part] == 0), (logits < 0) & (y[part] == 1)))
        p, r = tp / (tp + fp) if tp + fp else 0, tp / (tp + fn) if tp + fn else 0
        want.append((loss(logits, y[part]), p, r, 2 * p * r / (p + r) if p + r else 0))
        sizes.append(len(y[part]))
    assert [got[f"val_{k}"] for k in ("loss", "precision", "recall", "f1")] == pytest.approx(np.average(want, axis=0, weights=sizes).tolist())
    with pytest.raises(ValueError):
        T.fit(trained, df, loss, lr=0.0)


def test_an_epoch_is_one_round_of_jobs(spark):
    """As many jobs for twelve batches as for three, with workers that have no row of a batch, and nothing left on disk."""
    import os

    from sonora.sources.storage import shared_dir

    tracker, jobs = spark.sparkContext.statusTracker(), []
    for n in (3, 12):
        rows = [(RNG.rand(2, 12).tolist(), [float(v > 0.5) for v in RNG.rand(12)], 10 * (i // 2)) for i in range(2 * n)]
        df = spark.createDataFrame(rows, "features array<array<double>>, labels array<double>, batch long")
        spark.sparkContext.setJobGroup(f"fit {n}", "training")
        T.fit(C.TinySegCnn(2, 12, 3, seed=2), df, epochs=2, lr=0.01, workers=4)
        jobs.append(len(tracker.getJobIdsForGroup(f"fit {n}")))
    spark.sparkContext.setJobGroup("other", "")
    assert jobs[0] == jobs[1]
    folder = shared_dir(spark).removeprefix("file://") + "/sonora"
    before = set(os.listdir(folder))
    T.fit(C.TinySegCnn(2, 12, 3, seed=2), df, epochs=1, lr=0.01, workers=1)
    assert len(set(os.listdir(folder)) - before) == 1  # the batches' numbers


def test_best_weights_and_history(spark, tmp_path):
    trained, path = C.TinySegCnn(2, 12, 3, seed=2), f"{tmp_path}/best"
    best, history = C.SaveBestModel(spark, path), C.MetricsHistory()
    for epoch, f1 in enumerate([0.5, float("nan"), None, 0.5, 0.7, 0.6]):
        metrics = {"train_loss": 1.0} | ({} if f1 is None else {"val_f1": f1})
        trained.weights = [(w, np.full_like(b, epoch)) for w, b in trained.weights]
        for c in (best, history):
            c.on_epoch_end(epoch, metrics, trained)
    assert best.best == 0.7 and C.read_weights(spark.read.parquet(path))[0][1][0] == 4
    assert len(history.history["val_f1"]) == 5 and history.frame(spark).filter("metric = 'train_loss'").count() == 6
    with pytest.raises(ValueError):
        C.SaveBestModel(spark, path, mode="best")
