"""Operators over recordings that hold most of the rows, against plain Python."""

import os
import random
import re

import numpy as np
import pytest

from sonora.operators import matching, model, scan, windows
from sonora.plans import registry


def gathers(df):
    return "collect_list" in df._jdf.queryExecution().analyzed().toString()


def plain(pairs):
    """The greedy walk of all pairs, recording by recording."""
    want = []
    for rec in sorted({x[0] for x in pairs}):
        used, rank = set(), 0
        for iou, g, p in sorted((-x[3], x[1], x[2]) for x in pairs if x[0] == rec):
            if not used & {("g", g), ("p", p)}:
                used |= {("g", g), ("p", p)}
                want.append((rec, rank, g, p, -iou))
                rank += 1
    return want


@pytest.mark.parametrize("dense, chain", [(1 << 20, 64), (1 << 20, 1), (6, 64), (0, 64)])
def test_iou_match_is_greedy(spark, monkeypatch, dense, chain):
    """As arrays, with and without a walk of what long chains leave, by rounds, and some recordings by either."""
    monkeypatch.setattr(matching, "DENSE", dense)
    monkeypatch.setattr(matching, "CHAIN", chain)
    rng = random.Random(4)
    pairs = [(1, g, p, rng.choice([0.25, 0.5, 0.75, 1.0])) for g in range(60) for p in range(60) if rng.random() < 0.2]
    pairs += [(2, k // 2, (k + 1) // 2, 0.9 - k / 100) for k in range(6)] + [(3, 0, 0, 0.5), (3, 0, 0, 0.5)]
    got = matching.iou_match(spark.createDataFrame(pairs, "recording_id long, gi long, pi long, iou double"))
    assert sorted(map(tuple, got.collect())) == plain(pairs)
    assert not gathers(got)


def spans(rng, n, long):
    """Intervals in clusters with gaps between them, some long, of all magnitudes, and odd ones."""
    out = []
    for i in range(n):
        a = rng.randint(0, 25) * 10 + rng.uniform(0, 6)
        out.append((a, a + (rng.uniform(0, 60) if rng.random() < long else rng.choice([0.0, 0.01, 0.5, rng.uniform(0, 4)]))))
    return out


@pytest.mark.parametrize("dense", [1 << 20, 40, 3])
@pytest.mark.parametrize("threshold", [0.01, 0.3])
def test_binned_pairs_and_segments(spark, monkeypatch, many_ranges, dense, threshold):
    """Pairs of all intervals against the binned join; matches of a recording in segments, dense ones by rounds."""
    monkeypatch.setattr(matching, "DENSE", dense)
    rng = random.Random(dense)
    held = {k: (spans(rng, n, long), spans(rng, n, long)) for k, n, long in ((1, 150, 0.0), (2, 40, 0.3), (3, 1, 0.0), (4, 0, 0.0))}
    rows = [[(k, i, a, b) for k, v in held.items() for i, (a, b) in enumerate(v[side])] for side in (0, 1)]
    odd = [(5, 0, None, 2.0), (5, 1, 3.0, 2.0), (5, 2, float("nan"), 2.0), (5, 3, -float("inf"), float("inf")), (None, 4, 0.0, 1.0)]
    gt, pred = (spark.createDataFrame(r + odd, f"recording_id long, {name} long, onset double, offset double").repartition(3) for r, name in zip(rows, ("gi", "pi")))
    pairs = matching.iou_pairs(gt, pred, threshold)
    want = []
    for k, g, a, b in rows[0]:
        for j, p, c, d in rows[1]:
            both = max(0.0, min(b, d) - max(a, c))
            union = (b - a) + (d - c) - both
            if k == j and union > 0 and both / union >= threshold:
                want.append((k, g, p, both / union))
    assert sorted((r["recording_id"], r["gi"], r["pi"], r["iou"]) for r in pairs.collect()) == sorted(want) and len(want) > 20
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "(_bin" in plan
    assert sorted(map(tuple, matching.iou_match(pairs).collect())) == plain(want)


@pytest.mark.parametrize("small", [256, 90, 0])
@pytest.mark.parametrize("threshold", [0.0, 0.1])
def test_aligned_intervals(spark, monkeypatch, small, threshold):
    """Every interval once, with the partner that the greedy match of all pairs gives it: recordings as arrays, by bins, and some by either."""
    monkeypatch.setattr(matching, "SMALL", small)
    rng = random.Random(9)
    held = {k: (spans(rng, n, 0.2), spans(rng, m, 0.2)) for k, n, m in [(1, 50, 60), (2, 30, 20), (3, 1, 0), (4, 0, 2), *((k, 3, 4) for k in range(10, 60))]}
    rows = [[(k, i, a, b) for k, v in held.items() for i, (a, b) in enumerate(v[side])] for side in (0, 1)]
    odd = [(None, 0, 0.0, 1.0), (None, 1, 0.0, 1.0)] + ([(5, 0, None, 2.0), (5, 1, 3.0, 2.0), (5, 2, float("nan"), 2.0), (5, 3, -float("inf"), float("inf")), (5, 4, 0.0, 1.0)] if threshold else [])
    gt, pred = (spark.createDataFrame(r + odd, f"recording_id long, {name} long, onset double, offset double").repartition(3) for r, name in zip(rows, ("gi", "pi")))
    got = matching.aligned(gt, pred, threshold)
    found = matching.iou_match(matching.iou_pairs(gt, pred, threshold))
    same = lambda df: sorted(map(repr, df.collect()))
    assert same(matching.matched(got)) == same(found) and found.count() >= 20
    for side, all_ in (("g", gt), ("p", pred)):
        assert same(matching.alone(got, side)) == same(matching.unmatched(all_, found, f"{side}i"))
        assert got.filter(f"{side}i is not null").count() == all_.count()
    assert same(matching.aligned_counts(got)) == same(matching.event_counts(gt, pred, found))
    for tolerance in (None, 2000.0):
        assert same(matching.aligned_errors(got, tolerance)) == same(matching.boundary_errors(gt, pred, found, tolerance))


@pytest.mark.parametrize("name", ["missed_events", "boundary_errors", "event_metrics", "boundary_accuracy"])
def test_matches_of_small_recordings_need_no_joins(spark, name):
    """Neither pairs nor matches are joined where recordings are small, nor are percentiles aggregated in maps."""
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    plan = registry.QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "percentile" not in plan and "_bin" not in plan


def test_rows_of_recordings_are_not_broadcast(spark):
    recs = spark.createDataFrame([(k, 60.0) for k in range(5)], "recording_id long, duration_s double")
    counts = spark.createDataFrame([(1, 2, 2, 1, 1, 1)], "recording_id long, n_gt long, n_pred long, tp long, fp long, fn long")
    errors = spark.createDataFrame([(1, 0, 0, 5.0, -5.0)], "recording_id long, gi long, pi long, onset_error_ms double, offset_error_ms double")
    frames = spark.createDataFrame([(2, 0.9, 1.0)], "recording_id long, prob double, label double")
    got = matching.evaluation_rows(recs, counts, errors, frames)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r["recording_id"], r["tp"], r["frame_tp"], r["n_matches"]) for r in got.orderBy("recording_id").collect()] == [(0, 0, 0, 0), (1, 1, 0, 1), (2, 0, 1, 0), (3, 0, 0, 0), (4, 0, 0, 0)]


def test_labels_by_ranges_of_so_many_rows(spark, monkeypatch):
    """Ranges are bounded by rows, not by the bytes of what is shuffled."""
    seen, held = [], scan.ranged

    def kept(df, keys, order, ranges=None):
        seen.append((df.count(), ranges))
        return held(df, keys, order, ranges)

    monkeypatch.setattr(scan, "ranged", kept)
    monkeypatch.setattr(scan, "ROWS", 500, raising=False)
    frames = spark.range(900).selectExpr("id % 3 AS recording_id", "id AS frame_idx", "double(id div 3) AS time_s")
    marks = spark.range(4000).selectExpr("id AS recording_id", "10.0D AS onset", "19.0D AS offset")
    got = windows.frame_labels(frames, marks)
    assert seen == [(8900, 18)]
    assert got.columns == ["recording_id", "frame_idx", "time_s", "label"] and got.count() == 900
    assert sorted((r["recording_id"], r["time_s"]) for r in got.filter("label = 1").collect()) == [(k, float(t)) for k in range(3) for t in range(10, 20)]


@pytest.mark.parametrize("chunk, width, hop", [(12, 10, 4), (1024, 7, 7)])
def test_sliding_predict_by_runs(spark, monkeypatch, chunk, width, hop):
    monkeypatch.setattr(model, "CHUNK", chunk, raising=False)
    rng = np.random.RandomState(2)
    weights = model.random_weights(2, 3, seed=5)
    recs = {1: rng.rand(75, 2), 2: rng.rand(4, 2), 3: rng.rand(10, 2), None: rng.rand(13, 2)}
    rows = [(k, 5 + 2 * i, x.tolist()) for k, xs in recs.items() for i, x in enumerate(xs)]
    random.Random(1).shuffle(rows)
    got = model.sliding_predict(spark.createDataFrame(rows, "recording_id long, frame_idx int, features array<double>"), weights, width, hop)
    assert got.columns == ["recording_id", "frame_idx", "prob"] and not gathers(got)
    found = {(r["recording_id"], r["frame_idx"]): r["prob"] for r in got.collect()}
    assert len(found) == len(rows)
    for k, xs in recs.items():
        x = np.pad(xs.T, ((0, 0), (0, max(0, width - len(xs)))), mode="edge")
        total, seen = np.zeros(x.shape[1]), np.zeros(x.shape[1])
        for s in range(0, x.shape[1] - width + 1, hop):
            total[s : s + width] += 1 / (1 + np.exp(-model.forward(weights, x[None, :, s : s + width])[0][0]))
            seen[s : s + width] += 1
        for i in range(len(xs)):
            assert found[k, 5 + 2 * i] == pytest.approx(total[i] / max(seen[i], 1))


def test_running_values_need_no_single_task(spark):
    rng = random.Random(8)
    recs = [(k, rng.randint(0, 9)) for k in range(400)]
    got = windows.split_by_windows(spark.createDataFrame(recs, "place long, n_windows long").repartition(7), 0.6, 0.2, "place")
    total, a, b, want = sum(n for _, n in recs), 0, 0, []
    for k, n in recs:
        if n:
            split = "train" if a < total * 0.6 else "val" if b < total * 0.2 else "test"
            a, b = a + n, b + (0 if split == "train" else n)
            want.append((k, n, split))
    assert sorted(map(tuple, got.select("place", "n_windows", "split").collect())) == want
    epochs = [(k, None if k == 3 else float("nan") if k == 5 else rng.gauss(k / 100, 1)) for k in range(300)]
    best = windows.best_epochs(spark.createDataFrame(epochs, "epoch long, f1 double").repartition(7), "f1", "epoch")
    top, want = None, []
    for k, v in epochs:
        if v is not None and v == v and (top is None or v > top):
            top = v
            want.append(k)
    assert sorted(r["epoch"] for r in best.collect()) == want
    # A window without a partition would be sorted in one task.
    for df in (got, best):
        assert not re.search(r"windowspecdefinition\((place|epoch)#", df._jdf.queryExecution().analyzed().toString())
