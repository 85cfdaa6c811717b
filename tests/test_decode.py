"""Decoding over ranges against a walk through each recording's frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sonora.operators import decode, windows

HOP = 0.25  # exact in binary, so times compare


def walk(frames, rule):
    """Masks and intervals of one recording's (time, prob), frame by frame."""
    inside, mask = False, []
    for _, p in frames:
        p = -1.0 if p is None or math.isnan(p) else p
        enters, leaves = p >= rule.enter, 0 <= p <= rule.exit
        mask.append(enters or inside)
        inside = False if leaves else True if enters else inside
    return mask


def runs(frames, mask):
    out = []
    for i, (t, _) in enumerate(frames):
        if mask[i] and i and mask[i - 1]:
            out[-1][1] = t
        elif mask[i]:
            out.append([t, t])
    return out


def merge(spans, gap):
    out = []
    for a, b in spans:
        if out and a - out[-1][1] < gap:
            out[-1][1] = b
        else:
            out.append([a, b])
    return out


def decoded(frames, rule):
    spans = [s for s in merge(runs(frames, walk(frames, rule)), rule.min_gap_s) if s[1] - s[0] >= rule.min_duration_s]
    return [(max(a - rule.pad_s, frames[0][0]), min(b + rule.pad_s, frames[-1][0])) for a, b in spans]


def recordings(seed):
    rng = random.Random(seed)
    level = rng.choice([[0.5], [0.5, 0.5, 0.5, 0.9, 0.1], [0.9, 0.5, 0.5, 0.5], [0.1, 0.9], [0.5, None, float("nan"), 0.9, 0.1]])
    sizes = {"hot": 400, "one": 1, "two": 2, "mid": 60, None: 150, "z": 90}
    out = {}
    for k, n in sizes.items():
        long = [rng.choice(level) for _ in range(n)]
        if k == "hot" and seed % 2:
            long[50:300] = [0.5] * 250  # undecided over several ranges
        out[k] = [(i * HOP, p) for i, p in enumerate(long)]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_whole_decoder(spark, many_ranges, seed):
    rng = random.Random(seed)
    held = recordings(seed)
    rule = decode.Hysteresis(0.8, 0.2, rng.choice([0.0, 0.5]), rng.choice([0.0, 0.3, 0.6, 1.1]), rng.choice([0.0, 0.25, 5.0]))
    rows = [(k, i, t, p) for k, f in held.items() for i, (t, p) in enumerate(f)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, time_s double, prob double").repartition(4)
    got = decode.hysteresis_decode(df, rule, ["k"], "i")
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((k, *s) for k, f in held.items() for s in decoded(f, rule)), key=repr)
    masked = decode.hysteresis_mask(df, rule, ["k"], "i")
    assert {(r["k"], r["i"]): r["mask"] for r in masked.collect()} == {(k, i): m for k, f in held.items() for i, m in enumerate(walk(f, rule))}
    found = decode.mask_intervals(masked, ["k"], "i")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((k, *s) for k, f in held.items() for s in runs(f, walk(f, rule))), key=repr)
    merged = decode.merge_gaps(found, 0.6, ["k"])
    assert sorted(map(tuple, merged.collect()), key=repr) == sorted(((k, *s) for k, f in held.items() for s in merge(runs(f, walk(f, rule)), 0.6)), key=repr)


def test_two_keys_none_and_no_frames(spark, many_ranges):
    rule = decode.Hysteresis(0.8, 0.2, 0.0, 0.0)
    f = recordings(3)["hot"]
    df = spark.createDataFrame([(k, b, i, t, p) for k in "xy" for b in (1, 2) for i, (t, p) in enumerate(f)], "k string, band int, i int, time_s float, prob double")
    got = decode.hysteresis_decode(df, rule, ["k", "band"], "i").collect()
    assert sorted(map(tuple, got)) == sorted((k, b, *s) for k in "xy" for b in (1, 2) for s in decoded(f, rule))
    alone = df.filter("k = 'x' and band = 1").select("i", "time_s", "prob")
    assert sorted(map(tuple, decode.hysteresis_decode(alone, rule, [], "i").collect())) == sorted(decoded(f, rule))
    assert decode.hysteresis_decode(df.limit(0), rule, ["k"], "i").count() == 0
    assert decode.merge_gaps(df.limit(0).select("k", F.col("time_s").alias("onset"), F.col("time_s").alias("offset")), 1.0, ["k"]).count() == 0


def test_labels_by_scan(spark, many_ranges):
    """Nested, touching, equal, empty and odd intervals; a recording over many ranges; frames' own columns stay."""
    rng = random.Random(5)
    frames = [(k, i, i * 0.5, [float(i)]) for k, n in (("a", 300), ("b", 5), (None, 9), ("c", 40)) for i in range(n)]
    spans = [("a", float(x), x + rng.choice([0.0, 0.5, 1.0, 30.0])) for x in (rng.randint(0, 280) / 2 for _ in range(25))] + [("a", 20.0, 19.0), ("b", 1.0, 1.0), ("b", 1.0, 1.0), ("b", None, 2.0), (None, 0.0, 9.0), ("z", 0.0, 9.0), ("c", 0.0, 100.0), ("c", 3.0, 4.0)]
    df = spark.createDataFrame(frames, "recording_id string, frame_idx int, time_s double, x array<double>").repartition(3)
    out = windows.frame_labels(df, spark.createDataFrame(spans, "recording_id string, onset double, offset double"))
    assert out.columns == [*df.columns, "label"] and "Join" not in out._jdf.queryExecution().executedPlan().toString().replace("BroadcastHashJoin [_part", "")
    for r in out.collect():
        want = r["recording_id"] is not None and any(k == r["recording_id"] and a is not None and a <= r["time_s"] <= b for k, a, b in spans)
        assert (r["label"] == 1.0) == want
    assert out.count() == len(frames)
