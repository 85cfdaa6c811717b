"""Arguments out of range, NaN, nulls and empty tables."""

import math

import pytest
from pyspark.sql import functions as F

from sonora.functions import signal as S
from sonora.operators import decode, features, matching, windows

NAN = float("nan")


@pytest.mark.parametrize(
    "call",
    [
        lambda df: decode.Hysteresis(0.4, 0.6),
        lambda df: decode.Hysteresis(1.1, 0.6),
        lambda df: decode.Hysteresis(pad_s=-1.0),
        lambda df: matching.iou_pairs(df, df, 1.5),
        lambda df: matching.boundary_errors(df, df, df, -1.0),
        lambda df: matching.frame_metrics(df, [], 2.0),
        lambda df: S.band_edges(0.0, 1.0, 2),
        lambda df: S.band_edges(2.0, 1.0, 2),
        lambda df: S.band_edges(1.0, 2.0, 0),
        lambda df: features.median_filter(df, "v", 4, [], "i"),
        lambda df: windows.window_starts(F.lit(5), 0, 1),
        lambda df: windows.window_starts(F.lit(5), 2, 0),
        lambda df: windows.split_by_windows(df, 0.0, 0.5, "p"),
        lambda df: windows.split_by_windows(df, 0.9, 0.5, "p"),
        lambda df: windows.best_epochs(df, "m", "e", "most"),
        lambda df: windows.bce_loss(df, pos_weight=0.0),
        lambda df: windows.focal_loss(df, alpha=2.0),
    ],
)
def test_arguments_are_checked(spark, call):
    with pytest.raises(ValueError):
        call(spark.range(1))


def frames(spark, values):
    return spark.createDataFrame([(1, i, i * 0.01, v, 1.0) for i, v in enumerate(values)], "recording_id long, frame_idx int, time_s double, prob double, label double")


def test_undefined_probabilities_are_not_flagged(spark):
    rows = frames(spark, [NAN, 0.9, NAN, 0.5, NAN, 0.3, None, 0.7])
    got = decode.hysteresis_mask(rows, decode.Hysteresis(), ["recording_id"]).orderBy("frame_idx").collect()
    assert [r["mask"] for r in got] == [False, True, True, True, True, True, False, True]
    m = matching.frame_metrics(rows, [], 0.5).first()
    assert (m["tp"], m["fn"]) == (3, 5)


def test_nothing_gives_nothing(spark):
    none = frames(spark, []).limit(0)
    rule = decode.Hysteresis(pad_s=0.1)
    assert decode.hysteresis_decode(none, rule, ["recording_id"]).count() == 0
    intervals = spark.createDataFrame([], "recording_id long, gi long, pi long, onset double, offset double")
    pairs = matching.iou_pairs(intervals.drop("pi"), intervals.drop("gi"))
    matches = matching.iou_match(pairs)
    assert matches.count() == 0
    assert matching.event_counts(intervals, intervals, matches).count() == 0
    stats = matching.error_stats(matching.boundary_errors(intervals, intervals, matches), []).first()
    assert stats["n_matches"] == 0 and math.isnan(stats["onset_mae_ms"])
    assert windows.pos_weight(none).first()[0] == 1.0
    assert windows.frame_labels(none, intervals).count() == 0
    assert [r["label"] for r in windows.frame_labels(frames(spark, [0.5]).drop("label"), intervals).collect()] == [0.0]


def test_labels_of_overlapping_and_touching_intervals(spark):
    rows = frames(spark, [0.0] * 10).drop("label")
    marks = [(1, 0.02, 0.04), (1, 0.04, 0.05), (1, 0.03, 0.035), (1, 0.08, 0.08), (2, 0.0, 1.0), (1, 0.07, 0.06), (1, None, 0.2)]
    got = windows.frame_labels(rows, spark.createDataFrame(marks, "recording_id long, onset double, offset double"))
    assert got.count() == 10 and sorted(r["frame_idx"] for r in got.filter("label = 1").collect()) == [2, 3, 4, 5, 8]


def test_normalising_odd_values(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 9.0), ("one", 5.0), ("flat", 3.0), ("flat", 3.0), ("none", None)]
    got = features.robust_normalize(spark.createDataFrame(rows, "k string, v double"), "v", ["k"], 0.5).collect()
    found = {(r["k"], r["v"]): r["z"] for r in got}
    assert len(got) == 8 and found["none", None] is None and found["one", 5.0] == 0 and found["flat", 3.0] == 0
    assert found["a", 9.0] == pytest.approx((9 - 2) / (1.4826 * (1 + 0.5)))


def test_silent_lengths_of_intervals(spark):
    with pytest.raises(Exception, match="offset lies before"):
        spark.range(1).select(S.interval_duration(F.lit(2.0), F.lit(1.0))).collect()
    assert spark.range(1).select(S.interval_iou(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0))).first()[0] == 0.0
