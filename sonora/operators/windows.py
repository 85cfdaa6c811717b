"""Framing recordings: labels of frames, window indices, overlap averages, splits, class weights, losses and best epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonora.functions.signal import seconds_to_frames, sigmoid
from sonora.sources.storage import materialise

from .scan import before, numbered, ranges_of

__all__ = ["before", "best_epochs", "bce_loss", "dice_loss", "estimate_windows", "focal_loss", "frame_labels", "numbered", "overlap_average", "pos_weight", "split_by_windows", "tversky_loss", "window_index", "window_starts"]

KEY = "recording_id"


def frame_labels(frames: DataFrame, intervals: DataFrame, time: str = "time_s") -> DataFrame:
    """Adds ``label``: 1.0 where any interval of the recording holds the frame's time, both ends included.

    Intervals are rounded to the frames' precision. Beginnings, frames and ends of a recording are scanned in the order of
    time: a frame is inside where more intervals have begun than ended. There is no join, no task needs a recording, and
    ranges are of so many rows.
    """
    kind = frames.schema[time].dataType
    i = intervals.select(F.col(KEY).alias("_key"), F.col("onset").cast(kind).alias("_on"), F.col("offset").cast(kind).alias("_off")).filter("_on <= _off and _key is not null")
    nothing = F.lit(None).cast(frames.select(F.struct("*").alias("s")).schema["s"].dataType)
    step = lambda df, at, place, change, frame: df.select(F.col("_key" if df is i else KEY).alias("_key"), F.col(at).alias("_at"), F.lit(place).alias("_place"), F.lit(change).alias("_change"), frame.alias("_frame"))
    steps = materialise(step(i, "_on", 0, 1, nothing).unionByName(step(frames, time, 1, 0, F.struct("*"))).unionByName(step(i, "_off", 2, -1, nothing)))
    inside = before(steps, ["_key"], ["_at", "_place"], "_open", F.col("_change"), ranges=ranges_of(steps)).filter("_place = 1")
    return inside.select("_frame.*", F.coalesce((F.col("_open") > 0).cast("double"), F.lit(0.0)).alias("label"))


def window_starts(n: Column, width: int, hop: int) -> Column:
    """Starts of all whole windows; an empty array where the recording is shorter than one."""
    if width <= 0 or hop <= 0:
        raise ValueError("width and hop must be at least one frame")
    return F.when(n >= width, F.sequence(F.lit(0), (n - width).cast("int"), F.lit(hop))).otherwise(F.array().cast("array<int>"))


def window_index(recordings: DataFrame, width: int, hop: int, n_frames: str = "n_frames") -> DataFrame:
    """(key, start_frame) of every window of every recording."""
    return recordings.select(KEY, F.explode(window_starts(F.col(n_frames), width, hop)).alias("start_frame"))


def estimate_windows(recordings: DataFrame, hop_s: float, window_s: float, window_hop_s: float) -> DataFrame:
    """Adds n_frames and n_windows from a recording's duration alone."""
    frames = lambda s: max(0, round(s / hop_s))
    sized = recordings.withColumn("n_frames", seconds_to_frames("duration_s", hop_s))
    return sized.withColumn("n_windows", F.size(window_starts(F.col("n_frames"), frames(window_s), frames(window_hop_s))).cast("long"))


def overlap_average(frames: DataFrame, scores: DataFrame) -> DataFrame:
    """(key, frame_idx, score): the mean of all windows' scores of a frame, 0 for frames that no window covers."""
    mean = scores.groupBy(KEY, "frame_idx").agg(F.avg("score").alias("score"))
    return frames.select(KEY, "frame_idx").join(mean, [KEY, "frame_idx"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def split_by_windows(recordings: DataFrame, train_frac: float, val_frac: float, position: str) -> DataFrame:
    """Adds ``split``: in the order of ``position``, training while its windows are below target, then validation, then test.

    Recordings without windows are left out. Those for training come first, so what the others' sums leave out is one total.
    """
    if train_frac <= 0 or val_frac < 0 or train_frac + val_frac > 1.01:
        raise ValueError("fractions must be positive and sum to one at most")
    usable = recordings.filter("n_windows > 0")
    summed = before(usable, [], [position], "_before", F.col("n_windows")).withColumn("_before", F.coalesce("_before", F.lit(0)))
    total = usable.agg(F.sum("n_windows")).first()[0] or 0
    train = F.col("_before") < F.lit(total) * train_frac
    trained = summed.filter(train).agg(F.sum("n_windows")).first()[0] or 0
    rest = F.col("_before") - F.lit(trained)
    return summed.withColumn("split", F.when(train, "train").when(rest < F.lit(total) * val_frac, "val").otherwise("test")).drop("_before")


def pos_weight(frames: DataFrame, label: str = "label") -> DataFrame:
    """Negatives over positives of all frames; 1 without positives."""
    positive = F.sum(F.col(label).cast("double"))
    return frames.agg(F.when(positive > 0, (F.count(label) - positive) / F.nullif(positive, F.lit(0.0))).otherwise(1.0).alias("pos_weight"))


def best_epochs(epochs: DataFrame, metric: str, order: str, mode: str = "max") -> DataFrame:
    """Rows that strictly improve on all before them; NaN never does."""
    if mode not in ("min", "max"):
        raise ValueError("mode must be min or max")
    sign = 1 if mode == "max" else -1
    usable = epochs.filter(F.col(metric).isNotNull() & ~F.isnan(metric))
    seen = before(usable, [], [order], "_b", F.col(metric) * sign, "max")
    return seen.filter(F.col("_b").isNull() | (F.col(metric) * sign > F.col("_b"))).drop("_b")


def _bce(x: Column, y: Column, weight: float = 1.0) -> Column:
    return (1 - y) * x + (1 + (weight - 1) * y) * (F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0)))


def bce_loss(df: DataFrame, logit: str = "logit", target: str = "target", pos_weight: float = 1.0) -> DataFrame:
    """Mean binary cross-entropy of logits."""
    if pos_weight <= 0:
        raise ValueError("pos_weight must be positive")
    return df.agg(F.avg(_bce(F.col(logit), F.col(target), pos_weight)).alias("loss"))


def focal_loss(df: DataFrame, alpha: float = 0.25, gamma: float = 2.0, logit: str = "logit", target: str = "target") -> DataFrame:
    if not 0 <= alpha <= 1 or gamma < 0:
        raise ValueError("alpha must lie in [0, 1] and gamma must not be negative")
    p, y = sigmoid(logit), F.col(target)
    p_t, a_t = p * y + (1 - p) * (1 - y), alpha * y + (1 - alpha) * (1 - y)
    return df.agg(F.avg(a_t * F.pow(1 - p_t, F.lit(gamma)) * _bce(F.col(logit), y)).alias("loss"))


def dice_loss(df: DataFrame, smooth: float = 1.0, logit: str = "logit", target: str = "target") -> DataFrame:
    p, y = sigmoid(logit), F.col(target)
    return df.agg((1 - F.try_divide(2 * F.sum(p * y) + smooth, F.sum(p) + F.sum(y) + smooth)).alias("loss")).select(F.coalesce("loss", F.lit(float("nan"))).alias("loss"))


def tversky_loss(df: DataFrame, alpha: float = 0.5, beta: float = 0.5, smooth: float = 1.0, logit: str = "logit", target: str = "target") -> DataFrame:
    p, y = sigmoid(logit), F.col(target)
    tp, fp, fn = F.sum(p * y), F.sum(p * (1 - y)), F.sum((1 - p) * y)
    return df.agg((1 - F.try_divide(tp + smooth, tp + alpha * fp + beta * fn + smooth)).alias("loss")).select(F.coalesce("loss", F.lit(float("nan"))).alias("loss"))
