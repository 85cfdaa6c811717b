"""Scalar, array and signal expressions. Arguments are columns (or names) and plain numbers; results are columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What keeps undefined ratios and logarithms finite.
EPS = 1e-12


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def seconds_to_frames(seconds: Column | str, hop_s: float) -> Column:
    """Frames in a duration, halves rounded to even."""
    return F.rint(_c(seconds) / F.lit(hop_s)).cast("int")


def frames_to_seconds(frames: Column | str, hop_s: float) -> Column:
    return _c(frames) * F.lit(hop_s)


def interval_duration(onset: Column | str, offset: Column | str) -> Column:
    """Length of an interval; an interval that ends before it starts is an error, one of no length is not."""
    return F.when(_c(offset) < _c(onset), F.raise_error("an interval's offset lies before its onset").cast("double")).otherwise(_c(offset) - _c(onset))


def interval_iou(on_a: Column | str, off_a: Column | str, on_b: Column | str, off_b: Column | str) -> Column:
    """Intersection over union of two intervals; 0 where the union has no length."""
    both = F.greatest(F.lit(0.0), F.least(_c(off_a), _c(off_b)) - F.greatest(_c(on_a), _c(on_b)))
    union = (_c(off_a) - _c(on_a)) + (_c(off_b) - _c(on_b)) - both
    return F.when(union <= 0, F.lit(0.0)).otherwise(both / F.nullif(union, F.lit(0.0)))


def precision_recall_f1(tp: Column | str, fp: Column | str, fn: Column | str) -> list[Column]:
    """precision, recall and f1; each 0 where its counts are."""
    ratio = lambda a, b: F.when(a + b > 0, a / (a + b + EPS)).otherwise(F.lit(0.0))
    p, r = ratio(_c(tp), _c(fp)), ratio(_c(tp), _c(fn))
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r + EPS)).otherwise(F.lit(0.0)).alias("f1")]


def sigmoid(x: Column | str) -> Column:
    """1 / (1 + exp(-x)), without overflow for very negative x."""
    small = F.exp(-F.abs(_c(x)))
    return F.when(_c(x) >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def at_least(p: Column | str, threshold: float) -> Column:
    """p >= threshold; false for NaN and null."""
    return F.coalesce(~F.isnan(_c(p)) & (_c(p) >= threshold), F.lit(False))


def snr_db(energy: Column | str, baseline: Column | str, eps: float = EPS) -> Column:
    return 10 * F.log10((_c(energy) + eps) / (_c(baseline) + eps))


def band_edges(low: float, high: float, n: int) -> list[tuple[float, float]]:
    """n contiguous bands between two frequencies, spaced geometrically; both ends are met exactly."""
    if low <= 0 or high <= low or n < 1:
        raise ValueError("bands need 0 < low < high and at least one band")
    inner = [low * (high / low) ** (i / n) for i in range(1, n)]
    edges = [low, *inner, high]
    return list(zip(edges[:-1], edges[1:]))


def band_edges_of(low: Column | str, high: Column | str, n: int) -> Column:
    """The same for a row's own frequencies: an array of structs of band, lo and hi; frequencies out of order are an error."""
    if n < 1:
        raise ValueError("there must be at least one band")
    a, b = _c(low).cast("double"), _c(high).cast("double")
    edge = lambda i: F.when(i == 0, a).when(i == n, b).otherwise(a * F.pow(b / a, i / F.lit(float(n))))
    bands = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("band"), edge(i).alias("lo"), edge(i + 1).alias("hi")))
    wrong = F.raise_error("bands need 0 < low < high").cast("array<struct<band:int,lo:double,hi:double>>")
    return F.when((a > 0) & (b > a), bands).when(a.isNull() | b.isNull(), None).otherwise(wrong)


def mono_mix(samples: Column | str, channels: int) -> Column:
    """The mean over channels of interleaved samples."""
    n = F.floor(F.size(_c(samples)) / channels).cast("int")
    mean = lambda i: sum((F.get(_c(samples), i * channels + c) for c in range(channels)), F.lit(0.0)) / channels
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), mean)).otherwise(F.array().cast("array<double>"))


def edge_pad(values: Column | str, width: int) -> Column:
    """The array, its last value repeated up to ``width``."""
    missing = F.greatest(F.lit(0), F.lit(width) - F.size(_c(values)))
    return F.concat(_c(values), F.array_repeat(F.element_at(_c(values), -1), missing))


def window_slice(values: Column | str, start: Column | str, width: int) -> Column:
    """``width`` values from ``start``; a window past the end moves back, a short array gives what it has."""
    n = F.size(_c(values))
    first = F.when(_c(start) + width > n, F.greatest(F.lit(0), n - width)).otherwise(_c(start))
    return F.slice(_c(values), (first + 1).cast("int"), width)


def band_edge_rows(low: float, high: float, n: int) -> list[tuple[int, float, float]]:
    return [(i, a, b) for i, (a, b) in enumerate(band_edges(low, high, n))]


def odd_kernel(seconds: float, hop_s: float) -> int:
    """Frames of a moving window: halves to even, three at least, odd."""
    k = max(3, round(seconds / hop_s))
    return k + 1 - k % 2


def next_power_of_two(n: int) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, n))))
