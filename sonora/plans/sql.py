"""Decoders and other parts as SQL: Python table functions over a recording's rows.

``register_decoder(spark, "calls", C.HysteresisDecoder())`` gives

    SELECT * FROM calls(TABLE(SELECT recording_id, frame_idx, time_s, prob FROM frames) PARTITION BY recording_id ORDER BY frame_idx)

Spark deals the rows by recording, and a call of the function decodes one recording. For recordings beyond a task's memory
use the decoder's ``decode``, which needs none whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from sonora.operators import decode

from .components import Decoder, HysteresisDecoder

#: A recording's frames in order, (time, probability), to its intervals.
Frames = Iterable[tuple[float, float | None]]
Intervals = Iterator[tuple[float, float]]


def hysteresis(rule: decode.Hysteresis) -> Callable[[Frames], Intervals]:
    """A recording's intervals by the rule, through the kernel that ranges are decoded with."""

    def run(frames: Frames) -> Intervals:
        times, probs = (np.array(x, float) for x in zip(*frames))  # None becomes NaN
        for a, b in decode._stitched(decode.range_rows(times, probs, rule), rule.min_gap_s):
            if b - a >= rule.min_duration_s:
                yield max(a - rule.pad_s, times[0]), min(b + rule.pad_s, times[-1])

    return run


def register_decoder(spark: SparkSession, name: str, decoder: Decoder | Callable[[Frames], Intervals], key: str = "string") -> None:
    """A table function of that name: rows (recording_id, frame_idx, time_s, prob), by recording and in order, to
    (recording_id, onset, offset). ``decoder``: one with a rule of hysteresis, or any function of a recording's frames.
    ``key``: the SQL type of recording_id."""
    if isinstance(decoder, HysteresisDecoder):
        decoder = hysteresis(decoder)
    if not callable(decoder):
        raise TypeError("a decoder for SQL must be a function of a recording's frames, or HysteresisDecoder")
    own = decoder

    class Decode:
        def __init__(self) -> None:
            self.key, self.frames = None, []

        def eval(self, row: Row) -> None:
            self.key = row["recording_id"]
            self.frames.append((row["time_s"], row["prob"]))

        def terminate(self) -> Iterator[tuple]:
            if self.frames:
                for onset, offset in own(self.frames):
                    yield self.key, float(onset), float(offset)

    spark.udtf.register(name, F.udtf(Decode, returnType=f"recording_id {key}, onset double, offset double"))
