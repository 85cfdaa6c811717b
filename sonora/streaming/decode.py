"""The decoder over a stream of frames: state by recording, intervals as soon as nothing later can change them.

Frames of a recording are numbered from 0 without gaps and may come in any micro-batch and any order: those that come
before their turn wait in the state, so the result is that of ``operators.decode.hysteresis_decode`` for every cut. Beside
them the state holds a few numbers: the next frame's number, what the decoder leaves open, and intervals whose padding
could still meet the recording's end.

A recording ends when as many frames as its ``n_frames`` says have been decoded, or, with ``idle_s``, when none has come for
so long; then what waits is decoded in order, over its gaps. Then its state goes. Repeated frame numbers count once, by the
frame that came first. Times must not be null nor fall with the frames' numbers; probabilities that are null or NaN decide
nothing; null is a recording of its own. A recording that hasn't ended stays in the state, for the next run of the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from sonora.operators.decode import Hysteresis, Seam, range_rows

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FRAME = np.dtype([("idx", "<i8"), ("time", "<f8"), ("prob", "<f8")])
STATE = "next long, n_frames long, first double, last double, inside boolean, touching boolean, onset double, offset double, waiting binary, early binary"


@dataclass
class Progress:
    """A recording between micro-batches. ``waiting``: intervals whose padding may meet the end; ``early``: frames before their turn."""

    next: int = 0
    n_frames: int = -1
    first: float = 0.0
    last: float = 0.0
    seam: Seam = field(default_factory=Seam)
    waiting: list[tuple[float, float]] = field(default_factory=list)
    early: np.ndarray = field(default_factory=lambda: np.empty(0, FRAME))

    @classmethod
    def unpacked(cls, row: tuple) -> Progress:
        at, n, first, last, inside, touching, onset, offset, waiting, early = row
        spans = np.frombuffer(waiting, "<f8").reshape(-1, 2).tolist()
        return cls(at, n, first, last, Seam(inside, touching, None if onset is None else (onset, offset)), [tuple(x) for x in spans], np.frombuffer(early, FRAME))

    def packed(self) -> tuple:
        onset, offset = self.seam.current or (None, None)
        return self.next, self.n_frames, self.first, self.last, self.seam.inside, self.seam.touching, onset, offset, np.array(self.waiting, "<f8").tobytes(), self.early.tobytes()

    def advance(self, frames: np.ndarray, rule: Hysteresis, over_gaps: bool = False) -> list[tuple[float, float]]:
        """The intervals that are final with these frames, too. ``over_gaps``: no more will come."""
        rows = np.concatenate([self.early, frames])
        rows = rows[rows["idx"] >= self.next]
        rows = rows[np.unique(rows["idx"], return_index=True)[1]]  # sorted; of equal numbers the first
        turn = np.arange(self.next, self.next + len(rows)) == rows["idx"]
        n = len(rows) if over_gaps or turn.all() else int(turn.argmin())
        self.early = rows[n:]
        if n:
            rows = rows[:n]
            if not self.next:
                self.first = float(rows["time"][0])
            self.next, self.last = int(rows["idx"][-1]) + 1, float(rows["time"][-1])
            self.waiting += self.seam.take(range_rows(rows["time"], rows["prob"], rule), rule.min_gap_s)
        ended = over_gaps or self.ended
        open_ = self.seam.current
        # The next onset is at the last time at least.
        if open_ and (ended or not self.seam.touching and self.last - open_[1] >= rule.min_gap_s):
            self.waiting.append(open_)
            self.seam.current = None
        final = [x for x in self.waiting if ended or self.last >= x[1] + rule.pad_s]
        self.waiting = [] if ended else [x for x in self.waiting if self.last < x[1] + rule.pad_s]
        return [(max(a - rule.pad_s, self.first), min(b + rule.pad_s, self.last)) for a, b in final if b - a >= rule.min_duration_s]

    @property
    def ended(self) -> bool:
        return 0 <= self.n_frames <= self.next


class HysteresisProcessor(StatefulProcessor):
    """Rows (idx, time, prob, n_frames) of a recording to its intervals (key, onset, offset)."""

    def __init__(self, rule: Hysteresis, key: str, idle_s: float | None) -> None:
        self.rule, self.key, self.idle_s = rule, key, idle_s

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("progress", STATE)

    def _progress(self) -> Progress:
        return Progress.unpacked(self.state.get()) if self.state.exists() else Progress()

    def _frame(self, key: tuple, spans: list[tuple[float, float]]) -> pd.DataFrame:
        return pd.DataFrame({self.key: pd.Series([key[0]] * len(spans), dtype=object), "onset": pd.Series([a for a, _ in spans], dtype=float), "offset": pd.Series([b for _, b in spans], dtype=float)})

    def _stop_timers(self) -> None:
        if self.idle_s is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        progress, parts = self._progress(), []
        for part in rows:
            frames = np.empty(len(part), FRAME)
            for name in FRAME.names:
                frames[name] = part[name].to_numpy(dtype=FRAME[name])
            known = part["n_frames"].dropna()
            if len(known):
                progress.n_frames = max(progress.n_frames, int(known.max()))
            parts.append(frames)
        spans = progress.advance(np.concatenate(parts), self.rule)
        self._stop_timers()
        if progress.ended:
            self.state.clear()
        else:
            self.state.update(progress.packed())
            if self.idle_s is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.idle_s * 1000))
        yield self._frame(key, spans)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            spans = self._progress().advance(np.empty(0, FRAME), self.rule, over_gaps=True)
            self.state.clear()
            yield self._frame(key, spans)

    def close(self) -> None:
        pass


def hysteresis_stream(frames: DataFrame, rule: Hysteresis, key: str = "recording_id", order: str = "frame_idx", time: str = "time_s", prob: str = "prob", n_frames: str | None = None, idle_s: float | None = None) -> DataFrame:
    """(key, onset, offset) of a stream of frames, in append mode.

    ``n_frames``: the column that says how many frames a recording has, in one of its rows at least; ``idle_s``: seconds
    without frames after which a recording has ended. The session's state store becomes RocksDB, which this state needs.
    """
    if n_frames is None and idle_s is None:
        raise ValueError("n_frames or idle_s must say when a recording ends")
    if idle_s is not None and idle_s <= 0:
        raise ValueError("idle_s must be positive")
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    total = F.lit(None) if n_frames is None else F.col(n_frames)
    rows = frames.select(key, F.col(order).cast("long").alias("idx"), F.col(time).cast("double").alias("time"), F.col(prob).cast("double").alias("prob"), total.cast("long").alias("n_frames"))
    out = StructType([frames.schema[key]]).add("onset", "double").add("offset", "double")
    return rows.groupBy(key).transformWithStateInPandas(HysteresisProcessor(rule, key, idle_s), out, "Append", "None" if idle_s is None else "ProcessingTime")
