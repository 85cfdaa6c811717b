"""From frame probabilities to intervals: hysteresis thresholding, runs, gap merging, duration filter and padding.

Frames are dealt by ranges of keys and order, and a range is decoded as arrays of times and flags. What it can't know is
whether its first key is inside a call as the range begins; that is one bit, so the frames up to the first that decides are
one block, all inside or all outside. Of keys that reach a range's edge, the block, the first and the last interval and the
state at the end go to a second step, which joins them key by key: a few rows for each range. All others are final.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonora.functions.signal import at_least
from sonora.sources.storage import materialise

from .scan import before, changes, ranged


@dataclass(frozen=True)
class Hysteresis:
    """Thresholds on probabilities; durations in seconds."""

    enter: float = 0.6
    exit: float = 0.4
    min_duration_s: float = 0.03
    min_gap_s: float = 0.02
    pad_s: float = 0.0

    def __post_init__(self) -> None:
        if not 0 <= self.exit <= self.enter <= 1:
            raise ValueError("0 <= exit <= enter <= 1 must hold")
        if min(self.min_duration_s, self.min_gap_s, self.pad_s) < 0:
            raise ValueError("durations must not be negative")


#: Rows that decoding a range gives: final intervals, and of keys that reach its edges blocks that wait for a state,
#: intervals that may go on, and the state at the end.
FINAL, BLOCK, OPEN, END = range(4)
_SPAN = "onset double, offset double, _kind int, _part int, _head boolean, _tail boolean, _state int, _first double, _last double"
_NAMES = ["onset", "offset", "_kind", "_part", "_head", "_tail", "_state", "_first", "_last"]


def _event(p: str, rule: Hysteresis) -> tuple:
    """Whether a frame's probability lets a call end, and begin."""
    return F.coalesce(~F.isnan(p) & (F.col(p) <= rule.exit), F.lit(False)), at_least(p, rule.enter)


def hysteresis_mask(frames: DataFrame, rule: Hysteresis, keys: list[str], order: str = "frame_idx", prob: str = "prob") -> DataFrame:
    """Adds ``mask``: a call starts at p >= enter and ends at p <= exit, the frame of the exit included."""
    leaves, enters = _event(prob, rule)
    state = before(frames, keys, [order], "_state", F.when(leaves, 0.0).when(enters, 1.0), "last")
    return state.withColumn("mask", enters | (F.coalesce(F.col("_state"), F.lit(0.0)) > 0)).drop("_state")


@dataclass
class _Runs:
    """Runs of rows in order: their groups, times, and whether they touch the block before them or the range's last row."""

    group: np.ndarray
    onset: np.ndarray
    offset: np.ndarray
    head: np.ndarray
    tail: np.ndarray

    def merged(self, min_gap: float) -> _Runs:
        """Runs of a group whose gap is less than ``min_gap`` as one, in chains."""
        n = len(self.group)
        apart = np.ones(n, bool)
        apart[1:] = (self.group[1:] != self.group[:-1]) | ~(self.onset[1:] - self.offset[:-1] < min_gap)
        at = np.flatnonzero(apart)
        last = np.append(at[1:], n) - 1 if n else at
        return _Runs(self.group[at], self.onset[at], np.maximum.reduceat(self.offset, at) if n else self.offset, self.head[at], self.tail[last] if n else self.tail)


def _decoded(table: pa.Table, keys: list[str], part: int, min_gap: float, stateful: bool) -> pa.RecordBatch:
    """A range's rows of the kinds above. ``table``: keys, and on, off, enters, leaves of each row, sorted."""
    n = len(table)
    on, off, enters, leaves = (table[c].chunk(0).to_numpy(zero_copy_only=False) for c in ("_on", "_off", "_enters", "_leaves"))
    new = changes([table[k].chunk(0) for k in keys], n)
    group = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], n) - 1
    lead, state = 0, np.zeros(n, bool)
    if stateful:
        event = np.where(leaves, 0, np.where(enters, 1, -1))
        seen = np.maximum.accumulate(np.where(event >= 0, np.arange(n), -1))
        prior = np.append(-1, seen[:-1])
        known = prior >= begin[group]
        inside = known & (event[prior] == 1)
        decided = np.flatnonzero(event[: end[0] + 1] >= 0)
        lead = (int(decided[0]) + (not enters[decided[0]])) if len(decided) else int(end[0]) + 1
        state = np.where(seen >= begin[group], event[np.maximum(seen, 0)], -1)[end]
    else:
        inside, state = np.zeros(n, bool), np.zeros(len(end), np.int64)
    mask = enters | inside
    prior_mask = np.append(False, mask[:-1])
    starts = np.flatnonzero(mask & (new | ~prior_mask))
    stops = np.flatnonzero(mask & (np.append(new[1:], True) | ~np.append(mask[1:], False)))
    runs = _Runs(group[starts], on[starts], off[stops], (starts == lead) & (group[starts] == 0), stops == n - 1).merged(min_gap)
    edge_group = (runs.group == 0) | (runs.group == len(begin) - 1)
    first = np.append(True, runs.group[1:] != runs.group[:-1])[: len(runs.group)]
    last = np.append(runs.group[1:] != runs.group[:-1], True)[: len(runs.group)]
    waits = edge_group & (first | last)
    rows: list[tuple[np.ndarray, ...]] = []

    def put(at: np.ndarray, kind: int, onset, offset, head, tail, held) -> None:
        rows.append((begin[at], onset, offset, np.full(len(at), kind), head, tail, held, on[begin[at]], off[end[at]]))

    for some, kind in ((~waits, FINAL), (waits, OPEN)):
        at = runs.group[some]
        put(at, kind, runs.onset[some], runs.offset[some], runs.head[some], runs.tail[some], np.zeros(len(at), np.int64))
    if lead:
        put(np.zeros(1, int), BLOCK, on[:1], off[lead - 1 : lead], np.ones(1, bool), np.array([lead == n]), np.zeros(1, np.int64))
    edges = np.unique([0, len(begin) - 1])
    none = np.full(len(edges), np.nan)
    put(edges, END, none, none, np.zeros(len(edges), bool), np.zeros(len(edges), bool), np.asarray(state)[edges].astype(np.int64))
    joined = [np.concatenate(c) for c in zip(*rows)]
    at = pa.array(joined[0])
    values = [pa.array(joined[1], pa.float64()), pa.array(joined[2], pa.float64()), pa.array(joined[3], pa.int32()), pa.array(np.full(len(at), part), pa.int32()), pa.array(joined[4]), pa.array(joined[5]), pa.array(joined[6], pa.int32()), pa.array(joined[7], pa.float64()), pa.array(joined[8], pa.float64())]
    return pa.RecordBatch.from_arrays([*(table[k].chunk(0).take(at) for k in keys), *values], names=[*keys, *_NAMES])


class Seam:
    """What a key's ranges, taken in order, leave open: whether the next row is inside a call, whether it may go on with
    the last run, and the last interval."""

    def __init__(self, inside: bool = False, touching: bool = False, current: tuple[float, float] | None = None) -> None:
        self.inside, self.touching, self.current = inside, touching, current

    def take(self, rows: list[dict], min_gap: float) -> list[tuple[float, float]]:
        """The intervals that the next range's rows close."""
        closed: list[tuple[float, float]] = []

        def add(onset: float, offset: float, goes_on: bool) -> None:
            if self.current and (goes_on or onset - self.current[1] < min_gap):
                self.current = (self.current[0], max(self.current[1], offset))
            else:
                closed.extend([self.current] if self.current else [])
                self.current = (onset, offset)

        block = next((r for r in rows if r["_kind"] == BLOCK), None)
        after = self.touching  # whether the row before the next one is inside
        if block:
            after = self.inside
            if self.inside:
                add(block["onset"], block["offset"], self.touching)
        self.touching = bool(block and block["_tail"] and self.inside)
        for r in sorted((r for r in rows if r["_kind"] in (OPEN, FINAL)), key=lambda r: (r["onset"], r["offset"])):
            add(r["onset"], r["offset"], r["_head"] and after)
            self.touching = r["_tail"]
        end = next(r for r in rows if r["_kind"] == END)
        self.inside = end["_state"] == 1 if end["_state"] >= 0 else self.inside
        return closed


def _stitched(rows: list[dict], min_gap: float) -> list[tuple[float, float]]:
    """A key's intervals of the rows that waited, range by range."""
    seam, out = Seam(), []
    for part in sorted({r["_part"] for r in rows}):
        out += seam.take([r for r in rows if r["_part"] == part], min_gap)
    return out + ([seam.current] if seam.current else [])


def range_rows(times: np.ndarray, probs: np.ndarray, rule: Hysteresis) -> list[dict]:
    """What one range of a recording's frames, in order, gives to ``Seam.take``; a probability of NaN decides nothing."""
    table = pa.table({"_on": pa.array(times, pa.float64()), "_off": pa.array(times, pa.float64()), "_enters": pa.array(probs >= rule.enter), "_leaves": pa.array(probs <= rule.exit)})
    return _decoded(table, [], 0, rule.min_gap_s, True).to_pylist()


def _intervals(rows: DataFrame, keys: list[str], order: list[str], min_gap: float, stateful: bool) -> DataFrame:
    """(keys, onset, offset, first, last): intervals, and the times of their key's first and last row.

    ``rows``: keys, order, and of each row _on, _off, _enters and _leaves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A range of rows, of times and flags alone.
        held = [b.select([*keys, "_on", "_off", "_enters", "_leaves"]) for b in batches if len(b)]
        if held:
            yield _decoded(pa.Table.from_batches(held).combine_chunks(), keys, TaskContext.get().partitionId(), min_gap, stateful)

    def stitch(table: pa.Table) -> pa.Table:
        given = table.to_pylist()
        found = _stitched(given, min_gap)
        first, last = min(r["_first"] for r in given), max(r["_last"] for r in given)
        return pa.table([*(table[k].combine_chunks().take(pa.array(np.zeros(len(found), np.int64))) for k in keys), *(pa.array(x, pa.float64()) for x in ([a for a, _ in found], [b for _, b in found], [first] * len(found), [last] * len(found)))], names=[*keys, "onset", "offset", "_first", "_last"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    found = materialise(ranged(rows, keys, order).mapInArrow(run, f"{fields}{', ' if keys else ''}{_SPAN}"))
    waiting = found.filter(F.col("_kind") != FINAL)
    final = found.filter(F.col("_kind") == FINAL)
    spans = waiting.filter(F.col("_kind") == END).groupBy(*keys).agg(F.min("_first").alias("_a"), F.max("_last").alias("_b"))
    # Two keys of each range at most have reached its edge.
    same = [F.col(f"w.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys] or [F.lit(True)]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    spanned = final.alias("f").join(F.broadcast(spans.alias("w")), condition, "left").select(*(F.col(f"f.{k}") for k in keys), "onset", "offset", F.coalesce("_a", "_first").alias("_first"), F.coalesce("_b", "_last").alias("_last"))
    joined = waiting.groupBy(*keys).applyInArrow(stitch, f"{fields}{', ' if keys else ''}onset double, offset double, _first double, _last double")
    return spanned.unionByName(joined)


def mask_intervals(masked: DataFrame, keys: list[str], order: str = "frame_idx", time: str = "time_s") -> DataFrame:
    """(keys, onset, offset) of each run of true masks: times of its first and its last frame."""
    at, mask = F.col(time).cast("double"), F.coalesce("mask", F.lit(False))
    rows = masked.select(*keys, F.col(order).alias("_order"), at.alias("_on"), at.alias("_off"), mask.alias("_enters"), (~mask).alias("_leaves"))
    return _intervals(rows, keys, ["_order"], float("-inf"), False).select(*keys, "onset", "offset")


def merge_gaps(intervals: DataFrame, min_gap_s: float, keys: list[str]) -> DataFrame:
    """Joins intervals whose gap is under ``min_gap_s``, in chains; the input's intervals must not overlap."""
    true = F.lit(True)
    # Between two intervals lies a row of its own, so that they aren't one run.
    apart = F.explode(F.array(F.lit(True), F.lit(False)))
    rows = intervals.select(*keys, F.col("onset").alias("_on"), F.col("offset").alias("_off"), apart.alias("_enters")).withColumn("_leaves", true)
    return _intervals(rows, keys, ["_on", "_off", "_enters"], min_gap_s, False).select(*keys, "onset", "offset")


def hysteresis_decode(frames: DataFrame, rule: Hysteresis, keys: list[str], order: str = "frame_idx", time: str = "time_s", prob: str = "prob") -> DataFrame:
    """(keys, onset, offset): all steps in one pass. Short intervals go after merging; padding stops at the recording's first and last frame."""
    at = F.col(time).cast("double")
    leaves, enters = _event(prob, rule)
    rows = frames.select(*keys, F.col(order).alias("_order"), at.alias("_on"), at.alias("_off"), enters.alias("_enters"), leaves.alias("_leaves"))
    kept = _intervals(rows, keys, ["_order"], rule.min_gap_s, True).filter(F.col("offset") - F.col("onset") >= rule.min_duration_s)
    return kept.select(*keys, F.greatest(F.col("onset") - rule.pad_s, F.col("_first")).alias("onset"), F.least(F.col("offset") + rule.pad_s, F.col("_last")).alias("offset"))
