"""Matching predicted intervals to annotated ones, and what comes of it: events, boundary errors, reports."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonora.functions.signal import at_least, interval_iou, precision_recall_f1
from sonora.sources.storage import materialise

from .quantiles import around, between, by_size, select_ranks
from .scan import before, changes, numbered, whole_groups

KEY = "recording_id"
#: Intervals of a recording, of both sides, whose pairs are taken all at once at most.
SMALL = 256
#: Pairs of a segment that one task matches at most, and rounds of its matching.
DENSE, CHAIN = 1 << 20, 64
FRAME_COUNTS = ["tp", "fp", "fn", "tn"]
STATS = [f"{side}_{name}_ms" for side in ("onset", "offset") for name in ("median", "mae", "p95")]


def _levels(side: DataFrame) -> DataFrame:
    """Intervals of some length, with the power of four that is no less than their length."""
    finite = lambda c: F.col(c).between(-sys.float_info.max, sys.float_info.max)
    return side.filter(finite("_on") & finite("_off") & (F.col("_off") > F.col("_on"))).withColumn("_level", F.ceil(F.log(F.col("_off") - F.col("_on")) / math.log(4)).cast("int"))


def _binned(side: DataFrame, own: set[int], other: set[int]) -> DataFrame:
    """A row of each interval for each time bin that it meets, in bins of its own level and of the other side's higher ones."""
    levels = F.array(*(F.lit(x) for x in sorted(own | other)))
    some = F.filter(levels, lambda x: (x == F.col("_level")) | (x > F.col("_level")) & x.isin(*other)) if other else F.array("_level")
    wide = side.withColumn("_at", F.explode(some)).withColumn("_width", F.pow(F.lit(4.0), F.col("_at").cast("double")))
    first = F.floor(F.col("_on") / F.col("_width"))
    return wide.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, F.floor(F.col("_off") / F.col("_width"))))).drop("_width")


def iou_pairs(gt: DataFrame, pred: DataFrame, threshold: float = 0.2) -> DataFrame:
    """All pairs of a recording whose IoU reaches the threshold: (key, gi, pi, iou), and begin and end of what both cover.

    Above 0, pairs must overlap. Intervals are put into time bins no narrower than themselves, whose widths are the powers of
    four that occur, so each meets two or three bins of a level; a pair meets at the longer one's level, and the first bin
    that both have gives it. So the join is by recording, level and bin, and a recording of any size is many keys. At 0,
    disjoint pairs match, too, and all pairs of a recording are the result.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must lie in [0, 1]")
    g = gt.select(KEY, "gi", F.col("onset").alias("_on"), F.col("offset").alias("_off"))
    p = pred.select(KEY, "pi", F.col("onset").alias("_on"), F.col("offset").alias("_off"))
    if threshold > 0:
        g, p = _levels(g), _levels(p)
        # The levels that occur: some hundred at most, as they are logarithms of doubles.
        found = g.select("_level", F.lit(0).alias("side")).unionByName(p.select("_level", F.lit(1).alias("side"))).distinct().collect()
        own = [{r["_level"] for r in found if r["side"] == k} for k in (0, 1)]
        g, p = _binned(g, own[0], own[1]), _binned(p, own[1], own[0])
        meets = (F.col(f"g.{KEY}") == F.col(f"p.{KEY}")) & (F.col("g._at") == F.col("p._at")) & (F.col("g._bin") == F.col("p._bin"))
        meets = meets & (F.col("g._at") == F.greatest("g._level", "p._level")) & (F.col("g._bin") == F.greatest("g._first", "p._first"))
        meets = meets & (F.col("g._on") <= F.col("p._off")) & (F.col("p._on") <= F.col("g._off"))
    else:
        meets = F.col(f"g.{KEY}") == F.col(f"p.{KEY}")
    iou = interval_iou("g._on", "g._off", "p._on", "p._off")
    both = g.alias("g").join(p.alias("p"), meets).select(f"g.{KEY}", "gi", "pi", iou.alias("iou"), F.least("g._on", "p._on").alias("begin"), F.greatest("g._off", "p._off").alias("end"))
    return both.filter(F.col("iou") >= threshold)


def iou_match(pairs: DataFrame) -> DataFrame:
    """One-to-one greedy matches (key, match_rank, gi, pi, iou): best IoU first, ties by gi, then pi.

    Pairs are matched as arrays, many recordings at a time. A recording of more than ``DENSE`` pairs is cut where none of its
    pairs is open (their ``begin`` and ``end`` say so): no two pairs of one interval lie on both sides of a cut, so its
    segments are matched each by itself. Without ``begin`` and ``end``, or where a segment has too many pairs still, rounds of
    joins come to the same end, and no task needs the whole of it.
    """
    spans = [c for c in ("begin", "end") if c in pairs.columns]
    ready = materialise(pairs.select(KEY, F.col("gi").cast("long").alias("gi"), F.col("pi").cast("long").alias("pi"), (-F.col("iou")).alias("worse"), *spans))
    kind = ready.schema[KEY].dataType.simpleString()
    columns = [KEY, "match_rank", "gi", "pi", (-F.col("worse")).alias("iou")]
    large = _more_than(ready, [KEY], DENSE)
    whole = ready if large is None else ready.join(large, KEY, "left_anti")
    matched = _greedy(whole.select(KEY, F.lit(0).cast("long").alias("_segment"), "gi", "pi", "worse"), kind).select(columns)
    if large is None:
        return matched
    rest = ready.join(large, KEY, "left_semi")
    if len(spans) == 2:
        order = ["begin", "end", "gi", "pi"]
        reached = before(rest, [KEY], order, "_reach", F.col("end"), "max")
        cut = F.coalesce((F.col("begin") >= F.col("_reach")).cast("long"), F.lit(1).cast("long"))
        rest = before(reached.withColumn("_cut", cut), [KEY], order, "_cuts", F.col("_cut")).withColumn("_segment", F.coalesce("_cuts", F.lit(0).cast("long")) + F.col("_cut"))
    else:
        rest = rest.withColumn("_segment", F.lit(0).cast("long"))
    at = [KEY, "_segment"]
    dense = _more_than(rest, at, DENSE)
    few = rest if dense is None else rest.join(dense, at, "left_anti")
    parts = _greedy(few.select(*at, "gi", "pi", "worse"), kind).drop("match_rank")
    if dense is not None:
        parts = parts.unionByName(match_by_rounds(rest.join(dense, at, "left_semi").select(KEY, "gi", "pi", "worse")))
    ranked = numbered(parts.select(KEY, "gi", "pi", "worse"), [KEY], ["worse", "gi", "pi"], "match_rank").withColumn("match_rank", F.col("match_rank").cast("int"))
    return matched.unionByName(ranked.select(columns))


def _more_than(rows: DataFrame, keys: list[str], most: int) -> DataFrame | None:
    """The keys of more than ``most`` rows, if there are any."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(*keys)
    return None if found.isEmpty() else materialise(found)


def _greedy(pairs: DataFrame, kind: str) -> DataFrame:
    """Matches of (key, _segment, gi, pi, worse), with match_rank within the segment."""
    groups = [KEY, "_segment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, groups):
            new = changes([table[k].chunk(0) for k in groups], len(table))
            group = np.cumsum(new) - 1
            g, p, worse = (table[c].chunk(0).to_numpy() for c in ("gi", "pi", "worse"))
            at = greedy(group, g, p, worse)
            begins = np.searchsorted(group[at], group[at])
            yield pa.RecordBatch.from_arrays([*(table[c].chunk(0).take(pa.array(at)) for c in (KEY, "gi", "pi", "worse")), pa.array(np.arange(len(at)) - begins, pa.int32())], names=[KEY, "gi", "pi", "worse", "match_rank"])

    return pairs.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(run, f"{KEY} {kind}, gi long, pi long, worse double, match_rank int")


def greedy(group: np.ndarray, g: np.ndarray, p: np.ndarray, worse: np.ndarray) -> np.ndarray:
    """Places of the pairs that a greedy matching keeps, by group and rank.

    In each round the pairs that are the best of both their intervals are kept, of all groups at once, and what shares an
    interval with them goes. What is left after ``CHAIN`` rounds, a long chain of pairs that wait for each other, is walked.
    """
    order = np.lexsort((p, g, worse, group))
    ends = []
    for side in (g, p):
        # Numbers of the intervals, group by group.
        by = np.lexsort((side, group))
        other = np.append(True, (group[by][1:] != group[by][:-1]) | (side[by][1:] != side[by][:-1]))[: len(by)]
        number = np.empty(len(by), np.int64)
        number[by] = np.cumsum(other) - 1
        ends.append(number[order])
    a, b = ends
    left, kept = np.arange(len(order)), []
    used_a, used_b = (np.zeros(int(x.max(initial=-1)) + 1, bool) for x in ends)
    best_a, best_b = (np.empty(len(u), np.int64) for u in (used_a, used_b))
    for _ in range(CHAIN):
        if not len(left):
            break
        back = left[::-1]  # of several values for one place, the last one stays: the best pair
        best_a[a[back]], best_b[b[back]] = back, back
        now = left[(best_a[a[left]] == left) & (best_b[b[left]] == left)]
        used_a[a[now]], used_b[b[now]] = True, True
        kept.append(now)
        left = left[~(used_a[a[left]] | used_b[b[left]])]
    walked = []
    for i, x, y in zip(left.tolist(), a[left].tolist(), b[left].tolist()):
        if not used_a[x] and not used_b[y]:
            used_a[x] = used_b[y] = True
            walked.append(i)
    return order[np.sort(np.concatenate([*kept, np.array(walked, np.int64)]))]


def match_by_rounds(left: DataFrame) -> DataFrame:
    """Greedy matches of (key, gi, pi, worse): pairs that are the best of both their intervals are matched, all pairs of these
    intervals go, and the rest is settled before the next round. No task needs a whole recording; rounds are as many as the
    longest chain of pairs each of which waits for a better neighbour."""
    left = materialise(left)
    matched = left.limit(0)
    while not left.isEmpty():
        best = lambda index: left.groupBy(KEY, index).agg(F.min(F.struct("worse", "gi", "pi")).alias("b")).select(KEY, "b.*")  # noqa: E731, B023
        now = materialise(best("gi").intersect(best("pi")).select(KEY, "gi", "pi", "worse"))
        matched = matched.unionByName(now)
        left = materialise(left.join(now.select(KEY, "gi"), [KEY, "gi"], "left_anti").join(now.select(KEY, "pi"), [KEY, "pi"], "left_anti").select(KEY, "gi", "pi", "worse"))
    return matched


def aligned(gt: DataFrame, pred: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Every interval once: (key, gi, g_on, g_off, pi, p_on, p_off, match_rank, iou), matched ones with their partner, the
    others with nulls. Indices are distinct within a recording, and never null. Matches are those of ``iou_match`` of ``iou_pairs``.

    Recordings of up to ``SMALL`` intervals are dealt out whole, many to an array, which takes all pairs of each and matches
    them: one shuffle of the intervals, and neither pairs nor matches are stored or joined. The others go by time bins and
    segments. So what comes of matches, counts, errors or what is missed, is read from the rows without a join.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must lie in [0, 1]")
    side = lambda df, index, k: df.select(KEY, F.lit(k).cast("byte").alias("_side"), F.col(index).cast("long").alias("_i"), F.col("onset").cast("double").alias("_on"), F.col("offset").cast("double").alias("_off"))
    rows = materialise(side(gt, "gi", 0).unionByName(side(pred, "pi", 1)))
    kind = rows.schema[KEY].dataType.simpleString()
    known = rows.filter(F.col(KEY).isNotNull())
    # At 0 disjoint pairs match, too, and so do empty intervals.
    large = _more_than(known, [KEY], SMALL if threshold > 0 else 0)
    whole = known if large is None else known.join(large, KEY, "left_anti")
    out = whole.repartition(KEY).sortWithinPartitions(KEY).mapInArrow(_aligner(threshold), f"{KEY} {kind}, {_ALIGNED}")
    of = lambda df, k, c: df.filter(F.col("_side") == k).select(KEY, F.col("_i").alias(f"{c}i"), F.col("_on").alias(f"{c}_on"), F.col("_off").alias(f"{c}_off"))
    unknown = rows.filter(F.col(KEY).isNull())
    for k, c in enumerate("gp"):
        out = out.unionByName(of(unknown, k, c), allowMissingColumns=True)
    if large is None:
        return out
    rest = known.join(large, KEY, "left_semi")
    g, p = of(rest, 0, "g"), of(rest, 1, "p")
    named = [df.withColumnsRenamed({f"{c}_on": "onset", f"{c}_off": "offset"}) for df, c in ((g, "g"), (p, "p"))]
    found = materialise(iou_match(iou_pairs(*named, threshold)))
    both = g.join(found, [KEY, "gi"], "left").join(p, [KEY, "pi"], "left").select(out.columns)
    return out.unionByName(both).unionByName(unmatched(p, found, "pi"), allowMissingColumns=True)


_ALIGNED = "gi long, g_on double, g_off double, pi long, p_on double, p_off double, match_rank int, iou double"


def _aligner(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of whole recordings' intervals to rows of ``aligned``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, [KEY]):
            keys = table[KEY].chunk(0)
            group = np.cumsum(changes([keys], len(table))) - 1
            column = lambda c: table[c].chunk(0)  # noqa: E731, B023
            side, on, off = column("_side").to_numpy(), *(column(c).to_numpy(zero_copy_only=False) for c in ("_on", "_off"))
            fit = np.isfinite(on) & np.isfinite(off) & (off > on) & column("_i").is_valid().to_numpy(zero_copy_only=False) & keys.is_valid().to_numpy(zero_copy_only=False)
            a, b = _candidates(group, np.flatnonzero(fit & (side == 0)), np.flatnonzero(fit & (side == 1)))
            both = np.maximum(0.0, np.minimum(off[a], off[b]) - np.maximum(on[a], on[b]))
            iou = both / ((off[a] - on[a]) + (off[b] - on[b]) - both)
            kept = iou >= threshold
            a, b, iou = a[kept], b[kept], iou[kept]
            number = column("_i").fill_null(0).to_numpy()
            at = greedy(group[a], number[a], number[b], -iou)
            a, b, iou = a[at], b[at], iou[at]
            single = np.ones(len(table), bool)
            single[a] = single[b] = False
            x, y = np.flatnonzero(single & (side == 0)), np.flatnonzero(single & (side == 1))
            none = np.zeros(len(x) + len(y), bool)
            g, p = np.concatenate([a, x, np.zeros_like(y)]), np.concatenate([b, np.zeros_like(x), y])
            no_g, no_p = np.arange(len(g)) >= len(a) + len(x), np.concatenate([np.zeros(len(a), bool), np.ones(len(x), bool), np.zeros(len(y), bool)])
            take = lambda c, at, no: column(c).take(pa.array(at, mask=no))
            rank = np.arange(len(a)) - np.searchsorted(group[a], group[a])
            pad = lambda v, kind: pa.array(np.concatenate([v, none]), kind, mask=no_g | no_p)  # noqa: E731, B023
            arrays = [keys.take(pa.array(np.where(no_g, p, g))), *(take(c, g, no_g) for c in ("_i", "_on", "_off")), *(take(c, p, no_p) for c in ("_i", "_on", "_off")), pad(rank, pa.int32()), pad(iou, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[KEY, "gi", "g_on", "g_off", "pi", "p_on", "p_off", "match_rank", "iou"])

    return run


def _candidates(group: np.ndarray, g: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places of one group; ``g`` and ``p`` are in order of their groups."""
    first = np.searchsorted(group[p], group[g])
    n = np.searchsorted(group[p], group[g], "right") - first
    begins = np.cumsum(n) - n
    return np.repeat(g, n), p[np.arange(n.sum()) - np.repeat(begins - first, n)]


def matched(rows: DataFrame) -> DataFrame:
    """The matches of ``aligned`` intervals, as ``iou_match`` gives them."""
    return rows.filter("match_rank is not null").select(KEY, "match_rank", "gi", "pi", "iou")


def alone(rows: DataFrame, side: str) -> DataFrame:
    """Of ``aligned`` intervals those of no match, (key, index, onset, offset): missed events for g, false alarms for p."""
    index = f"{side}i"
    return rows.filter(F.col("match_rank").isNull() & F.col(index).isNotNull()).select(KEY, index, F.col(f"{side}_on").alias("onset"), F.col(f"{side}_off").alias("offset"))


def unmatched(intervals: DataFrame, matches: DataFrame, index: str) -> DataFrame:
    """Intervals of no match: missed events by ``gi``, false alarms by ``pi``."""
    return intervals.join(matches.select(KEY, index), [KEY, index], "left_anti")


def event_counts(gt: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """(key, n_gt, n_pred, tp, fp, fn) for each recording that has any interval."""
    one = lambda df, a, b, c: df.select(KEY, F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"))
    rows = one(gt, 1, 0, 0).unionByName(one(pred, 0, 1, 0)).unionByName(one(matches, 0, 0, 1))
    return rows.groupBy(KEY).agg(F.sum("a").alias("n_gt"), F.sum("b").alias("n_pred"), F.sum("c").alias("tp")).withColumn("fp", F.col("n_pred") - F.col("tp")).withColumn("fn", F.col("n_gt") - F.col("tp"))


def aligned_counts(rows: DataFrame) -> DataFrame:
    """``event_counts`` of ``aligned`` intervals."""
    counts = rows.groupBy(KEY).agg(F.count("gi").alias("n_gt"), F.count("pi").alias("n_pred"), F.count("match_rank").alias("tp"))
    return counts.withColumn("fp", F.col("n_pred") - F.col("tp")).withColumn("fn", F.col("n_gt") - F.col("tp"))


def event_metrics(counts: DataFrame) -> DataFrame:
    return counts.select("*", *precision_recall_f1("tp", "fp", "fn"))


def boundary_errors(gt: DataFrame, pred: DataFrame, matches: DataFrame, tolerance_ms: float | None = None) -> DataFrame:
    """(key, gi, pi, onset_error_ms, offset_error_ms) of matched pairs, both within the tolerance where one is given."""
    g = gt.select(KEY, "gi", F.col("onset").alias("g_on"), F.col("offset").alias("g_off"))
    p = pred.select(KEY, "pi", F.col("onset").alias("p_on"), F.col("offset").alias("p_off"))
    return aligned_errors(matches.select(KEY, "gi", "pi", F.lit(0).alias("match_rank")).join(g, [KEY, "gi"]).join(p, [KEY, "pi"]), tolerance_ms)


def aligned_errors(rows: DataFrame, tolerance_ms: float | None = None) -> DataFrame:
    """``boundary_errors`` of ``aligned`` intervals."""
    if tolerance_ms is not None and tolerance_ms < 0:
        raise ValueError("the tolerance must not be negative")
    both = rows.filter("match_rank is not null")
    errors = both.select(KEY, "gi", "pi", ((F.col("p_on") - F.col("g_on")) * 1000).alias("onset_error_ms"), ((F.col("p_off") - F.col("g_off")) * 1000).alias("offset_error_ms"))
    return errors if tolerance_ms is None else errors.filter((F.abs("onset_error_ms") <= tolerance_ms) & (F.abs("offset_error_ms") <= tolerance_ms))


def error_stats(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: n_matches, and for both errors the median, mean absolute value and its 95th percentile; NaN without rows or for NaN errors.

    Keys of a bounded number of errors are sorted as arrays, many at a time; of larger ones percentiles are selected by
    ``quantiles``.
    """
    sides = ("onset", "offset")
    value = {f"{side}_{name}": F.col(f"{side}_error_ms") if name == "median" else F.abs(f"{side}_error_ms") for side in sides for name in ("median", "p95")}
    rows = materialise(errors.select(*keys, *(f"{side}_error_ms" for side in sides)))

    def stats(df: DataFrame, percentiles: bool) -> DataFrame:
        out = [F.count("*").alias("n_matches")]
        for side in sides:
            e = F.col(f"{side}_error_ms")
            found = {"mae": F.avg(F.abs(e))} | ({"median": F.median(e), "p95": F.percentile(F.abs(e), F.lit(0.95))} if percentiles else {})
            out += [F.when(F.max(F.isnan(e)), float("nan")).otherwise(F.coalesce(x, F.lit(float("nan")))).alias(f"{side}_{name}_ms") for name, x in found.items()]
        return df.groupBy(*keys).agg(*out)

    small, large = by_size(rows, keys)
    names = ["n_matches", *STATS]
    few = _few_stats(small, keys) if keys else stats(small, True)
    if large is None:
        return few.select(*keys, *names)
    # Each of the four percentiles of a key is a key of its own.
    share = F.when(F.col("_what").endswith("median"), 0.5).otherwise(0.95)
    apart = large.select(*keys, F.explode(F.array(*(F.struct(F.lit(k).alias("_what"), v.alias("_x")) for k, v in value.items()))).alias("_e")).select(*keys, "_e.*")
    picked = select_ranks(materialise(apart), [*keys, "_what"], around(share)).withColumn("_v", between("picks", 0, share))
    wide = picked.groupBy(*keys).agg(*(F.max(F.when(F.col("_what") == k, F.col("_v"))).alias(f"{k}_ms") for k in value))
    whole = stats(large, False)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    nan = lambda side, c: F.when(F.isnan(f"a.{side}_mae_ms"), float("nan")).otherwise(F.col(f"b.{c}"))
    both = whole.alias("a").join(wide.alias("b"), same).select(*(F.col(f"a.{k}") for k in keys), "n_matches", *(F.col(f"a.{c}") if c.endswith("mae_ms") else nan(c.split("_")[0], c).alias(c) for c in STATS))
    return both.unionByName(few) if keys else both


def _few_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``error_stats`` of keys none of which has more errors than one array holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            new = changes([table[k].chunk(0) for k in keys], len(table))
            group, first = np.cumsum(new) - 1, np.flatnonzero(new)
            out = [np.bincount(group)]
            for side in ("onset", "offset"):
                e = table[f"{side}_error_ms"].chunk(0)
                there = e.is_valid().to_numpy(zero_copy_only=False)
                x, of = e.to_numpy(zero_copy_only=False)[there], group[there]
                n = np.bincount(of, minlength=len(first))
                with np.errstate(invalid="ignore"):
                    out += [_at_share(x, of, n, 0.5), np.bincount(of, np.abs(x), len(first)) / n, _at_share(np.abs(x), of, n, 0.95)]
                bad = np.bincount(of[np.isnan(x)], minlength=len(first)) > 0
                for v in out[-3:]:
                    v[bad] = np.nan
            yield pa.RecordBatch.from_arrays([*(table[k].chunk(0).take(pa.array(first)) for k in keys), *map(pa.array, out)], names=[*keys, "n_matches", *STATS])

    kinds = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ", ".join([*kinds, "n_matches long", *(f"{c} double" for c in STATS)]))


def _at_share(x: np.ndarray, group: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """The value at a share of each group's order, between two values where it falls there; NaN for none. ``n``: sizes."""
    out = np.full(len(n), np.nan)
    some = n > 0
    line = x[np.lexsort((x, group))]
    at = (n[some] - 1) * share
    low = (np.cumsum(n) - n)[some] + np.floor(at).astype(np.int64)
    high = (np.cumsum(n) - n)[some] + np.ceil(at).astype(np.int64)
    out[some] = line[low] + (line[high] - line[low]) * (at - np.floor(at))
    return out


def frame_metrics(frames: DataFrame, keys: list[str], threshold: float = 0.5, prob: str = "prob", label: str = "label") -> DataFrame:
    """Counts and ratios of flagged against labelled frames, in one pass."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must lie in [0, 1]")
    said, true = at_least(prob, threshold), at_least(F.col(label).cast("double"), 0.5)
    count = lambda c, name: F.sum(c.cast("long")).alias(name)
    sums = [count(said & true, "tp"), count(said & ~true, "fp"), count(~said & true, "fn"), count(~said & ~true, "tn")]
    counts = frames.groupBy(*keys).agg(*sums) if keys else frames.agg(*sums)
    return counts.select("*", *precision_recall_f1("tp", "fp", "fn"))


def evaluation_rows(recordings: DataFrame, counts: DataFrame, errors: DataFrame, frames: DataFrame) -> DataFrame:
    """One row for each of ``recordings`` (key, duration_s): event counts and ratios, frame counts and ratios (their names
    begin with frame_), and statistics of boundary errors, NaN without matches. ``frames`` has prob and label."""
    event = ["n_gt", "n_pred", "tp", "fp", "fn"]
    flagged = frame_metrics(frames, [KEY]).select(KEY, *(F.col(c).alias(f"frame_{c}") for c in FRAME_COUNTS))
    joined = recordings.select(KEY, "duration_s")
    for side in (counts.select(KEY, *event), flagged, error_stats(errors, [KEY])):
        joined = joined.join(side.hint("merge"), KEY, "left")  # a row for each recording: too many for a broadcast
    filled = joined.fillna(0, [*event, *(f"frame_{c}" for c in FRAME_COUNTS), "n_matches"]).fillna(float("nan"), STATS)
    framed = [c.alias(f"frame_{n}") for c, n in zip(precision_recall_f1("frame_tp", "frame_fp", "frame_fn"), ("precision", "recall", "f1"))]
    return filled.select(KEY, "duration_s", *event, *precision_recall_f1("tp", "fp", "fn"), *(f"frame_{c}" for c in FRAME_COUNTS), *framed, "n_matches", *STATS)


def evaluation_report(rows: DataFrame, errors: DataFrame) -> DataFrame:
    """One row over all recordings of ``evaluation_rows``: ratios of summed counts, of events and of frames, statistics of
    the pooled errors, and false positives a minute."""
    sums = ["n_gt", "n_pred", "tp", "fp", "fn", *(f"frame_{c}" for c in FRAME_COUNTS)]
    total = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in sums), (F.coalesce(F.sum("duration_s"), F.lit(0.0)) / 60).alias("minutes"))
    framed = [c.alias(f"frame_{n}") for c, n in zip(precision_recall_f1("frame_tp", "frame_fp", "frame_fn"), ("precision", "recall", "f1"))]
    rated = total.select("*", *precision_recall_f1("tp", "fp", "fn"), *framed, F.when(F.col("minutes") > 0, F.col("fp") / F.nullif(F.col("minutes"), F.lit(0.0))).otherwise(0.0).alias("fp_per_minute"))
    one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731  each side is one row
    return one(rated).join(one(error_stats(errors, [])), "_one").drop("_one")
