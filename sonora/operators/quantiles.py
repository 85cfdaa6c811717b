"""Exact order statistics of many keys at once, whatever their sizes.

A key of up to ``LIMIT`` values is sorted as one array. Of larger keys no task ever holds the values: each rank asked for is
bracketed by two neighbouring points of a sketch of its values (``percentile_approx``, whose buffer is bounded), the values
below, within and above are counted exactly, and the part that holds the rank is bracketed again, until it has ``LIMIT``
values at most or one value alone. A pass leaves some three thousandths, so two or three passes select from billions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonora.sources.storage import materialise

#: Values of a key that are sorted as one array at most.
LIMIT = 1 << 18
#: Points of the sketch, and its accuracy: a point's rank is off by one in so many at most.
POINTS, ACCURACY = 1000, 10_000


def _same(a: str, b: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def _within(named: DataFrame, targets: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Each value with the targets of its key whose part holds it. ``few`` targets, ranks of large keys, go to every task;
    else both sides are dealt by key. Spark's own guess would take the values for the smaller side: stored values that
    repeat make small files, and a join's result counts as the product of its sides."""
    side = F.broadcast(targets) if few or not keys else targets.hint("merge")
    return named.alias("r").join(side.alias("t"), _same("r", "t", keys) & (F.col("r._x") >= F.col("t._lo")) & (F.col("r._x") <= F.col("t._hi"))).select("t.*", "r._x")


def by_size(rows: DataFrame, keys: list[str], limit: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys of up to ``limit`` rows, and of the others, if there are any. ``rows`` are read more than once."""
    large = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > (limit or LIMIT)).select(*keys, "_n")
    if large.isEmpty():
        return rows, None
    if not keys:
        return rows.filter(F.lit(False)), rows
    large = materialise(large)
    part = lambda how: rows.alias("r").join(large.alias("l"), _same("r", "l", keys), how).select("r.*")
    return part("left_anti"), part("left_semi")


def select_ranks(rows: DataFrame, keys: list[str], ranks: list[Column], value: str = "_x", limit: int | None = None) -> DataFrame:
    """(keys, n, picks): the values at the ``ranks`` (from 0) of each key's values in order; NaN comes last, nulls don't count.

    ``ranks`` are expressions of ``n``, the number of values, and the keys. ``rows`` are read in every pass.
    """
    most = limit or LIMIT
    named = rows.select(*keys, F.col(value).cast("double").alias("_x")).filter("_x is not null")
    totals = named.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    asked = totals.select(*keys, "n", "_lo", "_hi", F.posexplode(F.array(*(r.cast("long") for r in ranks))).alias("_t", "_rank"))
    # Each rank lies among the _in values from _lo to _hi, below which there are _below.
    left = materialise(asked.withColumns({"_below": F.lit(0).cast("long"), "_in": F.col("n")}))
    settled = left.limit(0)
    while True:
        ready = (F.col("_in") <= most) | (F.col("_lo") == F.col("_hi"))
        settled = settled.unionByName(left.filter(ready))
        left = left.filter(~ready)
        if left.isEmpty():
            break
        left = materialise(_narrowed(named, left, keys))
    one = settled.filter("_lo = _hi").select(*keys, "n", "_t", F.col("_lo").alias("_pick"))
    apart = settled.filter("not _lo = _hi")
    held = _within(named, apart.filter(F.col("n") > most), keys, True)
    small = apart.filter(F.col("n") <= most)
    if not small.isEmpty():
        held = held.unionByName(_within(named, small, keys, False))
    few = held.groupBy(*keys, "n", "_t", "_rank", "_below").agg(F.sort_array(F.collect_list("_x")).alias("_v"))
    picked = one.unionByName(few.select(*keys, "n", "_t", F.get("_v", (F.col("_rank") - F.col("_below")).cast("int")).alias("_pick")))
    return picked.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("_t", "_pick"))).alias("_p")).select(*keys, "n", F.transform("_p", lambda p: p["_pick"]).alias("picks"))


def _narrowed(named: DataFrame, left: DataFrame, keys: list[str]) -> DataFrame:
    """One pass: of each rank's values the part that holds it. A sketch names three points about the rank, and the parts are
    what lies below, between, at and above them. The middle point is a value, and a part of its own, so parts always shrink."""
    of = [*keys, "_t"]
    points = _within(named, left, keys, True).groupBy(*of).agg(F.percentile_approx("_x", [i / POINTS for i in range(POINTS + 1)], ACCURACY).alias("_points"))
    place = F.col("_rank") - F.col("_below")
    share = F.floor(place * POINTS / F.col("_in")).cast("int")
    point = lambda i: F.get("_points", F.greatest(F.lit(0), F.least(F.lit(POINTS), i)))
    cut = left.alias("l").join(points.alias("p"), _same("l", "p", of)).select("l.*", point(share - 1).alias("_a"), point(share).alias("_c"), point(share + 2).alias("_b"))
    x, a, b, c = (F.col(n) for n in ("_x", "_a", "_b", "_c"))
    parts = [x < a, (x >= a) & (x < c), x == c, (x > c) & (x <= b), x > b]
    found = _within(named, cut, keys, True).groupBy(*left.columns, "_a", "_b", "_c").agg(*(f(F.when(p, x)).alias(f"{name}{i}") for i, p in enumerate(parts) for name, f in (("_n", F.count), ("_min", F.min), ("_max", F.max))))
    new = dict.fromkeys(("_lo", "_hi", "_below", "_in"), F.lit(None))
    for i in reversed(range(len(parts))):
        less = sum((F.col(f"_n{j}") for j in range(i)), F.lit(0))
        here = {"_lo": F.col(f"_min{i}"), "_hi": F.col(f"_max{i}"), "_below": F.col("_below") + less, "_in": F.col(f"_n{i}")}
        new = {k: F.when(place < less + F.col(f"_n{i}"), v).otherwise(new[k]) for k, v in here.items()}
    return found.select(*(new[k].alias(k) if k in new else F.col(k) for k in left.columns))


def between(picks: str, first: int, share: Column, n: str = "n") -> Column:
    """The value at ``share`` of a key's order, between the two picks from ``first`` on, which are at the ranks of ``around``."""
    at = (F.col(n) - 1) * share
    low, high = F.get(picks, F.lit(first)), F.get(picks, F.lit(first + 1))
    return low + (high - low) * (at - F.floor(at))


def around(share: Column, n: str = "n") -> list[Column]:
    """The two ranks that a share of a key's order lies between."""
    at = (F.col(n) - 1) * share
    return [F.floor(at), F.ceil(at)]
