"""Exact order statistics and sliding medians against NumPy, with keys beyond every bound."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonora.operators import features, matching, quantiles


def keyed(seed):
    rng = random.Random(seed)
    out = {"hot": [rng.gauss(0, 1) for _ in range(3000)], "ties": [rng.choice([0.0, 1.0, 1.0, 1.0, 7.0]) for _ in range(900)], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-200, 200) for _ in range(700)], "same": [2.5] * 400, None: [rng.random() for _ in range(300)], "one": [4.0], "few": [3.0, 1.0]}
    return out


def table(spark, held):
    rows = [(k, i, v) for k, vs in held.items() for i, v in enumerate(vs)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "k string, i int, v double").repartition(5)


def test_ranks(spark, monkeypatch):
    """Ranks of keys of all sizes, with ties and numbers of all magnitudes; a coarse sketch, so that several passes are needed."""
    for name, x in (("LIMIT", 20), ("POINTS", 10), ("ACCURACY", 50)):
        monkeypatch.setattr(quantiles, name, x)
    held = keyed(2)
    n = F.col("n")
    got = quantiles.select_ranks(table(spark, held), ["k"], [F.lit(0), n - 1, F.floor((n - 1) / 2), F.floor((n - 1) * 0.95)], "v")
    want = {k: [sorted(v)[r] for r in (0, len(v) - 1, (len(v) - 1) // 2, int((len(v) - 1) * 0.95))] for k, v in held.items()}
    assert {r["k"]: (r["n"], r["picks"]) for r in got.collect()} == {k: (len(held[k]), p) for k, p in want.items()}
    odd = spark.createDataFrame([(float("nan"),)] * 30 + [(1.0,)] * 25 + [(None,)] * 50, "v double")
    row = quantiles.select_ranks(odd, [], [F.lit(0), F.lit(24), n - 1], "v").first()
    assert row["n"] == 55 and row["picks"][:2] == [1.0, 1.0] and math.isnan(row["picks"][2])
    assert quantiles.select_ranks(odd.limit(0), [], [F.lit(0)], "v").count() == 0


@pytest.mark.parametrize("keys", [["k"], []])
def test_values_are_never_broadcast(spark, monkeypatch, keys):
    """Values that repeat make a small file, so that Spark would send them to all tasks, by way of the driver, as the smaller side."""
    plans, held = [], quantiles.materialise

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return held(df)

    for name, x in (("LIMIT", 100), ("POINTS", 5), ("ACCURACY", 10)):
        monkeypatch.setattr(quantiles, name, x)
    rows = held(spark.range(60_000).selectExpr("'a' AS k", "double(id % 800) AS v"))
    monkeypatch.setattr(quantiles, "materialise", kept)
    got = quantiles.select_ranks(rows, keys, [F.lit(0), F.lit(30_000), F.col("n") - 1], "v")
    assert got.first()["picks"] == [0.0, 400.0, 799.0]
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    joins = [line for p in plans for line in p.splitlines() if "Join" in line and "_lo" in line]
    assert len(joins) > 3 and all("BuildRight" in j for j in joins)


@pytest.mark.parametrize("limit", [1 << 18, 50])
def test_normalising_keys_of_all_sizes(spark, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "LIMIT", limit)
    held = {k: v for k, v in keyed(3).items() if k != "wide"}
    got = features.robust_normalize(table(spark, held), "v", ["k"], 0.01)
    lower = lambda a: np.sort(a)[(len(a) - 1) // 2]
    by_key = {}
    for r in got.collect():
        by_key.setdefault(r["k"], []).append((r["i"], r["z"]))
    for k, v in held.items():
        x = np.array(v)
        want = (x - lower(x)) / (1.4826 * (lower(np.abs(x - lower(x))) + 0.01))
        assert [z for _, z in sorted(by_key[k])] == pytest.approx(want.tolist(), rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("limit", [1 << 18, 30])
@pytest.mark.parametrize("keys", [["recording_id"], []])
def test_error_stats_of_keys_of_all_sizes(spark, monkeypatch, limit, keys):
    monkeypatch.setattr(quantiles, "LIMIT", limit)
    rng = random.Random(4)
    rows = [(k, rng.gauss(0, 9), rng.choice([-5.0, 0.0, 2.0])) for k, n in (("a", 200), ("b", 31), ("c", 5)) for _ in range(n)]
    rows += [("bad", float("nan"), 1.0)] * 40 if keys else []
    df = spark.createDataFrame(rows, "recording_id string, onset_error_ms double, offset_error_ms double").repartition(3)
    found = {r["recording_id"] if keys else None: r for r in matching.error_stats(df, keys).collect()}
    for k in {r[0] for r in rows} if keys else [None]:
        e = np.array([r[1:] for r in rows if k is None or r[0] == k])
        want = [len(e), *(f(e[:, j]) for j in (0, 1) for f in (np.median, lambda x: np.abs(x).mean(), lambda x: np.percentile(np.abs(x), 95)))]
        assert list(found[k][1 if keys else 0 :]) == pytest.approx(want, nan_ok=True)
    nothing = matching.error_stats(df.limit(0), keys).collect()
    assert not nothing if keys else nothing[0]["n_matches"] == 0 and math.isnan(nothing[0]["onset_median_ms"])


def test_error_stats_of_few_errors(spark):
    """Nulls don't count, NaN makes a side NaN, null keys are a key, and a key without numbers has none."""
    nan = float("nan")
    rows = [("a", 1.0, None), ("a", -3.0, 4.0), ("a", 10.0, nan), (None, 2.0, 8.0), (None, 5.0, -8.0), ("b", None, 1.0)]
    got = matching.error_stats(spark.createDataFrame(rows, "recording_id string, onset_error_ms double, offset_error_ms double"), ["recording_id"])
    want = {"a": [3, 1.0, 14 / 3, 9.3, nan, nan, nan], None: [2, 3.5, 3.5, 4.85, 0.0, 8.0, 8.0], "b": [1, nan, nan, nan, 1.0, 1.0, 1.0]}
    assert {r[0]: list(r[1:]) for r in got.collect()} == {k: pytest.approx(v, nan_ok=True) for k, v in want.items()}
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kernel", [1, 3, 9, 251])
@pytest.mark.parametrize("run", [16, 4096])
def test_sliding_medians(spark, monkeypatch, many_ranges, kernel, run):
    """Ties, nulls, kernels beyond a run or a recording, rows without numbers, recordings of one row."""
    monkeypatch.setattr(features, "RUN", run)
    rng = random.Random(6)
    held = {k: [rng.choice([None, 1.0, 2.0, rng.random(), -rng.random()]) for _ in range(n)] for k, n in (("a", 300), ("b", 1), (None, 17), ("c", 64))}
    rows = [(k, 10 * i - 7, i, v, [k]) for k, vs in held.items() for i, v in enumerate(vs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at int, i int, v double, x array<string>").repartition(3)
    for order, dense in (("at", False), ("i", True)):
        got = features.median_filter(df, "v", kernel, ["k"], order, "m", dense)
        assert got.columns == [*df.columns, "m"]
        found = {(r["k"], r["i"]): r["m"] for r in got.collect()}
        for k, vs in held.items():
            line = np.pad([v or 0.0 for v in vs], kernel // 2)
            assert [found[k, i] for i in range(len(vs))] == [np.median(line[i : i + kernel]) for i in range(len(vs))]


def test_a_wide_kernel_costs_what_a_narrow_one_does():
    import time

    x = np.random.RandomState(1).rand(40_000)
    took = {}
    for kernel in (9, 1251, 9, 1251):
        t = time.process_time()
        features.sliding_medians(np.pad(x, kernel // 2), np.arange(len(x)), kernel)
        took[kernel] = time.process_time() - t
    assert took[1251] < 2 * took[9]
