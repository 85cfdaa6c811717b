"""Scans over ranges against plain loops, with keys that span many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from sonora.operators import scan


@pytest.mark.parametrize("kind", ["sum", "max", "last"])
@pytest.mark.parametrize("batch", [3, 10000])
def test_folds(spark, kind, batch):
    rng = random.Random(7)
    rows = []
    for key, n in (("a", 300), ("b", 1), ("c", 2), (None, 120), ("d", 40), ("e", 500)):
        rows += [(key, i, rng.choice([None, rng.randint(-9, 9)]) if key != "e" or i > 400 else None) for i in range(n)]
    held = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", 9)
        shuffled = rows[:]
        rng.shuffle(shuffled)
        df = spark.createDataFrame(shuffled, "k string, i int, v int").repartition(5)
        got = {(r["k"], r["i"]): r["b"] for r in scan.before(df, ["k"], ["i"], "b", F.col("v"), kind).collect()}
        alone = {r["i"]: r["b"] for r in scan.before(df.filter("k = 'a'").select("i", "v"), [], ["i"], "b", F.col("v"), kind).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(got) == len(rows)
    for k, i, _ in rows:
        seen = [v for key, j, v in rows if key == k and j < i and v is not None]
        want = (sum(seen) if i else None) if kind == "sum" else None if not seen else max(seen) if kind == "max" else seen[-1]
        assert got[k, i] == want, (k, i)
        if k == "a":
            assert alone[i] == want


def test_numbers_and_empty(spark):
    df = spark.createDataFrame([("a", 3, [1.0]), ("a", 1, None), ("b", 0, [])], "k string, i int, x array<double>")
    assert sorted((r["k"], r["i"], r["n"]) for r in scan.numbered(df, ["k"], ["i"], "n").collect()) == [("a", 1, 0), ("a", 3, 1), ("b", 0, 0)]
    assert scan.before(df.limit(0), ["k"], ["i"], "b", F.lit(1)).count() == 0
    with pytest.raises(ValueError):
        scan.before(df, ["k"], ["i"], "b", F.lit(1), "min")
