"""Operator 13 against all products, and its intervals."""

import numpy as np
import pytest

from sonora.llm import negatives


def brute(rows, positives=5, count=3, low=50, high=95, every=50, scale=256):
    ints = [(i, label, [int(np.floor(scale * x)) if abs(x) < 1e12 else int(scale * x) for x in v]) for i, v, label in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in sorted({x[0]: x for x in sorted(ints, key=lambda x: (x[0], x[1], x[2]), reverse=True) if x[0] % every == 0}.values()):
        near = sorted((-dot(v, w), j) for j, other, w in ints if other == label and j != i)[:positives]
        far = sorted((-dot(v, w), j) for j, other, w in ints if other != label)
        for p, j in near:
            fits = [(s, k) for s, k in far if low * -p <= 100 * -s <= high * -p][:count]
            out += [(i, j, r + 1, k, -p, -s) for r, (s, k) in enumerate(fits)]
    return sorted(out)


def vectors(rng, n, width, labels, size=1.0, hot=0.4):
    centres = rng.normal(size=(labels, width))
    label = np.where(rng.uniform(size=n) < hot, 0, rng.randint(0, labels, n))
    v = rng.normal(size=(n, width)) + centres[rng.randint(0, labels, n)]
    v = v / np.linalg.norm(v, axis=1, keepdims=True) * size
    return [(i, [float(np.float32(x)) for x in v[i]], int(label[i])) for i in range(n)]


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "vec_id long, embedding array<double>, label int, rank string, block int").repartition(5)
    return sorted(map(tuple, negatives.hard_negatives(df, **more).collect()))


def test_whole_result(spark, monkeypatch):
    """Blocks and matrices smaller than the table; a label of 40 % of all rows, ties, repeated rows, nulls and odd vectors."""
    for name, value in (("BLOCK", 150), ("ROWS", 64), ("QUERIES", 3)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(np.random.RandomState(2), 600, 12, 5)
    rows += [(600 + i, rows[50][1], i % 2) for i in range(60)]  # ties
    rows += [(50, rows[50][1], rows[50][2]), (100, rows[7][1], 3), (7, rows[7][1], rows[7][2]), (700, [], 1), (750, [0.25, -0.5], 2), (800, [0.0] * 12, 2)]
    odd = [(850, None, 1), (900, [1.0, None], 1), (950, [float("nan")] * 12, 1), (1000, [float("inf")] * 12, 1), (1050, [1.0] * 12, None), (None, [1.0] * 12, 1)]
    assert mined(spark, rows + odd) == brute(rows)
    assert mined(spark, rows, positives=2, negatives=4, low=10, high=80, every=20) == brute(rows, 2, 4, 10, 80, 20)


@pytest.mark.parametrize("size", [3e4, 1e6, 1e7])
def test_large_components(spark, size):
    rows = vectors(np.random.RandomState(4), 160, 6, 3, size)
    got = mined(spark, rows)
    assert got and got == brute(rows)


def test_scores_beyond_64_bits(spark):
    """Such scores are all held to the largest number, so no score lies between a half of one and one."""
    assert mined(spark, vectors(np.random.RandomState(4), 160, 6, 3, 1e20)) == []


def test_empty_and_lonely(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [0.5] * 4, 1)]) == []
    assert mined(spark, [(0, [0.5] * 4, 1), (1, [0.5] * 4, 1)]) == []
    assert mined(spark, [(0, [0.5] * 4, 1), (1, [0.5] * 4, 1), (2, [0.4] * 4, 2)]) == [(0, 1, 1, 2, 65536, 52224)]
    with pytest.raises(ValueError):
        negatives.hard_negatives(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), every=0)


def test_moved_labels(spark):
    df = spark.createDataFrame([(i, i % 10) for i in range(30)], "vec_id long, label int").select("vec_id", negatives.moved_label().alias("l"))
    assert all(r.l == ((r.vec_id + 1) % 10 if r.vec_id % 7 == 0 else r.vec_id % 10) for r in df.collect())


@pytest.mark.parametrize("kind", [np.float64, np.float32, object])
def test_planes_and_intervals(kind):
    """Planes add up to the vectors; intervals hold the score after each plane and spare most pairs of the later ones."""
    rng = np.random.RandomState(6)
    values = np.array([np.floor(256 * np.array(r[1])) for r in vectors(rng, 800, 24, 8)])
    planes = negatives.Planes(values, kind)
    assert (sum(planes.rows(i, 0, 800) * f for i, (f, _) in enumerate(planes.weights)) == values).all()
    anchors, ids, labels = negatives._integers(values[:40], kind), np.arange(800), np.zeros(800, np.int64)
    seen = []

    def watch(low, high, of, kth):
        seen.append(np.broadcast_to(high >= of(kth(np.ones(low.shape, bool), 5)), low.shape).mean())
        return high >= of(kth(np.ones(low.shape, bool), 5))

    a, c, score, done = negatives.surviving(planes, 0, 800, anchors, ids[None] != ids[:40, None], watch)
    exact = values[:40] @ values.T
    assert (score.astype(float) == exact[a, c]).all()
    assert done < 0.75 * planes.bits * 40 * 799
    best = negatives.best_positives(planes, ids, labels, ids[:40], labels[:40], anchors, 5)
    want = [sorted((-exact[i, j], j) for j in range(800) if j != i)[:5] for i in range(40)]
    assert [[(-s, j) for i, j, s in zip(*best) if i == k] for k in range(40)] == want
