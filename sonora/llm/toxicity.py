"""Operator 9, toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed words, word pairs and pairs with one word left out of a whole text; here words are
runs of letters and digits, so that marks around them or between them don't tell. Each coordinate has a learning rate
of its own (the more it was updated, the slower) and an L1 penalty keeps most weights at zero, so the model is a small
sparse table whatever the corpus, and is broadcast. The penalty is the same for words, pairs and skip-grams, and grows
with the root of the number of training rows that hold the feature: as far as gradients of a feature that tells nothing
stray. So pairs, which are many and rare, needn't be shut out to keep chance out, and those that tell keep their weight.

Training reads at most ``rows`` labelled documents (those first by a hash of doc_id, so the bound keeps no
order of the table). Their features are hashed where the texts are, and one task trains on them, as few labels should
not be parted. The penalty shrinks the log odds, so weights and bias are then scaled by a two-parameter logistic fit
to the rows. Scoring reads every document.

Defined cases: a null or blank text has no features and scores by the bias alone; without labelled rows every
document scores 0.0; repeated rows score alike; rows with a null doc_id or a null label are not trained on; an
empty table gives no rows; other columns are not read (``reject`` keeps them). Labels that contradict each other
for one doc_id count as toxic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import IS_MARK, arrow_bytes, gram_hashes, mix, small_batches, text_or_empty, word_hashes

BITS, TRAIN_ROWS, EPOCHS = 20, 12_000, 6
ALPHA, BETA, L2 = 1.0, 1.0, 0.1
#: A feature's penalty: a constant, and a factor of the root of the number of training rows that hold it.
L1, L1_ROOT = 4.0, 1.5
REJECT = 0.7


def features(texts: pa.Array, bits: int = BITS, rows: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For a few rows at a time: hashed features of all of them, and where each row's begin (one more at the end).

    Words have the lower half of the buckets, pairs the upper one.
    """
    for lo in range(0, len(texts), rows):
        buf, at = arrow_bytes(texts.slice(lo, rows))
        words, first = word_hashes(buf, at, IS_MARK)
        row = np.repeat(np.arange(len(at) - 1), np.diff(first))
        top = np.uint64(1 << 63)
        kinds = [(words & ~top, row)]
        for gap in (1, 2):
            if len(words) > gap:
                pair = gram_hashes(words, 2) if gap == 1 else mix(mix(words[:-2]) + words[2:] + np.uint64(0x51ED2701))
                inside = row[:-gap] == row[gap:]
                kinds.append((pair[inside] | top, row[:-gap][inside]))
        key = np.concatenate([r.astype(np.int64) << bits | (h >> np.uint64(64 - bits)).astype(np.int64) for h, r in kinds])
        key = np.unique(key)
        yield (key & (1 << bits) - 1).astype(np.int32), np.searchsorted(key, np.arange(len(at)) << bits)


def train_rows(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over (features, label) rows in the given order: buckets, their weights, and the bias."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias, grad2 = 0.0, 0.0
    if rows:
        share = min(max(sum(y for _, y in rows) / len(rows), 1e-3), 1 - 1e-3)
        bias = float(np.log(share / (1 - share)))
    held = np.zeros(1 << bits)
    for at, _ in rows:
        held[at] += 1
    penalty = L1 + L1_ROOT * np.sqrt(held)
    weight = lambda z, n, l1: np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    for _ in range(epochs):
        for at, y in rows:
            zs, ns = z[at], n[at]
            w = weight(zs, ns, penalty[at])
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - y
            sigma = (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA
            z[at], n[at] = zs + g - sigma * w, ns + g * g
            grad2 += g * g
            bias -= ALPHA * g / (BETA + np.sqrt(grad2))
    w = weight(z, n, penalty)
    at = np.flatnonzero(w)
    if not len(at):
        return at, w[at], bias
    slope, shift = calibrated(np.array([w[f].sum() + bias for f, _ in rows]), np.array([y for _, y in rows], float))
    return at, w[at] * slope, bias * slope + shift


def calibrated(margin: np.ndarray, y: np.ndarray, steps: int = 20) -> tuple[float, float]:
    """Slope (at least 1) and shift of the log odds that fit the labels, by Newton steps with a small ridge toward none."""
    x, theta = np.column_stack([margin, np.ones(len(margin))]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (p - y) + (theta - [1.0, 0.0])
        theta = theta - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(2), grad)
        theta[0] = min(max(theta[0], 1.0), 10.0)
    return float(theta[0]), float(theta[1])


def held_out(doc_id: Column) -> Column:
    """True for the third of all ids whose labels are never learned."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_labels(labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` labelled ids outside the held-out third, first by a hash of the id: safe to broadcast."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    return usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def mixed(ids: np.ndarray) -> int:
    return int(mix(ids.view(np.uint64))[0])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets (sorted), weights and bias."""
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    sample = texts.join(F.broadcast(sample_labels(labels, rows)), "doc_id").select("doc_id", "toxic", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [f[a:b].tobytes() for f, first in features(batch.column(2), bits) for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary())], names=["doc_id", "toxic", "at"])

    def fit(key, table):
        ids, y = table["doc_id"].to_numpy(), table["toxic"].to_pylist()
        at = [x.as_py() for x in table["at"]]
        # An order of their own for the rows, whatever order they came in; features tell repeated ids apart.
        order = sorted(range(len(y)), key=lambda i: (mixed(ids[i : i + 1]), at[i]))
        where, w, bias = train_rows([(np.frombuffer(at[i], np.int32), y[i]) for i in order], bits)
        return pa.table({"at": np.append(where, -1), "w": np.append(w, bias)})

    # One group, of a bounded number of rows; a row's features are bounded by the number of buckets.
    got = sample.mapInArrow(hashed, "doc_id long, toxic int, at binary").withColumn("all", F.lit(0)).groupBy("all").applyInArrow(fit, "at long, w double").toArrow().sort_by("at")
    if not len(got):
        return np.zeros(0, np.int64), np.zeros(0), -np.inf
    at, w = got["at"].to_numpy(), got["w"].to_numpy()
    return at[1:], w[1:], float(w[0])


def scorer(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS):
    """A function of an Arrow text column that gives each row's probability."""
    at, w, bias = model
    dense = docs.sparkSession.sparkContext.broadcast((at.astype(np.int64), w.astype(np.float64), bias))

    def run(texts: pa.Array) -> np.ndarray:
        at, w, bias = dense.value
        table = np.zeros(1 << bits)
        table[at] = w
        out = [np.zeros(0)]
        for f, first in features(texts, bits):
            total = np.concatenate([[0.0], np.cumsum(table[f])])
            out.append(total[first[1:]] - total[first[:-1]] + bias)
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -700, 700)))

    return run


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out and the probability of label 1 for every document."""
    scored = scorer(docs, train(docs, labels, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(scored(batch.column(1)), 9))], names=["doc_id", "score"])

    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs``, all columns, without the rows whose score reaches REJECT."""
    scored, place = scorer(docs, train(docs, labels, rows)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(np.round(scored(batch.column(place)), 9) < REJECT))

    return docs.mapInArrow(run, docs.schema)
