"""Windows with features and labels, splits and batches of them, and synchronous training in barrier stages."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonora.functions import checks
from sonora.functions.signal import precision_recall_f1
from sonora.operators import model, windows
from sonora.sources.storage import materialise, stored

from .components import KEY, BceLoss, Callback, Extractor, Loss, TinySegCnn


def training_windows(frames: DataFrame, width: int, hop: int, features: str = "features", label: str = "label") -> DataFrame:
    """(recording_id, start_frame, features by band, labels) of all whole windows of frames that are numbered from 0.

    A frame goes to each of the windows that hold it, so no task needs a recording. Recordings shorter than a window
    have none.
    """
    if not 0 < hop <= width:
        raise ValueError("the hop must lie between one frame and the window's width")
    at = F.col("frame_idx")
    first = F.greatest(F.lit(0), F.ceil((at - width + 1) / F.lit(hop))).cast("int")
    held = frames.select(KEY, "frame_idx", F.col(features).cast("array<double>").alias("_x"), F.col(label).cast("double").alias("_y"), F.explode(F.sequence(first, F.floor(at / F.lit(hop)).cast("int"))).alias("_w"))
    rows = held.groupBy(KEY, (F.col("_w") * hop).alias("start_frame")).agg(F.sort_array(F.collect_list(F.struct("frame_idx", "_x", "_y"))).alias("_rows")).filter(F.size("_rows") == width)
    bands = F.sequence(F.lit(0), F.size(F.get("_rows", F.lit(0))["_x"]) - 1)
    by_band = F.transform(bands, lambda b: F.transform("_rows", lambda r: F.get(r["_x"], b)))
    return rows.select(KEY, "start_frame", by_band.alias("features"), F.transform("_rows", lambda r: r["_y"]).alias("labels"))


def batched(rows: DataFrame, batch_size: int, seed: int = 0, drop_last: bool = False, keys: tuple[str, ...] = (KEY, "start_frame")) -> DataFrame:
    """Adds ``batch``: rows in an order shuffled by a hash of seed and keys, ``batch_size`` to each; the last may be smaller, or left out."""
    checks.whole(batch_size, "batch_size", 1)
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))
    numbered = windows.numbered(rows.withColumn("_place", place), [], ["_place", *keys], "_number").withColumn("batch", F.floor(F.col("_number") / batch_size).cast("long"))
    if drop_last:
        whole = rows.count() // batch_size
        numbered = numbered.filter(F.col("batch") < whole)
    return numbered.drop("_place", "_number")


def disjoint(split: DataFrame, key: str = KEY) -> bool:
    """Whether each recording is in one split only."""
    return split.groupBy(key).agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()


@dataclass
class DataModule:
    """Recordings (recording_id, duration_s) split by their windows, and the windows of frames (with features and label) in batches."""

    recordings: DataFrame
    frames: DataFrame
    extractor: Extractor
    train_frac: float = 0.7
    val_frac: float = 0.1
    test_frac: float = 0.2
    window_s: float = 2.0
    window_hop_s: float = 0.5
    batch_size: int = 32
    seed: int = 0

    def __post_init__(self) -> None:
        if abs(self.train_frac + self.val_frac + self.test_frac - 1) > 0.01:
            raise ValueError("the fractions must sum to one")
        checks.whole(self.batch_size, "batch_size", 1)
        if self.train_frac <= 0 or min(self.val_frac, self.test_frac) < 0:
            raise ValueError("train_frac must be positive, val_frac and test_frac not negative")
        if not 0 < self.window_hop_s <= self.window_s:
            raise ValueError("the hop must be positive and at most a window")
        self.split: DataFrame | None = None

    def setup(self, stage: str = "fit") -> None:
        """Splits once; other stages than fit change nothing."""
        if stage != "fit" or self.split is not None:
            return
        sized = windows.estimate_windows(self.recordings, self.extractor.hop_s, self.window_s, self.window_hop_s)
        if sized.filter("n_windows > 0").isEmpty():
            raise ValueError("no recording is as long as a window")
        placed = sized.withColumn("_shuffled", F.md5(F.concat_ws(":", F.lit(str(self.seed)), F.col(KEY).cast("string"))))
        self.split = materialise(windows.split_by_windows(placed, self.train_frac, self.val_frac, "_shuffled").drop("_shuffled"))

    def part(self, name: str) -> DataFrame:
        """The recordings of a split: train, val or test."""
        if self.split is None:
            raise RuntimeError("call setup first")
        return self.split.filter(F.col("split") == name)

    @property
    def train_recordings(self) -> DataFrame:
        return self.part("train")

    @property
    def val_recordings(self) -> DataFrame:
        return self.part("val")

    @property
    def test_recordings(self) -> DataFrame:
        return self.part("test")

    @property
    def n_recordings(self) -> int:
        """All recordings, those in no split included."""
        return self.recordings.count()

    @property
    def train_dataset(self) -> DataFrame:
        """The training windows, not in batches."""
        return self.windows("train")

    @property
    def val_dataset(self) -> DataFrame | None:
        """The validation windows; None without such recordings."""
        return None if self.val_recordings.isEmpty() else self.windows("val")

    def windows(self, name: str) -> DataFrame:
        frames = self.frames.join(self.part(name).select(KEY), KEY, "left_semi")
        return training_windows(frames, self.extractor.seconds_to_frames(self.window_s), self.extractor.seconds_to_frames(self.window_hop_s))

    def train_batches(self) -> DataFrame:
        return batched(self.windows("train"), self.batch_size, self.seed, drop_last=True)

    def val_batches(self) -> DataFrame | None:
        return None if self.part("val").isEmpty() else batched(self.windows("val"), self.batch_size, self.seed)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Features (windows, bands, frames) and labels (windows, frames) from Arrow's own buffers."""
    n, bands = len(batch), batch.column(0).flatten()
    values = lambda c: c.to_numpy(zero_copy_only=False).astype(float)
    return values(bands.flatten()).reshape(n, len(bands) // max(1, n), -1) if n else np.zeros((0, 1, 1)), values(batch.column(1).flatten()).reshape(n, -1) if n else np.zeros((0, 1))


def _by_step(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A worker's windows of each step, of rows that come by step."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        steps = batch.column("step").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(steps)) + 1).tolist(), len(batch)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi == lo:
                continue
            if held and held[0].column("step")[0].as_py() != steps[lo]:
                yield held[0].column("step")[0].as_py(), *_whole(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield held[0].column("step")[0].as_py(), *_whole(held)


def _whole(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(parts).combine_chunks()
    return _arrays(pa.RecordBatch.from_arrays([table[c].chunk(0) for c in ("features", "labels")], names=["features", "labels"]))


def _epoch(rows: DataFrame, workers: int, n_steps: int, trained: model.Weights, state: dict, loss: Loss, lr: float) -> tuple[model.Weights, dict, float]:
    """One job: all steps of an epoch, in tasks that keep the weights and add up their gradients step by step.

    ``rows`` have features, labels and step. The tasks run side by side (a barrier stage); after each step all have the same
    sums, in the order of their ranks, and so the same weights. Weights and moments of the first one come back.
    """
    now = rows.sparkSession.sparkContext.broadcast((trained, state))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        weights, moments = now.value
        moments = dict(moments)
        size = sum(a.size for pair in weights for a in pair)
        width = len(loss.sums(np.zeros(1), np.zeros(1)))

        def summed(own: np.ndarray) -> np.ndarray:
            given = context.allGather(base64.b64encode(own.astype("<f8").tobytes()).decode())
            return sum(np.frombuffer(base64.b64decode(x), "<f8") for x in given)

        parts, total, seen = _by_step(batches), 0.0, 0.0
        held = next(parts, None)
        for step in range(n_steps):
            mine, sums, flat = None, np.zeros(width), np.zeros(size)
            if held and held[0] == step:
                mine = held[1:]
                held = next(parts, None)
                logits, inputs = model.forward(weights, mine[0])
                sums = loss.sums(logits, mine[1])
            if loss.needs_sums:
                sums = summed(sums)
                if mine:
                    flat = _flat(model.backward(weights, inputs, loss.gradient(logits, mine[1], sums)))
                flat = summed(flat)
            else:
                if mine:
                    flat = _flat(model.backward(weights, inputs, loss.gradient(logits, mine[1], np.ones(1))))
                both = summed(np.concatenate([sums, flat]))
                sums, flat = both[:width], both[width:] / both[0]
            weights = model.adam(weights, _shaped(flat, weights), moments, lr)
            total, seen = total + loss.value(sums) * sums[0], seen + sums[0]
        if context.partitionId() == 0:
            kept = [_flat(weights), *(_flat([tuple(moments[j, i][k] for i in range(2)) for j in range(len(weights))]) for k in range(2))]
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist() for x in kept], pa.list_(pa.float64())), pa.array([total / seen] * 3), pa.array([moments["t"]] * 3, pa.int64()), pa.array(range(3), pa.int32())], names=["flat", "loss", "t", "part"])

    dealt = rows.repartition(workers, F.xxhash64("features", "labels")).sortWithinPartitions("step")
    found = sorted(dealt.mapInArrow(run, "flat array<double>, loss double, t long, part int", barrier=True).collect(), key=lambda r: r["part"])
    weights, first, second = (_shaped(np.array(r["flat"]), trained) for r in found)
    kept = {(j, i): (first[j][i], second[j][i]) for j in range(len(weights)) for i in range(2)}
    return weights, kept | {"t": found[0]["t"]}, found[0]["loss"]


def _flat(grads: model.Weights) -> np.ndarray:
    return np.concatenate([a.ravel() for pair in grads for a in pair])


def _shaped(flat: np.ndarray, like: model.Weights) -> model.Weights:
    out, at = [], 0
    for pair in like:
        own = []
        for a in pair:
            own.append(flat[at : at + a.size].reshape(a.shape))
            at += a.size
        out.append(tuple(own))
    return out


def validate(batches: DataFrame, weights: model.Weights, loss: Loss) -> dict[str, float]:
    """val_loss, val_precision, val_recall and val_f1: each batch's at a threshold of 0.5, averaged by the batches' windows."""
    now = batches.sparkSession.sparkContext.broadcast(weights)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not len(part):
                continue
            x, y = _arrays(part)
            logits, _ = model.forward(now.value, x)
            said, true = logits >= 0, y >= 0.5
            rows = [[part.column(2)[i].as_py(), 1, *(int(c.sum()) for c in (said[i] & true[i], said[i] & ~true[i], ~said[i] & true[i])), loss.sums(logits[i], y[i]).tolist()] for i in range(len(y))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((*[pa.int64()] * 5, pa.list_(pa.float64())))], names=["batch", "n", "tp", "fp", "fn", "sums"])

    def valued(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            values = [loss.value(np.array(s)) for s in part.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(1, 5)), pa.array(values, pa.float64())], names=["n", "tp", "fp", "fn", "loss"])

    each = batches.select("features", "labels", "batch").mapInArrow(run, "batch long, n long, tp long, fp long, fn long, sums array<double>")
    width = len(loss.sums(np.zeros(1), np.zeros(1)))
    summed = each.groupBy("batch").agg(*(F.sum(c).alias(c) for c in ("n", "tp", "fp", "fn")), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width))).alias("sums"))
    rated = summed.mapInArrow(valued, "n long, tp long, fp long, fn long, loss double").select("n", "loss", *precision_recall_f1("tp", "fp", "fn"))
    mean = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(f"val_{c}")
    return {k: v for k, v in rated.agg(*map(mean, ("loss", "precision", "recall", "f1"))).first().asDict().items() if v is not None}


def fit(trained: TinySegCnn, batches: DataFrame, loss: Loss | None = None, epochs: int = 10, lr: float = 1e-3, val_batches: DataFrame | None = None, callbacks: Iterable[Callback] = (), seed: int = 0, workers: int | None = None) -> dict[str, float]:
    """Trains in place, a step a batch (column ``batch``), and returns the last epoch's metrics.

    An epoch is one job of ``workers`` tasks (as many as Spark's default parallelism), each with its share of every batch; the
    order of steps is shuffled anew each epoch. All workers must run at once. If one is lost, its epoch begins again from the
    weights before it. Gradients meet through the driver's barrier, which suits models of some ten thousand weights.
    """
    if lr <= 0 or epochs <= 0 or workers is not None and workers <= 0:
        raise ValueError("lr, epochs and workers must be positive")
    loss, state, metrics = loss or BceLoss(), {}, {}
    tasks = workers or batches.sparkSession.sparkContext.defaultParallelism
    with stored(batches.select("features", "labels", "batch")) as held:
        numbers = windows.numbered(held.select("batch").distinct(), [], ["batch"], "place")
        n_steps = numbers.count()
        if not n_steps:
            raise ValueError("there is no batch to train on")
        checks = materialise(val_batches) if val_batches is not None else None
        for epoch in range(epochs):

            def placed(parts: Iterator[pa.RecordBatch], epoch: int = epoch) -> Iterator[pa.RecordBatch]:
                rng = np.random.RandomState(seed)
                for _ in range(epoch + 1):
                    order = rng.permutation(n_steps)
                step = np.argsort(order)
                for part in parts:
                    yield pa.RecordBatch.from_arrays([part.column("batch"), pa.array(step[part.column("place").to_numpy()])], names=["batch", "step"])

            kind = held.schema["batch"].dataType.simpleString()
            steps = numbers.mapInArrow(placed, f"batch {kind}, step long")
            trained.weights, state, value = _epoch(held.join(steps, "batch").select("features", "labels", "step"), tasks, n_steps, trained.weights, state, loss, lr)
            metrics = {"train_loss": float(value)} | (validate(checks, trained.weights, loss) if checks is not None else {})
            for callback in callbacks:
                callback.on_epoch_end(epoch + 1, metrics, trained)
    return metrics
