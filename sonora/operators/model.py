"""A small segmentation network over feature frames: forward and backward pass, optimiser steps, sliding prediction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import numbered

#: Kernel sizes of the layers, zero padded to keep the length.
KERNELS = (9, 9, 5, 1)
#: Frames between the begins of two runs of windows; a task scores one run at a time.
CHUNK = 1024
#: Windows scored in one forward pass.
BATCH = 32
Weights = list[tuple[np.ndarray, np.ndarray]]


def random_weights(n_bands: int, base: int = 32, seed: int = 0) -> Weights:
    """(out, in, kernel) weights and biases, uniform within one over the square root of a filter's inputs."""
    if n_bands <= 0 or base <= 0:
        raise ValueError("n_bands and base must be positive")
    rng, sizes = np.random.RandomState(seed), (n_bands, base, base, base, 1)
    bound = [1 / np.sqrt(i * k) for i, k in zip(sizes, KERNELS)]
    return [(rng.uniform(-b, b, (o, i, k)), rng.uniform(-b, b, o)) for i, o, k, b in zip(sizes, sizes[1:], KERNELS, bound)]


def _views(x: np.ndarray, k: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (0, 0), (k // 2, k // 2))), k, axis=2)


def forward(weights: Weights, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Logits (batch, time) of features (batch, bands, time), and each layer's input."""
    inputs = []
    for j, (w, b) in enumerate(weights):
        inputs.append(x)
        x = np.einsum("bitk,oik->bot", _views(x, w.shape[2]), w, optimize=True) + b[None, :, None]
        if j + 1 < len(weights):
            x = np.maximum(x, 0)
    return x[:, 0], inputs


def backward(weights: Weights, inputs: list[np.ndarray], g: np.ndarray) -> Weights:
    """Gradients of all weights, from each layer's input and the gradient by logits (batch, time)."""
    g, out = g[:, None], []
    for j in range(len(weights) - 1, -1, -1):
        w, views = weights[j][0], _views(inputs[j], weights[j][0].shape[2])
        out.append((np.einsum("bot,bitk->oik", g, views, optimize=True), g.sum((0, 2))))
        if j:
            g = np.einsum("botk,oik->bit", _views(g, w.shape[2]), w[:, :, ::-1], optimize=True) * (inputs[j] > 0)
    return out[::-1]


def adam(weights: Weights, grads: Weights, state: dict, lr: float = 1e-3) -> Weights:
    """One step; ``state`` keeps the moments."""
    state["t"] = state.get("t", 0) + 1
    new = []
    for j, (ws, gs) in enumerate(zip(weights, grads)):
        pair = []
        for i, (w, g) in enumerate(zip(ws, gs)):
            m, v = state.get((j, i), (np.zeros_like(w), np.zeros_like(w)))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            state[j, i] = m, v
            pair.append(w - lr * (m / (1 - 0.9 ** state["t"])) / (np.sqrt(v / (1 - 0.999 ** state["t"])) + 1e-8))
        new.append(tuple(pair))
    return new


def sliding_predict(frames: DataFrame, weights: Weights, width: int, hop: int | None = None, key: str = "recording_id", order: str = "frame_idx", features: str = "features") -> DataFrame:
    """(key, frame_idx, prob): each frame's mean probability over the windows that hold it, 0 where none does.

    Recordings shorter than a window are padded with their last frame. The network pads each window with
    zeros at its own ends. A task holds one run of windows, about CHUNK frames, never a recording.
    """
    hop = hop or max(1, width // 4)
    if not 0 < hop <= width:
        raise ValueError("the hop must lie between one frame and the window's width")
    model = frames.sparkSession.sparkContext.broadcast(weights)
    stride = max(1, CHUNK // hop) * hop
    placed = numbered(frames.select(F.col(key).alias("_key"), F.col(order).cast("int").alias("_order"), F.col(features).alias("_x")), ["_key"], ["_order", "_x"], "_pos")
    # A run's last window begins at stride - hop, so frames behind the next run's begin belong to both.
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("_pos") - (stride - hop + width - 1)) / F.lit(stride)))
    runs = placed.withColumn("_run", F.explode(F.sequence(first, F.floor(F.col("_pos") / F.lit(stride)))))

    def score(table: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        x = np.array(table["_x"].to_pylist(), float).T
        n, run = x.shape[1], table["_run"][0].as_py()
        padded = np.pad(x, ((0, 0), (0, max(0, width - n))), mode="edge") if run == 0 else x
        total, seen = np.zeros(padded.shape[1]), np.zeros(padded.shape[1])
        starts = np.arange(0, min(stride, padded.shape[1] - width + 1), hop)
        for lo in range(0, len(starts), BATCH):
            part = starts[lo : lo + BATCH]
            logits = forward(model.value, np.stack([padded[:, s : s + width] for s in part]))[0]
            for s, p in zip(part, 1 / (1 + np.exp(-np.clip(logits, -500, 500)))):
                total[s : s + width] += p
                seen[s : s + width] += 1
        return table.select(["_key", "_order", "_pos"]).append_column("total", pa.array(total[:n])).append_column("seen", pa.array(seen[:n]))

    scored = runs.groupBy("_key", "_run").applyInArrow(score, f"_key {frames.schema[key].dataType.simpleString()}, _order int, _pos long, total double, seen double")
    summed = scored.groupBy("_key", "_order", "_pos").agg(F.sum("total").alias("total"), F.sum("seen").alias("seen"))
    return summed.select(F.col("_key").alias(key), F.col("_order").alias(order), (F.col("total") / F.greatest(F.col("seen"), F.lit(1e-12))).alias("prob"))
