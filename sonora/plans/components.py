"""The parts that a user can replace, each a small base class, and the ones that come with the library.

Extractors, detectors, decoders and matchers turn DataFrames into DataFrames; losses are additive sums over a batch and
gradients by logits; callbacks hear of each epoch's metrics. ``settings`` of a part are plain values, which are all that
is stored of it besides a model's weights.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from dataclasses import asdict, dataclass, field, is_dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonora.functions.logs import log
from sonora.operators import decode, features, matching, model
from sonora.sources.storage import paths_must_exist

KEY = "recording_id"


class Extractor(ABC):
    """Waveforms (recording_id, samples), whole or by chunks, to frames (recording_id, frame_idx, time_s, features).

    ``halo``: samples that a chunk must bring along on both sides.
    """

    sample_rate: int
    hop_ms: float
    n_features: int
    halo: int = 0

    @property
    def hop_s(self) -> float:
        return self.hop_ms / 1000

    @property
    def frame_rate(self) -> float:
        return 1000 / self.hop_ms

    def seconds_to_frames(self, seconds: float) -> int:
        return round(seconds / self.hop_s)

    def frames_to_seconds(self, frames: int) -> float:
        return frames * self.hop_s

    @abstractmethod
    def extract(self, waves: DataFrame) -> DataFrame: ...

    def __call__(self, waves: DataFrame) -> DataFrame:
        return self.extract(waves)


@dataclass(frozen=True)
class SnrExtractor(features.SnrSettings, Extractor):
    """Normalised signal-to-noise features by band. Extractors of equal settings are equal."""

    @property
    def n_features(self) -> int:
        return self.n_bands

    def extract(self, waves: DataFrame) -> DataFrame:
        rows = features.snr_features(waves, self)
        bands = F.sort_array(F.collect_list(F.struct("band", "feature")))
        return rows.groupBy(KEY, "frame_idx").agg(F.first("time_s").alias("time_s"), F.transform(bands, lambda x: x["feature"]).alias("features"))


class Detector(ABC):
    """Frames with features to probabilities (recording_id, frame_idx, prob)."""

    def __init__(self, n_bands: int, window_frames: int) -> None:
        if n_bands <= 0 or window_frames <= 0:
            raise ValueError("n_bands and window_frames must be positive")
        self.n_bands, self.window_frames = n_bands, window_frames

    @property
    @abstractmethod
    def receptive_field(self) -> int: ...

    @abstractmethod
    def forward(self, x: np.ndarray) -> np.ndarray:
        """Logits (batch, time) of features (batch, bands, time)."""

    @abstractmethod
    def predict(self, frames: DataFrame, hop_frames: int | None = None) -> DataFrame: ...


class TinySegCnn(Detector):
    """Four convolutions over time; ``base`` filters in the hidden ones."""

    def __init__(self, n_bands: int, window_frames: int, base: int = 32, weights: model.Weights | None = None, seed: int = 0) -> None:
        super().__init__(n_bands, window_frames)
        self.base = base
        self.weights = weights or model.random_weights(n_bands, base, seed)

    @property
    def receptive_field(self) -> int:
        """The kernels' sizes less one each, summed."""
        return sum(k - 1 for k in model.KERNELS)

    @property
    def settings(self) -> dict:
        return {"n_bands": self.n_bands, "window_frames": self.window_frames, "base": self.base}

    def checked(self, x: np.ndarray) -> np.ndarray:
        if x.ndim != 3 or x.shape[1] != self.n_bands:
            raise ValueError(f"features must be (batch, {self.n_bands}, time), not {x.shape}")
        return x

    def forward(self, x: np.ndarray) -> np.ndarray:
        return model.forward(self.weights, self.checked(x))[0]

    def predict(self, frames: DataFrame, hop_frames: int | None = None) -> DataFrame:
        odd = F.raise_error(f"features must have {self.n_bands} bands").cast("array<double>")
        sized = frames.withColumn("features", F.when(F.size("features") == self.n_bands, F.col("features").cast("array<double>")).otherwise(odd))
        return model.sliding_predict(sized, self.weights, self.window_frames, hop_frames)


class Decoder(ABC):
    """Frames with prob to intervals (recording_id, onset, offset)."""

    @abstractmethod
    def decode(self, frames: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class HysteresisDecoder(decode.Hysteresis, Decoder):
    def decode(self, frames: DataFrame) -> DataFrame:
        return decode.hysteresis_decode(frames, self, [KEY])


class Matcher(ABC):
    """Annotated (recording_id, gi, onset, offset) and predicted (recording_id, pi, onset, offset) intervals to one-to-one matches."""

    @abstractmethod
    def match(self, gt: DataFrame, pred: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class GreedyIouMatcher(Matcher):
    iou_threshold: float = 0.2

    def match(self, gt: DataFrame, pred: DataFrame) -> DataFrame:
        return matching.matched(matching.aligned(gt, pred, self.iou_threshold))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _entropy(x: np.ndarray, y: np.ndarray, weight: float = 1.0) -> np.ndarray:
    return (1 - y) * x + (1 + (weight - 1) * y) * (np.log1p(np.exp(-np.abs(x))) + np.maximum(-x, 0))


class Loss(ABC):
    """A loss of a batch that may be dealt to many tasks: sums that add up, a value of the sums, a gradient by logits.

    ``needs_sums``: the gradient depends on the sums of the whole batch, which then are taken first.
    """

    needs_sums = True

    @abstractmethod
    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sums of logits and targets; the first is their number."""

    @abstractmethod
    def value(self, sums: np.ndarray) -> float: ...

    @abstractmethod
    def gradient(self, x: np.ndarray, y: np.ndarray, sums: np.ndarray) -> np.ndarray: ...

    def __call__(self, x: np.ndarray, y: np.ndarray) -> float:
        return self.value(self.sums(x, y))


class _Mean(Loss):
    """Losses that are a mean over frames."""

    needs_sums = False

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.array([y.size, self.each(x, y).sum()])

    def value(self, sums: np.ndarray) -> float:
        return float(sums[1] / sums[0])

    @abstractmethod
    def each(self, x: np.ndarray, y: np.ndarray) -> np.ndarray: ...


@dataclass(frozen=True)
class BceLoss(_Mean):
    pos_weight: float = 1.0

    def __post_init__(self) -> None:
        if self.pos_weight <= 0:
            raise ValueError("pos_weight must be positive")

    def each(self, x, y):
        return _entropy(x, y, self.pos_weight)

    def gradient(self, x, y, sums):
        return ((1 - y) - (1 + (self.pos_weight - 1) * y) * (1 - _sigmoid(x))) / sums[0]


@dataclass(frozen=True)
class FocalLoss(_Mean):
    alpha: float = 0.25
    gamma: float = 2.0

    def __post_init__(self) -> None:
        if not 0 <= self.alpha <= 1 or self.gamma < 0:
            raise ValueError("alpha must lie in [0, 1] and gamma must not be negative")

    def _parts(self, x, y):
        p = _sigmoid(x)
        return p, 1 - (p * y + (1 - p) * (1 - y)), self.alpha * y + (1 - self.alpha) * (1 - y)

    def each(self, x, y):
        _, miss, share = self._parts(x, y)
        return share * miss**self.gamma * _entropy(x, y)

    def gradient(self, x, y, sums):
        p, miss, share = self._parts(x, y)
        steep = self.gamma * np.maximum(miss, 1e-300) ** (self.gamma - 1) * (1 - 2 * y) * p * (1 - p)
        return share * (steep * _entropy(x, y) + miss**self.gamma * (p - y)) / sums[0]


class _Overlap(Loss):
    """1 - (overlap + smooth) / (size + smooth), of sums over the whole batch."""

    def sums(self, x, y):
        p = _sigmoid(x)
        return np.array([y.size, (p * y).sum(), (p * (1 - y)).sum(), ((1 - p) * y).sum()])

    @abstractmethod
    def weights(self) -> tuple[float, float, float]:
        """Of the overlap over true positives; of the size, over true positives, false positives and false negatives too."""

    def _fraction(self, sums: np.ndarray) -> tuple[float, float]:
        t, a, b = self.weights()
        return t * sums[1] + self.smooth, t * sums[1] + a * sums[2] + b * sums[3] + self.smooth

    def value(self, sums):
        over, under = self._fraction(sums)
        return float(1 - over / under) if under else float("nan")

    def gradient(self, x, y, sums):
        t, a, b = self.weights()
        over, under = self._fraction(sums)
        p = _sigmoid(x)
        return -(t * y * under - over * (t * y + a * (1 - y) - b * y)) / under**2 * p * (1 - p)


@dataclass(frozen=True)
class DiceLoss(_Overlap):
    smooth: float = 1.0

    def weights(self):
        return 2.0, 1.0, 1.0


@dataclass(frozen=True)
class TverskyLoss(_Overlap):
    alpha: float = 0.5
    beta: float = 0.5
    smooth: float = 1.0

    def weights(self):
        return 1.0, self.alpha, self.beta


class Callback:
    """Hears of each epoch's end: its number, its metrics and the trained model."""

    def on_epoch_end(self, epoch: int, metrics: dict[str, float], trained: Detector) -> None: ...


class LoggingCallback(Callback):
    def on_epoch_end(self, epoch: int, metrics: dict[str, float], trained: Detector) -> None:
        log.info("Epoch %03d: %s", epoch, ", ".join(f"{name} {value:.4f}" for name, value in metrics.items()))


@dataclass
class MetricsHistory(Callback):
    """All metrics by name; one that comes later has fewer values."""

    history: dict[str, list[float]] = field(default_factory=dict)

    def on_epoch_end(self, epoch: int, metrics: dict[str, float], trained: Detector) -> None:
        for name, value in metrics.items():
            self.history.setdefault(name, []).append(float(value))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, k, v) for k, values in self.history.items() for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "epoch int, metric string, value double")


@dataclass
class SaveBestModel(Callback):
    """Stores the weights whenever a metric strictly improves; an epoch without the metric, or with NaN, changes nothing."""

    spark: SparkSession
    path: str
    monitor: str = "val_f1"
    mode: str = "max"
    best: float | None = None

    def __post_init__(self) -> None:
        if self.mode not in ("min", "max"):
            raise ValueError("mode must be min or max")

    def on_epoch_end(self, epoch: int, metrics: dict[str, float], trained: Detector) -> None:
        value = metrics.get(self.monitor)
        if value is None or value != value or self.best is not None and not (value > self.best if self.mode == "max" else value < self.best):
            return
        self.best = value
        weight_table(self.spark, trained.weights).write.mode("overwrite").parquet(self.path)


def weight_table(spark: SparkSession, weights: model.Weights) -> DataFrame:
    """Weights as rows (layer, part, shape, values); nothing in them is executable."""
    rows = [(j, part, list(a.shape), a.ravel().tolist()) for j, pair in enumerate(weights) for part, a in zip("wb", pair)]
    return spark.createDataFrame(rows, "layer int, part string, shape array<int>, values array<double>").coalesce(1)


def read_weights(table: DataFrame) -> model.Weights:
    found = {(r["layer"], r["part"]): np.array(r["values"]).reshape(r["shape"]) for r in table.collect()}
    return [(found[j, "w"], found[j, "b"]) for j in range(len(found) // 2)]


#: What a stored pipeline may be made of, by name; ``register`` adds to it. Others can be stored, but not read.
EXTRACTORS: dict[str, type[Extractor]] = {"SnrExtractor": SnrExtractor}
DETECTORS: dict[str, type[Detector]] = {"TinySegCnn": TinySegCnn}
DECODERS: dict[str, type[Decoder]] = {"HysteresisDecoder": HysteresisDecoder}


def register(part: type) -> type:
    """A class decorator: pipelines with this extractor, detector or decoder can be read.

    Extractors and decoders are dataclasses, whose fields are their settings. A detector has ``settings`` and ``weights``, and
    is made of both. A name that another class has is an error.
    """
    for kind, known in ((Extractor, EXTRACTORS), (Detector, DETECTORS), (Decoder, DECODERS)):
        if isinstance(part, type) and issubclass(part, kind):
            if kind is not Detector and not is_dataclass(part):
                raise TypeError(f"{part.__name__} must be a dataclass, as its fields are what is stored")
            if known.setdefault(part.__name__, part) is not part:
                raise ValueError(f"there is another {kind.__name__} of the name {part.__name__}")
            return part
    raise TypeError(f"{part} is neither an extractor, a detector nor a decoder")


def save_pipeline(spark: SparkSession, trained: Detector, extractor: Extractor, decoder: Decoder, path: str, overwrite: bool = False) -> None:
    """A folder, in any file system of Spark's, with the parts' names and settings as JSON and the weights as a table."""
    for part, kind in ((trained, Detector), (extractor, Extractor), (decoder, Decoder)):
        if not isinstance(part, kind):
            raise TypeError(f"{type(part).__name__} is no {kind.__name__}")
    mode = "overwrite" if overwrite else "error"
    parts = {"model": (trained, trained.settings), "extractor": (extractor, asdict(extractor)), "decoder": (decoder, asdict(decoder))}
    stored = json.dumps({k: {"type": type(x).__name__, "settings": v} for k, (x, v) in parts.items()})
    spark.createDataFrame([(stored,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/settings")
    weight_table(spark, trained.weights).write.mode(mode).parquet(f"{path}/weights")


def load_pipeline(spark: SparkSession, path: str) -> tuple[Detector, Extractor, Decoder]:
    with paths_must_exist(path):
        stored = json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/settings").collect()))

    def kind(part: str, known: dict) -> type:
        name = stored[part]["type"]
        if name not in known:
            raise ValueError(f"{name} is none of the {part} types that can be read: {', '.join(known)}")
        return known[name]

    weights = read_weights(spark.read.parquet(f"{path}/weights"))
    trained = kind("model", DETECTORS)(**stored["model"]["settings"], weights=weights)
    return trained, kind("extractor", EXTRACTORS)(**stored["extractor"]["settings"]), kind("decoder", DECODERS)(**stored["decoder"]["settings"])


