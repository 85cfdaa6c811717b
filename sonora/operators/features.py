"""Spectral features: power spectra, band energies, moving medians, robust normalisation, and their chain."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonora.functions.signal import EPS, band_edge_rows, next_power_of_two, odd_kernel, snr_db
from sonora.sources.storage import materialise

from .quantiles import by_size, select_ranks
from .scan import changes, numbered, whole_groups

#: Rows of a key that a median filter handles at a time.
RUN = 4096


@dataclass(frozen=True)
class SnrSettings:
    """How features are made from a waveform. Frequencies in Hz, window and hop in ms, baseline in seconds."""

    sample_rate: int
    hop_ms: float = 8.0
    n_bands: int = 8
    win_ms: float = 32.0
    band_low: float = 300.0
    band_high: float = 10000.0
    baseline_s: float = 10.0
    normalize: bool = True
    eps: float = EPS

    def __post_init__(self) -> None:
        for name in ("sample_rate", "hop_ms", "n_bands", "win_ms", "band_low", "baseline_s", "eps"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if not self.band_low < self.band_high < self.sample_rate / 2:
            raise ValueError("bands must lie below half the sample rate, the low edge under the high one")

    @property
    def hop(self) -> int:
        return max(1, round(self.sample_rate * self.hop_ms / 1000))

    @property
    def window(self) -> int:
        return max(1, round(self.sample_rate * self.win_ms / 1000))

    @property
    def n_fft(self) -> int:
        return next_power_of_two(self.window)

    @property
    def halo(self) -> int:
        """Samples that chunks must have on both sides."""
        return self.n_fft // 2

    @property
    def kernel(self) -> int:
        return odd_kernel(self.baseline_s, self.hop_ms / 1000)


@dataclass(frozen=True)
class Part:
    """Where a chunk lies in its waveform of ``n`` samples: its own samples, and the first of those that it brings along."""

    begin: int
    end: int
    first: int
    n: int


def power_runs(samples: np.ndarray, n_fft: int, hop: int, window: int, frames: int, part: Part | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """The first frame and the (frames, bins) squared magnitudes of runs of ``frames`` frames. Frames are centred, the
    waveform's ends reflected, the periodic Hann window is centred.

    A chunk has the frames whose centres are its own samples (its waveform's last chunk that at its end, too), and needs half
    a transform of samples more on both sides; those beyond the waveform's ends are reflected here.
    """
    half = n_fft // 2
    part = part or Part(0, len(samples), 0, len(samples))
    if part.n <= half:
        raise ValueError(f"a waveform needs more than {half} samples")
    if part.first > max(0, part.begin - half) or part.first + len(samples) < min(part.n, part.end + half):
        raise ValueError(f"a chunk needs {half} samples more on both sides")
    taper = np.zeros(n_fft)
    left = (n_fft - window) // 2
    taper[left : left + window] = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
    stop = 1 + part.n // hop if part.end == part.n else -(-part.end // hop)
    for lo in range(-(-part.begin // hop), stop, frames):
        hi = min(stop, lo + frames)
        a, b = lo * hop - half, (hi - 1) * hop + half
        if a >= 0 and b <= part.n:
            line = samples[a - part.first : b - part.first]
        else:
            at = np.abs(np.arange(a, b))
            line = samples[np.where(at >= part.n, 2 * (part.n - 1) - at, at) - part.first]
        view = np.lib.stride_tricks.sliding_window_view(line, n_fft)[::hop]
        spectrum = np.fft.rfft(view * taper, axis=1)
        yield lo, spectrum.real**2 + spectrum.imag**2


def power_frames(samples: np.ndarray, n_fft: int, hop: int, window: int) -> np.ndarray:
    """All of a waveform's frames."""
    return np.concatenate([power for _, power in power_runs(samples, n_fft, hop, window, 4096)])


def cut_waves(waves: DataFrame, size: int, halo: int, key: str = "recording_id", samples: str = "samples") -> DataFrame:
    """Waveforms that are a row each as chunks, in the form of ``load_chunks``: key, n_samples, begin, end, first_sample, samples."""
    if size < 1 or halo < 0:
        raise ValueError("the size must be positive, the halo must not be negative")
    n = F.size(samples).cast("long")
    cut = waves.filter(F.size(samples) > 0).select(key, n.alias("n_samples"), samples, F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(size).cast("long"))).alias("begin"))
    first, end = F.greatest(F.lit(0), F.col("begin") - halo), F.least(F.col("n_samples"), F.col("begin") + size)
    return cut.select(key, "n_samples", "begin", end.alias("end"), first.alias("first_sample"), F.slice(samples, (first + 1).cast("int"), (F.least(F.col("n_samples"), end + halo) - first).cast("int")).alias(samples))


def _parts(waves: DataFrame, key: str, samples: str) -> DataFrame:
    """Waveforms by chunks: (key, samples, begin, end, first_sample, n_samples). A row without bounds is a whole waveform."""
    known = waves.filter(F.col(samples).isNotNull())
    if "first_sample" not in waves.columns:
        n = F.size(samples).cast("long")
        known = known.withColumns({"begin": F.lit(0).cast("long"), "end": n, "first_sample": F.lit(0).cast("long"), "n_samples": n})
    return known.select(key, samples, "begin", "end", "first_sample", "n_samples")


def _powers(batch: pa.RecordBatch, n_fft: int, hop: int, window: int, frames: int) -> Iterator[tuple[pa.Array, int, np.ndarray]]:
    """(key, first frame, power) of runs of frames, of a batch of ``_parts``."""
    lists = batch.column(1)
    values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    bounds = [batch.column(c).to_pylist() for c in ("begin", "end", "first_sample", "n_samples")]
    for i, part in enumerate(zip(*bounds)):
        for first, power in power_runs(values[at[i] : at[i + 1]], n_fft, hop, window, frames, Part(*part)):
            yield batch.column(0).slice(i, 1), first, power


def _frame_rows(key: pa.Array, first: int, table: np.ndarray, names: list[str]) -> pa.RecordBatch:
    frame, column = np.indices(table.shape)
    return pa.RecordBatch.from_arrays([key.take(pa.array(np.zeros(table.size, np.int64))), pa.array((frame + first).ravel(), pa.int32()), pa.array(column.ravel(), pa.int32()), pa.array(table.ravel())], names=names)


def stft_power(waves: DataFrame, n_fft: int, hop: int, window: int | None = None, key: str = "recording_id", samples: str = "samples", frames: int = 2048) -> DataFrame:
    """(key, frame_idx, bin, power) of every waveform.

    A row of ``waves`` is a waveform, or a chunk of one as ``load_chunks`` and ``cut_waves`` give them, with a halo of half a
    transform at least; the frames are the same for every cut. ``frames`` of a row are transformed at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first, power in _powers(batch, n_fft, hop, window or n_fft, frames):
                yield _frame_rows(name, first, power, [key, "frame_idx", "bin", "power"])

    return _parts(waves, key, samples).mapInArrow(run, f"{key} {waves.schema[key].dataType.simpleString()}, frame_idx int, bin int, power double")


def wave_energy(waves: DataFrame, settings: SnrSettings, key: str = "recording_id", samples: str = "samples", frames: int = 2048) -> DataFrame:
    """(key, frame_idx, band, energy): ``stft_power`` and ``band_energy`` in one go, which spares a row for each bin."""
    frequency = np.arange(settings.n_fft // 2 + 1) * settings.sample_rate / settings.n_fft
    inside = np.array([(frequency >= a) & (frequency < b) for _, a, b in band_edge_rows(settings.band_low, settings.band_high, settings.n_bands)], float).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first, power in _powers(batch, settings.n_fft, settings.hop, settings.window, frames):
                yield _frame_rows(name, first, power @ inside, [key, "frame_idx", "band", "energy"])

    return _parts(waves, key, samples).mapInArrow(run, f"{key} {waves.schema[key].dataType.simpleString()}, frame_idx int, band int, energy double")


def band_energy(spectrum: DataFrame, low: float, high: float, n_bands: int, hz_per_bin: float, key: str = "recording_id") -> DataFrame:
    """Sum of power over each band's bins (low edge in, high edge out); a band without bins has energy 0.

    The bands are a constant array, so this is no join: each frame keeps one row per band.
    """
    frequency = F.col("bin") * hz_per_bin
    sums = [F.sum(F.when((frequency >= a) & (frequency < b), F.col("power")).otherwise(0.0)).alias(f"b{i}") for i, a, b in band_edge_rows(low, high, n_bands)]
    wide = spectrum.groupBy(key, "frame_idx").agg(*sums)
    return wide.select(key, "frame_idx", F.posexplode(F.array(*(f"b{i}" for i in range(n_bands)))).alias("band", "energy"))


def sliding_medians(lines: np.ndarray, starts: np.ndarray, kernel: int) -> np.ndarray:
    """The median of ``kernel`` values from each of ``starts`` on, of one array.

    The array's ranks are parted by their bits, the highest first, each level keeping the order of places (a wavelet
    matrix): where zeros of a level lie before a place is a running count, so all windows take one step a level at once,
    and a median costs the logarithm of the array, whatever the kernel.
    """
    n = len(lines)
    order = np.argsort(lines, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    lo, hi, want, found = starts.copy(), starts + kernel, np.full(len(starts), kernel // 2), np.zeros(len(starts), np.int64)
    for bit in reversed(range(max(1, int(n - 1).bit_length()))):
        one = (rank >> bit & 1).astype(bool)
        zeros = np.zeros(n + 1, np.int64)
        np.cumsum(~one, out=zeros[1:])
        low, high = zeros[lo], zeros[hi]
        up = want >= high - low
        want -= np.where(up, high - low, 0)
        found += up.astype(np.int64) << bit
        lo, hi = np.where(up, zeros[n] + lo - low, low), np.where(up, zeros[n] + hi - high, high)
        rank = np.concatenate([rank[~one], rank[one]])
    return lines[order[found]]


def median_filter(df: DataFrame, value: str, kernel: int, keys: list[str], order: str, out: str = "baseline", dense: bool = False) -> DataFrame:
    """A centred moving median with zeros beyond both ends, and for nulls; ``kernel`` must be odd.

    ``dense`` says that ``order`` counts a key's rows from 0 without gaps; otherwise rows are numbered first. Runs of ``RUN``
    rows, with half a kernel more at both ends, are dealt to tasks whatever their keys, and filtered many at a time.
    """
    if kernel % 2 == 0:
        raise ValueError("the kernel must be odd")
    half = kernel // 2
    at = F.col(order).cast("long")
    placed = df.withColumn("_at", at) if dense else numbered(df, keys, [order], "_at")
    run = lambda shift: F.floor((F.col("_at") + shift) / F.lit(RUN))
    runs = placed.withColumn("_run", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), run(-half)), run(half))))
    groups, names = [*keys, "_run"], df.columns

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, groups):
            column = lambda c: table[c].chunk(0)  # noqa: B023, E731
            new = changes([column(k) for k in groups], len(table))
            place = column("_at").to_numpy() - column("_run").to_numpy() * RUN
            x = np.asarray(pc.fill_null(column(value).cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False))
            # Groups lie one behind the other, each with half a kernel of zeros on both sides.
            begin = np.flatnonzero(new)
            first, last = np.minimum(place[begin], 0) - half, np.maximum.reduceat(place, begin) + half
            base = np.cumsum(np.append(0, last - first + 1))
            line = np.zeros(base[-1])
            shift = (base[:-1] - first)[np.cumsum(new) - 1]
            line[place + shift] = x
            own = np.flatnonzero((place >= 0) & (place < RUN))
            medians = sliding_medians(line, (place + shift)[own] - half, kernel)
            yield pa.RecordBatch.from_arrays([*(column(c).take(pa.array(own)) for c in names if c != out), pa.array(medians)], names=[*(c for c in names if c != out), out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out)
    return runs.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(filtered, f"{fields}, {out} double")


def robust_normalize(df: DataFrame, value: str, keys: list[str], eps: float = EPS, out: str = "z") -> DataFrame:
    """(x - median) / (1.4826 (MAD + eps)) per key, with the lower of two middle values as the median.

    Keys of a bounded number of rows have both medians of one grouping: the deviations' is taken from the values that the
    first has in order. Of larger keys both are selected by ``quantiles``, so no task holds a key's values.
    """
    stored = materialise(df)
    small, large = by_size(stored.select(*keys, F.col(value).alias("_x")), keys)
    middle = lambda a: F.get(a, F.ceil(F.size(a) / 2).cast("int") - 1)
    lists = small.groupBy(*keys).agg(F.sort_array(F.collect_list("_x")).alias("_x")).withColumn("_m", middle(F.col("_x")))
    stats = lists.select(*keys, F.col("_m").cast("double").alias("_m"), middle(F.sort_array(F.transform("_x", lambda v: F.abs(v - F.col("_m"))))).cast("double").alias("_s"))
    if large is not None:
        half = [F.ceil(F.col("n") / 2) - 1]
        medians = select_ranks(large, keys, half).select(*keys, F.get("picks", F.lit(0)).alias("_m"))
        apart = _with_stats(large, medians, keys).select(*keys, F.abs(F.col("_x") - F.col("_m")).alias("_x"), "_m")
        spread = select_ranks(materialise(apart), [*keys, "_m"], half).select(*keys, "_m", F.get("picks", F.lit(0)).alias("_s"))
        stats = stats.unionByName(spread)
    z = (F.col(value) - F.col("_m")) / (1.4826 * (F.col("_s") + eps))
    return _with_stats(stored, stats, keys).withColumn(out, z).drop("_m", "_s")


def _with_stats(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with its key's row of ``stats``; null keys are keys, too."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}"))
    return df.alias("d").join(stats.alias("s"), same, "left").select("d.*", *(f"s.{c}" for c in stats.columns if c not in keys))


def snr_features(waves: DataFrame, settings: SnrSettings, key: str = "recording_id", samples: str = "samples") -> DataFrame:
    """(key, frame_idx, time_s, band, feature): the chain from waveforms to normalised signal-to-noise features."""
    energy = wave_energy(waves, settings, key, samples)
    based = median_filter(energy, "energy", settings.kernel, [key, "band"], "frame_idx", dense=True)
    snr = based.withColumn("snr", snr_db("energy", "baseline", settings.eps))
    named = robust_normalize(snr, "snr", [key, "band"], settings.eps, "feature") if settings.normalize else snr.withColumn("feature", F.col("snr"))
    time = (F.col("frame_idx") * settings.hop).cast("float") / F.lit(settings.sample_rate)
    return named.select(key, "frame_idx", time.cast("float").alias("time_s"), "band", "feature")
