"""Audio files as rows: WAV by chunks, read and resampled range by range, or whole; durations from headers.

``load_chunks`` and ``audio_headers`` open files in the tasks, in any store that Arrow's file systems know, and read only
what they need: no row holds a recording. ``load_audio`` reads whole files by Spark's binary reader, which knows other
stores, too, but whose rows hold 2 GB at most. ``WavSource`` is the same as ``load_chunks`` for ``spark.read.format("wav")``.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import wav
from .annotations import plain_path
from .storage import materialise, paths_must_exist

#: Samples of a chunk, and chunks of a task at most.
CHUNK, TASK_CHUNKS = 1 << 20, 32
#: Bytes of a file that a task of ``WavSource`` reads, about.
PART = 1 << 27
CHUNKS = "audio_path string, sample_rate int, n_samples long, duration_s double, channel int, chunk int, begin long, end long, first_sample long, samples array<float>"
_CHUNK_ROW = pa.schema([
    ("audio_path", pa.string()), ("sample_rate", pa.int32()), ("n_samples", pa.int64()), ("duration_s", pa.float64()), ("channel", pa.int32()),
    ("chunk", pa.int32()), ("begin", pa.int64()), ("end", pa.int64()), ("first_sample", pa.int64()), ("samples", pa.list_(pa.float32())),
])


def parse_wav(content: bytes) -> tuple[np.ndarray, int]:
    """(channels, samples) in [-1, 1] and the sample rate of a whole file."""
    f = io.BytesIO(content)
    header = wav.read_header(f, len(content))
    return wav.read_samples(f, header, 0, header.n_samples), header.rate


def wav_duration(head: bytes, length: int) -> float | None:
    """Seconds that a WAV file of ``length`` bytes states, read from its first bytes; null if these are no such header."""
    try:
        return wav.read_header(io.BytesIO(head), length).duration_s
    except ValueError:
        return None


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """A whole signal's resampling along the last axis; the length is ceil(n * to / rate)."""
    if rate == to:
        return x
    n = wav.resampled_length(x.shape[-1], rate, to)
    lo, hi = wav.inputs_of(0, n, rate, to)
    return wav.resample_part(np.pad(x, [(0, 0)] * (x.ndim - 1) + [(-lo, max(0, hi - x.shape[-1]))]), rate, to, 0, n)


def listed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, length, modified) of files, by Spark's own listing; none is opened. FileNotFoundError if a path is not there."""
    return _files(spark, paths).select(plain_path(F.col("_metadata.file_path")).alias("path"), "length", F.col("modificationTime").alias("modified"))


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files by Spark's binary reader."""
    with paths_must_exist(paths):
        return spark.read.format("binaryFile").load(paths)


def audio_headers(spark: SparkSession, paths: str | list[str] | DataFrame) -> DataFrame:
    """(audio_path, sample_rate, channels, n_samples, duration_s, bytes_read) of WAV files, whose headers alone are read.

    ``paths``: paths, or rows of ``listed``. ``bytes_read`` is what was read of the file. All others are null where it can't
    be read.
    """
    names = ["audio_path", "sample_rate", "channels", "n_samples", "duration_s", "bytes_read"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with wav.open_file(path) as raw:
                    f = wav.Counted(raw)
                    try:
                        h = wav.read_header(f, length)
                        rows.append((path, h.rate, h.channels, h.n_samples, h.duration_s, f.taken))
                    except ValueError:
                        rows.append((path, None, None, None, None, f.taken))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    files = (paths if isinstance(paths, DataFrame) else listed(spark, paths)).select("path", "length")
    return files.mapInArrow(run, "audio_path string, sample_rate int, channels int, n_samples long, duration_s double, bytes_read long")


def audio_durations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(audio_path, duration_s) of WAV files from their headers alone; null where a file can't be read."""
    return audio_headers(spark, paths).select("audio_path", "duration_s")


def _rows(path: str, numbers: range | None, share: tuple[int, int], to: int | None, size: int, halo: int, mono: bool) -> Iterator[pa.RecordBatch]:
    """A file's chunks of those numbers, or the k-th of m equal shares of them all, a batch each."""
    with wav.open_file(path) as f:
        try:
            header = wav.read_header(f, f.size())
        except ValueError:
            raise ValueError(f"{path} is no PCM WAV file") from None
        rate = to or header.rate
        n = wav.resampled_length(header.n_samples, header.rate, rate)
        every = -(-n // size)
        numbers = range(every * share[0] // share[1], every * (share[0] + 1) // share[1]) if numbers is None else numbers
        for channel, chunk, begin, end, first, samples in wav.chunks_of(f, header, rate, numbers, size, halo, mono):
            values = [path, rate, n, header.duration_s, channel, chunk, begin, end, first]
            listed = pa.ListArray.from_arrays(pa.array([0, len(samples)], pa.int32()), pa.array(samples))
            yield pa.RecordBatch.from_arrays([*(pa.array([v], f.type) for v, f in zip(values, _CHUNK_ROW)), listed], schema=_CHUNK_ROW)


def load_chunks(spark: SparkSession, paths: str | list[str] | DataFrame, sample_rate: int | None = None, mono: bool = True, strict: bool = True, size: int = CHUNK, halo: int = 0) -> DataFrame:
    """Rows of ``size`` samples at most of each file, and channel unless ``mono``: audio_path, sample_rate, n_samples (of the
    whole file at that rate), duration_s, channel, chunk, begin, end, first_sample, samples.

    A row's own samples are ``begin`` to ``end``; ``samples`` begin at ``first_sample`` and have up to ``halo`` more on both
    sides. Chunks are dealt to tasks whatever file they are of, and each reads its range alone, also of what is resampled.
    Files that can't be read fail, or have no rows unless ``strict``, as have those without samples.
    """
    if sample_rate is not None and sample_rate <= 0 or size < 1 or halo < 0:
        raise ValueError("sample_rate and size must be positive, the halo must not be negative")
    headers = materialise(audio_headers(spark, paths))
    rate = F.lit(sample_rate) if sample_rate else F.col("sample_rate")
    every = F.ceil(F.ceil(F.col("n_samples") * rate / F.col("sample_rate")) / size)
    known = headers if strict else headers.filter("n_samples is not null")
    total = known.agg(F.sum(F.coalesce(every, F.lit(1)))).first()[0] or 0
    tasks = max(1, min(total, 4 * spark.sparkContext.defaultParallelism), -(-total // TASK_CHUNKS))
    # One more than may be needed, as the division above is in floating point; the file says how many there are.
    units = known.select("audio_path", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(every, F.lit(0).cast("long")))).alias("chunk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _rows(path, range(chunk, chunk + 1), (0, 1), sample_rate, size, halo, mono)

    # The number is given, as these rows are too small for Spark to see what work they are.
    return units.repartition(tasks, "audio_path", "chunk").mapInArrow(run, CHUNKS).filter(F.col("begin") < F.col("end"))


class _Part(InputPartition):
    def __init__(self, path: str, share: tuple[int, int]) -> None:
        self.path, self.share = path, share


class WavSource(DataSource):
    """``spark.dataSource.register(WavSource)``, then ``spark.read.format("wav").load(path)``: the rows of ``load_chunks``.

    Options: samplerate, size, halo, mono. A path is a file or a folder, of which all .wav files are read. The driver lists
    files and their sizes; tasks read ranges of about ``PART`` bytes.
    """

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema) -> DataSourceReader:
        return _WavReader(self.options)


class _WavReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.to = options["path"], int(options.get("samplerate", 0)) or None
        self.size, self.halo, self.mono = int(options.get("size", CHUNK)), int(options.get("halo", 0)), str(options.get("mono", "true")).lower() == "true"

    def partitions(self) -> list[_Part]:
        head = self.path.partition("://")[0] + "://" if "://" in self.path else ""
        system, inner = afs.FileSystem.from_uri(self.path) if head else (afs.LocalFileSystem(), self.path)
        [at] = system.get_file_info([inner])
        if at.type == afs.FileType.NotFound:
            raise FileNotFoundError(f"no such file: {self.path}")
        found = [at] if at.is_file else [x for x in system.get_file_info(afs.FileSelector(inner, recursive=True)) if x.is_file and x.extension.lower() == "wav"]
        named = lambda x: self.path if at.is_file else self.path.rstrip("/") + x.path[len(inner.rstrip("/")) :]
        return [_Part(named(x), (k, m)) for x in found for m in [max(1, -(-x.size // PART))] for k in range(m)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        yield from _rows(partition.path, None, partition.share, self.to, self.size, self.halo, self.mono)


def load_audio(spark: SparkSession, paths: str | list[str], sample_rate: int | None = None, mono: bool = True, strict: bool = True) -> DataFrame:
    """(audio_path, sample_rate, duration_s, samples) of each file: samples in [-1, 1], one array, or one per channel unless ``mono``.

    Resampling comes before mixing. Files that can't be read fail, or have nulls unless ``strict``.
    """
    if sample_rate is not None and sample_rate <= 0:
        raise ValueError("sample_rate must be positive")
    kind = pa.list_(pa.float32()) if mono else pa.list_(pa.list_(pa.float32()))
    schema = pa.schema([("audio_path", pa.string()), ("sample_rate", pa.int32()), ("duration_s", pa.float64()), ("samples", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    x, rate = parse_wav(content.as_py())
                except ValueError:
                    if strict:
                        raise ValueError(f"{path} is no PCM WAV file") from None
                    yield pa.RecordBatch.from_pylist([{"audio_path": path}], schema)
                    continue
                duration, to = x.shape[1] / rate, sample_rate or rate
                x = resample(x, rate, to)
                channels = [x.mean(0)] if mono else x
                flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, channels)]), pa.int32()), pa.array(np.concatenate(channels).astype(np.float32)))
                listed = flat if mono else pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([to], pa.int32()), pa.array([duration]), listed], schema=schema)

    files = _files(spark, paths).select(plain_path(F.col("_metadata.file_path")).alias("path"), "content")
    return files.mapInArrow(run, f"audio_path string, sample_rate int, duration_s double, samples array<{'float' if mono else 'array<float>'}>")
