"""Helpers shared by the corpus operators: shared storage, columns and vectorised word hashing."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonora.sources.storage import materialise

__all__ = ["arrow_bytes", "free_name", "gram_hashes", "materialise", "mix", "prefix_sums", "range_hash", "small_batches", "table", "text_or_empty", "word_hashes"]

#: Fixed value: what separates words in every contract of this subpackage.
SPACE = " \t\n\x0b\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``; its session sends Python at most ``rows`` rows at a time, as texts may be long."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has that name; names compare without case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- 64-bit hashing of many byte ranges at once ---------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64; kept between batches."""
    if "up" not in _POWERS or len(_POWERS["up"]) <= n:
        m = max(1 << 16, 1 << int(n + 1).bit_length())
        with np.errstate(over="ignore"):
            for name, b in (("up", _BASE), ("down", _INVERSE)):
                p = np.ones(m, np.uint64)
                p[1:] = b
                _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Running polynomial sums of a byte buffer, one longer than it."""
    up, _ = _powers(len(buf))
    out = np.zeros(len(buf) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, by content and length alone."""
    _, down = _powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: All ASCII but letters and digits.
IS_MARK = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string or binary column as one buffer, and each row's offset there; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return buf, at - at[0]


def word_hashes(buf: np.ndarray, at: np.ndarray, between: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all rows (A-Z folded), and each row's first word; ``at`` as from arrow_bytes.

    ``between``: which of the 256 bytes part words.
    """
    fold = _FOLD[buf]
    inside = ~between[fold]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = at[:-1][(at[:-1] < len(buf)) & (np.diff(at) > 0)]
    begins[edge] = inside[edge]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    stops[edge[edge > 0] - 1] = inside[edge[edge > 0] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return range_hash(prefix_sums(fold), start, end), np.searchsorted(start, at)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words, as if all were one text; callers leave out the runs that cross rows."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    out = np.full(m, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + m])
    return out
