"""WAV files by parts: headers alone, ranges of samples, and resampling of a range.

RIFF files and their 64-bit forms (RF64, BW64); whole numbers of 8 to 64 bits and floats of 32 and 64, also under an
extensible header. Files are opened where they are read, by a path or URI of any store that Arrow's file systems know,
and only the bytes asked for are read.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs as afs

#: Format tags of whole numbers, floats, and those that a longer header names.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
#: Lobes of the resampling kernel at each side, and the share of the band that it keeps.
ZEROS, ROLLOFF = 6, 0.99


@dataclass(frozen=True)
class Header:
    kind: int
    channels: int
    rate: int
    block: int
    at: int
    n_samples: int

    @property
    def duration_s(self) -> float:
        return self.n_samples / self.rate


class Counted:
    """A file of which every read is counted."""

    def __init__(self, f: BinaryIO) -> None:
        self.f, self.taken = f, 0

    def seek(self, at: int) -> None:
        self.f.seek(at)

    def read(self, n: int) -> bytes:
        got = self.f.read(n)
        self.taken += len(got)
        return got


def open_file(path: str) -> pa.NativeFile:
    """A file that can be read from any place on."""
    system, inner = afs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path else (afs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def read_header(f: BinaryIO | Counted, length: int) -> Header:
    """The header of a file of ``length`` bytes; chunks before the samples are skipped, not read. ValueError if it is no such file."""

    def at(place: int, form: str) -> tuple:
        f.seek(place)
        got = f.read(struct.calcsize(form))
        if len(got) < struct.calcsize(form):
            raise ValueError("no PCM WAV file: it ends within its header")
        return struct.unpack(form, got)

    riff, _, wave = at(0, "<4sI4s")
    if riff not in (b"RIFF", b"RF64", b"BW64") or wave != b"WAVE":
        raise ValueError("no PCM WAV file")
    place, wide, form = 12, None, None
    while place + 8 <= length:
        name, size = at(place, "<4sI")
        if name == b"ds64":
            _, wide = at(place + 8, "<QQ")
        elif name == b"fmt ":
            form = at(place + 8, "<HHIIH")
            if form[0] == EXTENSIBLE and size >= 26:
                form = (*at(place + 32, "<H"), *form[1:])
        elif name == b"data":
            if not form or form[0] not in (PCM, FLOAT) or not all(form[1:3]) or form[4] // form[1] not in ((1, 2, 3, 4, 8) if form[0] == PCM else (4, 8)):
                break
            bytes_ = wide if size == 0xFFFFFFFF and wide is not None else size
            return Header(form[0], form[1], form[2], form[4], place + 8, max(0, min(bytes_, length - place - 8)) // form[4])
        place += 8 + size + size % 2
    raise ValueError("no PCM WAV file")


def decode(raw: bytes, header: Header) -> np.ndarray:
    """(channels, samples) in [-1, 1]; floats are as they are."""
    width = header.block // header.channels
    if header.kind == FLOAT:
        x = np.frombuffer(raw, f"<f{width}").astype(np.float32)
    elif width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
    return x.reshape(-1, header.channels).T


def read_samples(f: BinaryIO, header: Header, lo: int, hi: int) -> np.ndarray:
    """Samples ``lo`` to ``hi`` of all channels, zeros outside the file."""
    a, b = max(0, lo), min(header.n_samples, hi)
    if a >= b:
        return np.zeros((header.channels, max(0, hi - lo)), np.float32)
    f.seek(header.at + a * header.block)
    x = decode(f.read((b - a) * header.block), header)
    return x if (a, b) == (lo, hi) else np.pad(x, [(0, 0), (a - lo, hi - b)])


def resampled_length(n: int, rate: int, to: int) -> int:
    return -(-n * to // rate)


def _reach(rate: int, to: int) -> tuple[int, float]:
    """How many inputs at each side an output needs, and the kernel's cut-off frequency."""
    cut = min(rate, to) * ROLLOFF / 2
    return math.ceil(ZEROS * rate / (2 * cut)), cut


def inputs_of(lo: int, hi: int, rate: int, to: int) -> tuple[int, int]:
    """The range of inputs that outputs ``lo`` to ``hi`` need; it may pass the signal's ends, where inputs are zero."""
    if rate == to:
        return lo, hi
    shared, (reach, _) = math.gcd(rate, to), _reach(rate, to)
    up, down = to // shared, rate // shared
    return lo * down // up - reach, (hi - 1) * down // up + reach + 1


def resample_part(x: np.ndarray, rate: int, to: int, lo: int, hi: int) -> np.ndarray:
    """Outputs ``lo`` to ``hi`` of a signal's windowed-sinc resampling, of the inputs that ``inputs_of`` names.

    Polyphase: outputs as many apart as the reduced ratio's numerator share a kernel, which runs over strided views. The
    phase of the first output comes from its place in the whole signal, so parts of a signal join without a seam.
    """
    if rate == to or hi <= lo:
        return x[..., : max(0, hi - lo)]
    shared, (reach, cut) = math.gcd(rate, to), _reach(rate, to)
    up, down, first = to // shared, rate // shared, inputs_of(lo, hi, rate, to)[0]
    views = np.lib.stride_tricks.sliding_window_view(x, 2 * reach + 1, axis=-1)
    out = np.empty((*x.shape[:-1], hi - lo), np.float32)
    for k in range(min(up, hi - lo)):
        whole, part = divmod((lo + k) * down, up)
        t = np.clip((np.arange(-reach, reach + 1) - part / up) * 2 * cut / rate, -ZEROS, ZEROS)
        kernel = np.sinc(t) * np.cos(np.pi * t / ZEROS / 2) ** 2 * (2 * cut / rate)
        out[..., k::up] = views[..., whole - reach - first :: down, :][..., : -(-(hi - lo - k) // up), :] @ kernel
    return out


def chunks_of(f: BinaryIO, header: Header, to: int, numbers: Iterator[int], size: int, halo: int, mono: bool) -> Iterator[tuple[int, int, int, int, int, np.ndarray]]:
    """(channel, chunk, begin, end, first, samples) of the chunks of those numbers, in the samples of rate ``to``.

    A chunk's own samples are ``begin`` to ``end``; ``samples`` begin at ``first`` and hold up to ``halo`` more on both sides.
    """
    n = resampled_length(header.n_samples, header.rate, to)
    for number in numbers:
        begin, end = number * size, min(n, (number + 1) * size)
        lo, hi = max(0, begin - halo), min(n, end + halo)
        x = resample_part(read_samples(f, header, *inputs_of(lo, hi, header.rate, to)), header.rate, to, lo, hi)
        for channel, samples in enumerate([x.mean(0)] if mono else x):
            yield channel, number, begin, end, lo, samples.astype(np.float32)
