"""Audio and annotation files of odd names and contents."""

import io
import math
import struct
import wave

import numpy as np
import pyarrow as pa
import pytest

from sonora.sources import annotations as A
from sonora.sources import audio


def wav(path, x, rate=32000, width=2):
    """``x``: (channels, samples) in [-1, 1]."""
    x = np.atleast_2d(x)
    ints = np.clip(np.round(x.T * (1 << (8 * width - 1))), -(1 << (8 * width - 1)), (1 << (8 * width - 1)) - 1).astype(np.int64)
    raw = (ints + 128).astype(np.uint8).tobytes() if width == 1 else ints.astype("<i2").tobytes() if width == 2 else ints.astype("<i4").tobytes() if width == 4 else b"".join(int(v).to_bytes(3, "little", signed=True) for v in ints.ravel())
    with wave.open(str(path), "wb") as f:
        f.setnchannels(x.shape[0])
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(raw)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("call s+1%")
    t = np.arange(16000) / 32000
    wav(d / "r 2.1.wav", np.sin(t * 900))
    wav(d / "r10.wav", np.vstack([np.sin(t * 900), np.zeros_like(t)]), width=3)
    wav(d / "alone.wav", np.zeros(100))
    wav(d / "empty.wav", np.zeros(3200))
    wav(d / "lacks.wav", np.zeros(3200))
    (d / "cut.wav").write_bytes(b"RIFF\0\0")
    (d / "r 2.1_annotations.csv").write_text(",name,start_seconds,stop_seconds\n0,a,200.5,300\n1,b,100,150\n2,c,,400\n3,d,50,50\n4,\"x,y\",x,9\n")
    (d / "r10_annotations.csv").write_text("stop_seconds,start_seconds,name\n300,250,a\n")
    (d / "empty_annotations.csv").write_text("start_seconds,stop_seconds\n5,5\n")
    (d / "lacks_annotations.csv").write_text("start,stop_seconds\n5,6\n")
    (d / "cut_annotations.csv").write_text("start_seconds,stop_seconds\n5,6\n")
    return d


def test_scan_keeps_what_is_whole(spark, folder):
    sound = audio.audio_durations(spark, f"{folder}/*.wav")
    assert {r["audio_path"].rpartition("/")[2]: r["duration_s"] for r in sound.collect()} == {"r 2.1.wav": 0.5, "r10.wav": 0.5, "alone.wav": 100 / 32000, "empty.wav": 0.1, "lacks.wav": 0.1, "cut.wav": None}
    rows = A.scan_recordings(sound.unionByName(sound.filter("audio_path like '%r10.wav'")), A.read_annotations(spark, f"{folder}/*.csv", strict=False)).collect()
    assert [(r["audio_path"].removeprefix(str(folder)), r["annotation_path"].removeprefix(str(folder)), r["duration_s"], r["n_annotations"]) for r in rows] == [("/r 2.1.wav", "/r 2.1_annotations.csv", 0.5, 2)] + 2 * [("/r10.wav", "/r10_annotations.csv", 0.5, 1)]


def test_annotations_by_each_header(spark, folder):
    got = A.load_annotations(spark, [f"{folder}/r10_annotations.csv", f"{folder}/r 2.1_annotations.csv", f"{folder}/empty_annotations.csv"]).collect()
    assert sorted((r["recording_id"].rpartition("/")[2], r["gi"], r["onset"], r["offset"]) for r in got) == [("r 2.1", 0, 0.1, 0.15), ("r 2.1", 1, 0.2005, 0.3), ("r10", 0, 0.25, 0.3)]
    with pytest.raises(Exception, match="lacks columns: start_seconds"):
        A.read_annotations(spark, f"{folder}/lacks_annotations.csv").collect()
    with pytest.raises(ValueError, match="lack columns"):
        A.clean_annotations(spark.createDataFrame([(1.0,)], "start_seconds double"))


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_samples_of_all_widths(tmp_path, spark, width):
    x = np.array([0.0, 0.5, -0.5, -1.0, 0.25])
    wav(tmp_path / "a.wav", x, 8000, width)
    row = audio.load_audio(spark, f"{tmp_path}/a.wav").first()
    assert row["sample_rate"] == 8000 and row["duration_s"] == 5 / 8000 and row["samples"] == pytest.approx(x.tolist(), abs=0.01 if width == 1 else 1e-4)


def test_channels_and_files_that_cannot_be_read(spark, folder):
    both = audio.load_audio(spark, f"{folder}/r10.wav", mono=False).first()["samples"]
    one = audio.load_audio(spark, f"{folder}/r10.wav").first()["samples"]
    assert len(both) == 2 and max(map(abs, both[1])) == 0 and one == pytest.approx((np.array(both[0]) / 2).tolist(), abs=1e-6)
    lost = audio.load_audio(spark, f"{folder}/cut.wav", strict=False).first()
    assert lost["samples"] is None and lost["audio_path"].endswith("cut.wav")
    with pytest.raises(Exception, match="no PCM WAV"):
        audio.load_audio(spark, f"{folder}/cut.wav").collect()
    with pytest.raises(ValueError):
        audio.load_audio(spark, f"{folder}/r10.wav", 0)


@pytest.mark.parametrize("rate, to, n", [(44100, 32000, 44100), (8000, 32000, 999), (32000, 44100, 1000), (48000, 16000, 5000), (3, 2, 7), (32000, 32000, 10)])
def test_resampling(rate, to, n):
    """The polyphase form against the plain sum over all inputs, and a tone's amplitude."""
    rng = np.random.RandomState(n)
    x = rng.uniform(-1, 1, (2, n)).astype(np.float32)
    got = audio.resample(x, rate, to)
    assert got.shape == (2, -(-n * to // rate))
    if rate != to:
        cut, zeros = min(rate, to) * 0.99 / 2, 6
        for j in rng.choice(got.shape[1], min(50, got.shape[1]), replace=False):
            t = np.clip((np.arange(n) - j * rate / to) * 2 * cut / rate, -zeros, zeros)
            want = x @ (np.sinc(t) * np.cos(np.pi * t / zeros / 2) ** 2 * (2 * cut / rate))
            assert got[:, j] == pytest.approx(want, abs=1e-5)
    if n == 44100:
        tone = audio.resample(np.sin(2 * np.pi * 1000 * np.arange(n) / rate), rate, to)
        want = np.sin(2 * np.pi * 1000 * np.arange(len(tone)) / to)
        assert np.abs(tone - want)[100:-100].max() < 0.01


def test_headers(folder):
    whole = (folder / "r10.wav").read_bytes()
    assert audio.wav_duration(whole[:44], len(whole)) == 0.5
    assert audio.wav_duration(whole[:44], len(whole) - 48000) == 0.25  # truncated data
    assert audio.wav_duration(whole[:20], len(whole)) is None and audio.wav_duration(b"", 0) is None
    more = io.BytesIO(whole[:12] + b"LIST" + struct.pack("<I", 5) + b"abcde\0" + whole[12:]).getvalue()
    assert math.isclose(audio.wav_duration(more[:200], len(more)), 0.5)


def floats(path, x, rate, width):
    """A file of floats, behind a chunk of another kind."""
    x = np.atleast_2d(x)
    raw = x.T.astype(f"<f{width}").tobytes()
    fmt = struct.pack("<HHIIHH", 3, len(x), rate, rate * width * len(x), width * len(x), 8 * width)
    body = b"WAVE" + b"LIST" + struct.pack("<I", 5) + b"abcde\0" + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(raw)) + raw
    path.write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)


@pytest.mark.parametrize("width", [4, 8])
def test_floats(tmp_path, spark, width):
    x = np.array([[0.0, 0.5, -0.5, -1.0, 0.25], [0.0, 0.25, 0.5, 1.0, 0.125]])
    floats(tmp_path / "a.wav", x, 8000, width)
    row = audio.load_audio(spark, f"{tmp_path}/a.wav", mono=False).first()
    assert row["samples"] == x.tolist() and row["sample_rate"] == 8000
    assert [r["samples"] for r in audio.load_chunks(spark, f"{tmp_path}/a.wav", mono=False).orderBy("channel").collect()] == x.tolist()


@pytest.mark.parametrize("size, halo", [(7, 0), (1000, 30), (1 << 20, 5)])
@pytest.mark.parametrize("to", [None, 32000, 44100])
def test_chunks_are_the_whole_signal(spark, folder, size, halo, to):
    """Every cut, also of what is resampled, and the samples that chunks bring along."""
    if size == 7:
        rng = np.random.RandomState(1)
        wav(folder / "short.wav", rng.uniform(-1, 1, (2, 90)), 22050, 2)
        name = "short.wav"
    else:
        name = "r10.wav"
    want = np.array(audio.load_audio(spark, f"{folder}/{name}", to, mono=False).first()["samples"])
    rows = audio.load_chunks(spark, f"{folder}/{name}", to, mono=False, size=size, halo=halo).collect()
    assert all(len(r["samples"]) <= size + 2 * halo for r in rows)
    for r in rows:
        assert r["n_samples"] == want.shape[1] and (r["begin"], r["end"]) == (r["chunk"] * size, min(want.shape[1], (r["chunk"] + 1) * size))
        assert r["samples"] == pytest.approx(want[r["channel"], max(0, r["begin"] - halo) : r["end"] + halo].tolist(), abs=1e-6)
    assert sorted((r["channel"], r["chunk"]) for r in rows) == [(c, k) for c in range(2) for k in range(-(-want.shape[1] // size))]


def test_chunks_of_odd_files(spark, folder, tmp_path):
    wav(tmp_path / "none.wav", np.zeros(0))
    assert audio.load_chunks(spark, f"{tmp_path}/none.wav").count() == 0
    assert audio.load_chunks(spark, f"{folder}/*u*.wav", strict=False).count() == 0
    with pytest.raises(Exception, match="no PCM WAV"):
        audio.load_chunks(spark, f"{folder}/cut.wav").collect()
    with pytest.raises(FileNotFoundError):
        audio.load_chunks(spark, f"{folder}/nowhere.wav")
    with pytest.raises(FileNotFoundError):
        audio.load_audio(spark, f"{folder}/nowhere.wav")
    with pytest.raises(ValueError):
        audio.load_chunks(spark, f"{folder}/r10.wav", halo=-1)


def test_wav_as_a_data_source(spark, folder, tmp_path):
    rng = np.random.RandomState(2)
    (tmp_path / "more").mkdir()
    for k in range(3):
        wav(tmp_path / "more" / f"r{k}.wav", rng.uniform(-1, 1, (2, 4000 + k)), 16000)
    spark.dataSource.register(audio.WavSource)
    key = lambda r: (r["audio_path"], r["channel"], r["chunk"])
    got = sorted(spark.read.format("wav").options(samplerate=8000, size=500, halo=9, mono=False).load(f"{tmp_path}/more").collect(), key=key)
    assert got == sorted(audio.load_chunks(spark, f"{tmp_path}/more/*.wav", 8000, mono=False, size=500, halo=9).collect(), key=key) and len(got) == 2 * (4 + 5 + 5)
    with pytest.raises(Exception, match="no such file"):
        spark.read.format("wav").load(f"{tmp_path}/nowhere.wav").collect()


def test_headers_are_all_that_is_read(spark, tmp_path):
    """Files of a kilobyte and of six gigabytes, with and without a long chunk before the samples: as many bytes are read."""
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 32000, 64000, 2, 16)
    (tmp_path / "small.wav").write_bytes(b"RIFF" + struct.pack("<I", 0) + b"WAVE" + fmt + b"data" + struct.pack("<I", 1000) + bytes(1000))
    (tmp_path / "late.wav").write_bytes(b"RIFF" + struct.pack("<I", 0) + b"WAVE" + b"LIST" + struct.pack("<I", 200_000) + bytes(200_000) + fmt + b"data" + struct.pack("<I", 1000) + bytes(1000))
    wide = 6 << 30
    with open(tmp_path / "large.wav", "wb") as f:
        f.write(b"RF64" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + b"ds64" + struct.pack("<IQQQI", 28, wide + 72, wide, wide // 2, 0) + fmt + b"data" + struct.pack("<I", 0xFFFFFFFF))
        f.truncate(f.tell() + wide)
    found = {r["audio_path"].rpartition("/")[2]: r for r in audio.audio_headers(spark, f"{tmp_path}/*.wav").collect()}
    assert found["small.wav"]["n_samples"] == 500 and found["late.wav"]["n_samples"] == 500 and found["large.wav"]["n_samples"] == wide // 2
    assert found["large.wav"]["duration_s"] == wide / 64000
    assert all(r["bytes_read"] <= 200 for r in found.values())


def test_a_large_file_by_chunks(spark, tmp_path):
    """2.5 GB of samples: no row holds more than a chunk, no task's Python more than a few."""
    size = 5 << 29
    with open(tmp_path / "large.wav", "wb") as f:
        f.write(b"RIFF" + struct.pack("<I", 0) + b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 2, 32000, 128000, 4, 16) + b"data" + struct.pack("<I", size))
        f.truncate(f.tell() + size)

    def measure(batches):
        import resource

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in b.column(1)], pa.int64()), pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss] * len(b), pa.int64())], names=["n", "kb"])

    sound = audio.load_chunks(spark, f"{tmp_path}/large.wav")
    rows = sound.select("chunk", "samples").mapInArrow(measure, "n long, kb long").collect()
    assert sum(r["n"] for r in rows) == size // 4 and max(r["n"] for r in rows) == audio.CHUNK
    assert max(r["kb"] for r in rows) < 1_000_000
