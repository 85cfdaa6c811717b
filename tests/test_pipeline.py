"""Features, predictions, evaluation and stored pipelines, from files to reports."""

import math
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources import wav

from sonora.operators import features, matching
from sonora.operators.model import random_weights
from sonora.plans import components as C
from sonora.plans import pipeline as P
from sonora.plans import sql, store
from sonora.sources import annotations, audio

EXTRACTOR = C.SnrExtractor(8000, n_bands=3, baseline_s=1.0, band_high=3000.0)
RNG = np.random.RandomState(4)


def tones(seconds, calls, rate=8000):
    x = RNG.normal(0, 0.01, int(seconds * rate))
    for a, b in calls:
        t = np.arange(int(a * rate), int(b * rate))
        x[t] += 0.5 * np.sin(2 * np.pi * 1000 * t / rate)
    return x


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("recs")
    for name, seconds, calls in (("a", 2.0, [(0.5, 0.7), (1.2, 1.5)]), ("b c", 1.0, [(0.2, 0.4)]), ("short", 0.1, [])):
        wav(d / f"{name}.wav", tones(seconds, calls), 8000)
        (d / f"{name}_annotations.csv").write_text("name,start_seconds,stop_seconds\n" + "".join(f"x,{a * 1000},{b * 1000}\n" for a, b in calls))
    return d


class Loud(C.TinySegCnn):
    """A model whose answer is known: a frame's feature in one band, scaled."""

    def __init__(self):
        super().__init__(3, 20, 2)
        w = random_weights(3, 2)
        w = [(np.zeros_like(a), np.zeros_like(b)) for a, b in w]
        w[0][0][0, 1, 4] = 1.0  # the band of 1 kHz
        w[1][0][0, 0, 4] = w[2][0][0, 0, 2] = 1.0
        w[3][0][0, 0, 0] = 1.0
        w[3][1][0] = -4.0
        self.weights = w


def brute_features(x, s):
    """(frames, bands) by plain loops."""
    half, taper = s.n_fft // 2, np.zeros(s.n_fft)
    left = (s.n_fft - s.window) // 2
    taper[left : left + s.window] = np.hanning(s.window + 1)[:-1]
    padded = np.concatenate([x[half:0:-1], x, x[-2 : -half - 2 : -1]])
    edges = np.geomspace(s.band_low, s.band_high, s.n_bands + 1)
    freq = np.arange(s.n_fft // 2 + 1) * s.sample_rate / s.n_fft
    energy = []
    for i in range(1 + len(x) // s.hop):
        power = np.abs(np.fft.rfft(padded[i * s.hop : i * s.hop + s.n_fft] * taper)) ** 2
        energy.append([power[(freq >= a) & (freq < b)].sum() for a, b in zip(edges[:-1], edges[1:])])
    energy = np.array(energy)
    k = s.kernel // 2
    framed = np.pad(energy, ((k, k), (0, 0)))
    base = np.array([np.median(framed[i : i + s.kernel], axis=0) for i in range(len(energy))])
    snr = 10 * np.log10((energy + s.eps) / (base + s.eps))
    if not s.normalize:
        return snr
    lower = lambda a: np.sort(a, axis=0)[(len(a) - 1) // 2]
    m = lower(snr)
    return (snr - m) / (1.4826 * (lower(np.abs(snr - m)) + s.eps))


@pytest.mark.parametrize("normalize", [True, False])
def test_features_by_loops(spark, normalize):
    settings = C.SnrExtractor(8000, n_bands=3, baseline_s=0.3, band_high=3000.0, normalize=normalize, eps=1e-6)
    waves = {"x": tones(1.0, [(0.3, 0.5)]), "y": tones(0.2, [])}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in waves.items()] + [("none", None)], "recording_id string, samples array<double>")
    got = settings.extract(df).collect()
    for k, x in waves.items():
        want = brute_features(x, settings)
        rows = sorted((r for r in got if r["recording_id"] == k), key=lambda r: r["frame_idx"])
        assert len(rows) == len(want)
        assert np.array([r["features"] for r in rows]) == pytest.approx(want, rel=1e-5, abs=1e-5)
        assert [r["time_s"] for r in rows] == pytest.approx([i * 64 / 8000 for i in range(len(want))])
    assert settings.n_features == 3 and settings.frame_rate == 125 and settings.seconds_to_frames(0.1) == 12 and settings == C.SnrExtractor(8000, n_bands=3, baseline_s=0.3, band_high=3000.0, normalize=normalize, eps=1e-6)


@pytest.mark.parametrize("bad", [{"sample_rate": 0}, {"band_low": -1.0}, {"band_high": 5000.0}, {"n_bands": 0}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        C.SnrExtractor(**({"sample_rate": 8000, "band_high": 3000.0} | bad))


def test_wide_medians_are_those_of_neighbours(spark, monkeypatch):
    monkeypatch.setattr(features, "RUN", 16)
    x = RNG.rand(100)
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)] + [("one", 0, 2.0)], "recording_id string, frame_idx int, v double")
    for kernel in (3, 31, 151):
        sides = [{(r["recording_id"], r["frame_idx"]): r["baseline"] for r in features.median_filter(df, "v", kernel, ["recording_id"], "frame_idx", dense=d).collect()} for d in (False, True)]
        assert sides[0] == sides[1] and len(sides[0]) == 101


@pytest.mark.parametrize("size", [1, 37, 256, 1000, 5000])
def test_frames_are_the_same_for_every_cut(spark, size):
    """Cuts within and beyond a window, a hop that divides them or doesn't, ends that are reflected."""
    waves = [("x", RNG.rand(1024).tolist()), ("y", RNG.rand(300).tolist()), ("z", RNG.rand(1001).tolist()), ("none", None)]
    df = spark.createDataFrame([w for w in waves if size > 1 or w[0] != "x"], "recording_id string, samples array<double>")
    for n_fft, hop, window in ((256, 64, 200), (512, 77, 512)):
        want = {r[:3]: r["power"] for r in features.stft_power(df, n_fft, hop, window).collect()}
        got = {r[:3]: r["power"] for r in features.stft_power(features.cut_waves(df, size, n_fft // 2), n_fft, hop, window).collect()}
        assert got.keys() == want.keys() and [got[k] for k in want] == pytest.approx(list(want.values()), rel=1e-9, abs=1e-12)
        assert len({k[1] for k in want if k[0] == "z"}) == 1 + 1001 // hop
    with pytest.raises(Exception, match="more on both sides"):
        features.stft_power(features.cut_waves(df, 100, 127), 256, 64).collect()


def test_files_by_chunks_and_whole(spark, folder):
    """Predictions and reports of chunked files are those of whole ones, at another rate than the files' own, too."""
    trained, matcher = Loud(), C.GreedyIouMatcher(0.2)
    notes = annotations.read_annotations(spark, f"{folder}/*.csv")
    for extractor in (EXTRACTOR, C.SnrExtractor(11025, n_bands=3, baseline_s=1.0, band_high=3000.0)):
        sounds = [P.recordings(audio.load_audio(spark, f"{folder}/*.wav", extractor.sample_rate)), P.recordings(audio.load_chunks(spark, f"{folder}/*.wav", extractor.sample_rate, size=3000, halo=extractor.halo))]
        sides = [sorted(map(tuple, P.evaluate(s, notes, trained, extractor, C.HysteresisDecoder(), matcher).rows.select("recording_id", "duration_s", "n_gt", "n_pred", "tp", "frame_tp", "frame_fn").collect())) for s in sounds]
        assert sides[0] == sides[1] and len(sides[0]) == 3 and sides[0][0][4] == 2


def test_predict_and_evaluate(spark, folder):
    decoder, trained = C.HysteresisDecoder(pad_s=0.0), Loud()
    paths = [f"{folder}/b c.wav", f"{folder}/a.wav", f"{folder}/short.wav", f"file:{folder}/a.wav"]
    got = P.predict_recordings(spark, trained, EXTRACTOR, paths, decoder).collect()
    assert [(r["position"], r["audio_path"]) for r in got] == list(enumerate(p.removeprefix("file:") for p in paths))
    assert got[1]["intervals"] == got[3]["intervals"] and len(got[1]["intervals"]) == 2 and len(got[0]["intervals"]) == 1 and not got[2]["intervals"]
    assert [r["duration_s"] for r in got] == pytest.approx([1.0, 2.0, 0.096, 2.0], abs=1e-6)
    for i, (a, b) in zip(got[1]["intervals"], [(0.5, 0.7), (1.2, 1.5)]):
        assert abs(i["onset"] - a) < 0.05 and abs(i["offset"] - b) < 0.05
    totals = P.prediction_totals(P.predict_recordings(spark, trained, EXTRACTOR, paths, decoder)).first()
    assert (totals["n_recordings"], totals["n_intervals"]) == (4, 5)
    assert P.predict_recordings(spark, trained, EXTRACTOR, [], decoder).count() == 0
    with pytest.raises(FileNotFoundError):
        P.predict_recordings(spark, trained, EXTRACTOR, [f"{folder}/none.wav"], decoder)

    sound = P.recordings(audio.load_audio(spark, f"{folder}/*.wav", 8000))
    notes = annotations.read_annotations(spark, f"{folder}/*.csv")
    found = P.evaluate(sound, notes, trained, EXTRACTOR, decoder, C.GreedyIouMatcher(0.2))
    rows = {r["recording_id"].rpartition("/")[2]: r for r in found.rows.collect()}
    assert {k: (r["n_gt"], r["n_pred"], r["tp"], r["fp"], r["fn"]) for k, r in rows.items()} == {"a": (2, 2, 2, 0, 0), "b c": (1, 1, 1, 0, 0), "short": (0, 0, 0, 0, 0)}
    assert math.isnan(rows["short"]["onset_mae_ms"]) and rows["a"]["onset_mae_ms"] < 50 and rows["a"]["frame_f1"] > 0.8
    report = found.report.first()
    assert report["f1"] == pytest.approx(1.0) and report["n_matches"] == 3 and report["fp_per_minute"] == 0 and report["minutes"] == pytest.approx(3.1 / 60)
    assert report["frame_tp"] == sum(r["frame_tp"] for r in rows.values()) and report["frame_tn"] == sum(r["frame_tn"] for r in rows.values())
    with pytest.raises(ValueError):
        P.evaluate(sound.limit(0), notes, trained, EXTRACTOR, decoder, C.GreedyIouMatcher())


def test_report_adds_counts_up(spark):
    """Ratios are of summed counts; the errors are pooled; a recording without intervals has a row."""
    recs = spark.createDataFrame([(1, 60.0), (2, 120.0), (3, 0.0)], "recording_id long, duration_s double")
    counts = spark.createDataFrame([(1, 3, 2, 2, 0, 1), (2, 1, 4, 1, 3, 0)], "recording_id long, n_gt long, n_pred long, tp long, fp long, fn long")
    errors = spark.createDataFrame([(1, 10.0, 20.0), (1, -5.0, -10.0), (2, 100.0, 0.0)], "recording_id long, onset_error_ms double, offset_error_ms double")
    frames = spark.createDataFrame([(1, 0.9, 1.0), (1, 0.9, 0.0), (2, 0.1, 1.0), (2, float("nan"), 0.0)], "recording_id long, prob double, label double")
    rows = matching.evaluation_rows(recs, counts, errors, frames)
    report = matching.evaluation_report(rows, errors).first()
    assert rows.count() == 3 and (report["tp"], report["fp"], report["fn"]) == (3, 3, 1)
    assert report["precision"] == pytest.approx(0.5) and report["recall"] == pytest.approx(0.75) and report["fp_per_minute"] == pytest.approx(1.0)
    assert (report["frame_tp"], report["frame_fp"], report["frame_fn"], report["frame_tn"]) == (1, 1, 1, 1)
    assert report["onset_median_ms"] == 10 and report["onset_p95_ms"] == pytest.approx(np.percentile([10, 5, 100], 95))


def test_stored_pipelines(spark, tmp_path):
    trained, path = C.TinySegCnn(3, 20, 4, seed=3), f"{tmp_path}/p"
    decoder = C.HysteresisDecoder(enter=0.7, pad_s=0.01)
    C.save_pipeline(spark, trained, EXTRACTOR, decoder, path)
    model, extractor, found = C.load_pipeline(spark, path)
    assert extractor == EXTRACTOR and found == decoder and model.settings == trained.settings and model.receptive_field == 20
    x = RNG.rand(2, 3, 20)
    assert (model.forward(x) == trained.forward(x)).all()
    with pytest.raises(Exception, match="exists"):
        C.save_pipeline(spark, trained, EXTRACTOR, decoder, path)
    C.save_pipeline(spark, Loud(), EXTRACTOR, decoder, path, overwrite=True)
    with pytest.raises(ValueError, match="Loud"):
        C.load_pipeline(spark, path)
    with pytest.raises(TypeError):
        C.save_pipeline(spark, trained, decoder, decoder, f"{tmp_path}/q")
    with pytest.raises(FileNotFoundError):
        C.load_pipeline(spark, f"{tmp_path}/none")


def test_features_are_extracted_once(spark, tmp_path):
    """A second evaluation over the same files extracts nothing; changed files and other settings are extracted."""
    import os

    seen = []

    @dataclass(frozen=True)
    class Counting(C.SnrExtractor):
        def extract(self, waves):
            seen.append(sorted(r[0].rpartition("/")[2] for r in waves.select("recording_id").distinct().collect()))
            return super().extract(waves)

    for name, calls in (("a", [(0.5, 0.7)]), ("b", [(0.2, 0.4)])):
        wav(tmp_path / f"{name}.wav", tones(1.0, calls), 8000)
        (tmp_path / f"{name}_annotations.csv").write_text("name,start_seconds,stop_seconds\n" + "".join(f"x,{a * 1000},{b * 1000}\n" for a, b in calls))
    made = lambda **more: Counting(**{"sample_rate": 8000, "n_bands": 3, "baseline_s": 1.0, "band_high": 3000.0} | more)
    paths, folder, notes = f"{tmp_path}/*.wav", f"{tmp_path}/store", annotations.read_annotations(spark, f"{tmp_path}/*.csv")

    def evaluated(extractor):
        found = store.stored_features(spark, paths, extractor, folder)
        return P.evaluate(store.durations(spark, paths), notes, Loud(), extractor, C.HysteresisDecoder(), C.GreedyIouMatcher(), features=found).report.first()

    first = evaluated(made())
    assert seen == [["a", "b"]] and (first["tp"], first["fp"], first["fn"]) == (2, 0, 0)
    sound = P.recordings(audio.load_audio(spark, paths, 8000))
    assert first == P.evaluate(sound, notes, Loud(), EXTRACTOR, C.HysteresisDecoder(), C.GreedyIouMatcher()).report.first()
    assert evaluated(made()) == first and len(seen) == 1
    evaluated(made(eps=1e-9))
    assert seen[1:] == [["a", "b"]]
    wav(tmp_path / "b.wav", tones(1.5, []), 8000)
    os.utime(tmp_path / "b.wav", (2_000_000_000, 2_000_000_000))
    changed = evaluated(made())
    assert seen[2:] == [["b"]] and (changed["tp"], changed["fn"]) == (1, 1)
    assert store.stored_features(spark, f"{tmp_path}/b.wav", made(), folder).count() == 1 + 12000 // 64


@C.register
@dataclass(frozen=True)
class Above(C.Decoder):
    """A user's decoder: every frame above a level is an interval."""

    level: float = 0.5

    def decode(self, frames):
        return frames.filter((F.col("prob") > self.level) & ~F.isnan("prob")).select("recording_id", F.col("time_s").cast("double").alias("onset"), F.col("time_s").cast("double").alias("offset"))


def test_parts_of_users(spark, tmp_path):
    """Stored and read back, and called from SQL."""
    C.save_pipeline(spark, C.TinySegCnn(3, 20, 4), EXTRACTOR, Above(0.25), f"{tmp_path}/p")
    assert C.load_pipeline(spark, f"{tmp_path}/p")[2] == Above(0.25)
    assert C.register(Above) is Above
    for bad in (type("Above", (C.Decoder,), {}), int):
        with pytest.raises((TypeError, ValueError)):
            C.register(bad)
    rows = [(k, i, i * 0.25, p) for k in ("a", "b") for i, p in enumerate([0.1, 0.9, 0.5, None, 0.3, 0.1, 0.9, float("nan"), 0.9])]
    frames = spark.createDataFrame(rows, "recording_id string, frame_idx int, time_s double, prob double")
    frames.createOrReplaceTempView("frames_of_users")
    rule = C.HysteresisDecoder(0.8, 0.2, 0.1, 0.3, 0.5)
    level = 0.25
    for name, decoder, own in (("above", Above(level), lambda frames: ((t, t) for t, p in frames if p is not None and p > level and p == p)), ("calls", rule, rule)):
        sql.register_decoder(spark, name, own)
        got = spark.sql(f"SELECT * FROM {name}(TABLE(SELECT * FROM frames_of_users) PARTITION BY recording_id ORDER BY frame_idx)")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, decoder.decode(frames).collect())) and got.count()
    with pytest.raises(TypeError):
        sql.register_decoder(spark, "no", 3)


def test_flagship_from_sql(spark):
    import os

    from sonora.plans import registry
    from sonora.sources import tables

    where = "/root/testdata/sf0.001"
    if not os.path.isdir(where):
        pytest.skip("no test tables here")
    tables.frames(spark, where).createOrReplaceTempView("flagship_frames")
    sql.register_decoder(spark, "flagship", C.HysteresisDecoder(*(getattr(registry.RULE, f) for f in ("enter", "exit", "min_duration_s", "min_gap_s", "pad_s"))), "bigint")
    got = spark.sql("SELECT recording_id, round(onset, 6) + 0.0 AS onset, round(offset, 6) + 0.0 AS offset FROM flagship(TABLE(SELECT recording_id, frame_idx, time_s, prob FROM flagship_frames) PARTITION BY recording_id ORDER BY frame_idx)")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, registry.QUERIES["hysteresis_decode"](spark, where).collect())) and got.count()


def test_models_are_checked(spark):
    for bad in ((0, 20), (3, 0), (3, 20, 0)):
        with pytest.raises(ValueError):
            C.TinySegCnn(*bad)
    with pytest.raises(ValueError):
        C.TinySegCnn(3, 20).forward(np.zeros((1, 2, 20)))
    frames = spark.createDataFrame([("a", i, [0.0, 1.0]) for i in range(30)], "recording_id string, frame_idx int, features array<double>")
    with pytest.raises(Exception, match="must have 3 bands"):
        C.TinySegCnn(3, 20).predict(frames).collect()
    with pytest.raises(ValueError):
        C.TinySegCnn(2, 20).predict(frames, 21)
    assert C.TinySegCnn(2, 20).predict(frames.filter("frame_idx < 5")).filter(F.col("prob").between(0, 1)).count() == 5
