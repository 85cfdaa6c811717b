"""The registered queries over the driver's tables, and the same rows in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonora.functions import signal as S
from sonora.operators import decode, features, matching, windows
from sonora.operators.model import random_weights, sliding_predict
from sonora.sources import annotations
from sonora.sources import tables as T
from sonora.sources.storage import drained, materialise, replayed
from sonora.streaming import decode as streaming

from . import pipeline, training

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEY = "recording_id"
RULE = decode.Hysteresis(0.6, 0.4, 0.03, 0.02, 0.004)
#: Small settings for 64-sample waveforms.
N_FFT, FFT_HOP, LOW, HIGH, BANDS, KERNEL = 16, 4, 0.5, 7.9, 4, 3

FRAMES = """frames AS (SELECT user_id AS recording_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS frame_idx, value, least(value / 100, 1.0::DOUBLE) AS prob,
  (event_type IN ('purchase', 'signup'))::INT::DOUBLE AS label, (value - 50) / 25 AS logit FROM events), timed AS (SELECT *, frame_idx * 0.008::DOUBLE AS time_s FROM frames)"""
GT = """gt AS (SELECT l_orderkey AS recording_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS gi, (l_partkey % 50)::DOUBLE AS onset, (l_partkey % 50)::DOUBLE + l_quantity AS offset_ FROM lineitem),
  pred AS (SELECT recording_id, gi AS pi, onset + ((gi * 7 + recording_id) % 9 - 4) * 0.5::DOUBLE AS onset, offset_ + ((gi * 5 + recording_id) % 11) * 0.5::DOUBLE + 4 AS offset_ FROM gt WHERE (gi + recording_id) % 5 <> 0)"""
_IOU = "greatest(0.0::DOUBLE, least(g.offset_, p.offset_) - greatest(g.onset, p.onset))"
PAIRS = f"""{GT}, pairs AS (SELECT * FROM (SELECT g.recording_id, g.gi, p.pi, CASE WHEN (g.offset_ - g.onset) + (p.offset_ - p.onset) - {_IOU} <= 0 THEN 0.0::DOUBLE ELSE {_IOU} / ((g.offset_ - g.onset) + (p.offset_ - p.onset) - {_IOU}) END AS iou
  FROM gt g JOIN pred p USING (recording_id)) WHERE iou >= 0.2::DOUBLE)"""
MATCHES = f"""{PAIRS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY iou DESC, gi, pi) AS rk FROM pairs),
  walk AS (SELECT DISTINCT recording_id, 0::BIGINT AS rk, []::BIGINT[] AS ug, []::BIGINT[] AS up, NULL::BIGINT AS gi, NULL::BIGINT AS pi, NULL::DOUBLE AS iou FROM ranked UNION ALL
    SELECT w.recording_id, r.rk, CASE WHEN list_contains(w.ug, r.gi) OR list_contains(w.up, r.pi) THEN w.ug ELSE list_append(w.ug, r.gi) END, CASE WHEN list_contains(w.ug, r.gi) OR list_contains(w.up, r.pi) THEN w.up ELSE list_append(w.up, r.pi) END,
      CASE WHEN list_contains(w.ug, r.gi) OR list_contains(w.up, r.pi) THEN NULL ELSE r.gi END, CASE WHEN list_contains(w.ug, r.gi) OR list_contains(w.up, r.pi) THEN NULL ELSE r.pi END, r.iou
    FROM walk w JOIN ranked r ON r.recording_id = w.recording_id AND r.rk = w.rk + 1),
  matches AS (SELECT recording_id, (row_number() OVER (PARTITION BY recording_id ORDER BY rk) - 1)::INT AS match_rank, gi, pi, iou FROM walk WHERE gi IS NOT NULL)"""
COUNTS = f"""{MATCHES}, counts AS (SELECT recording_id, sum(a)::BIGINT AS n_gt, sum(b)::BIGINT AS n_pred, sum(c)::BIGINT AS tp, (sum(b) - sum(c))::BIGINT AS fp, (sum(a) - sum(c))::BIGINT AS fn
  FROM (SELECT recording_id, 1 AS a, 0 AS b, 0 AS c FROM gt UNION ALL SELECT recording_id, 0, 1, 0 FROM pred UNION ALL SELECT recording_id, 0, 0, 1 FROM matches) GROUP BY recording_id)"""
ERRORS = f"""{MATCHES}, errors AS (SELECT m.recording_id, m.gi, m.pi, (p.onset - g.onset) * 1000 AS onset_error_ms, (p.offset_ - g.offset_) * 1000 AS offset_error_ms FROM matches m JOIN gt g USING (recording_id, gi) JOIN pred p ON p.recording_id = m.recording_id AND p.pi = m.pi)"""
MASK = f"""{FRAMES}, ev AS (SELECT *, CASE WHEN prob <= 0.4 THEN false WHEN prob >= 0.6 THEN true END AS event FROM timed),
  masked AS (SELECT *, prob >= 0.6 OR coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS mask FROM ev)"""
RUNS = f"""{MASK}, st AS (SELECT *, (mask AND NOT coalesce(lag(mask) OVER (PARTITION BY recording_id ORDER BY frame_idx), false))::INT AS s FROM masked),
  rn AS (SELECT *, sum(s) OVER (PARTITION BY recording_id ORDER BY frame_idx) AS run FROM st),
  intervals AS (SELECT recording_id, min(time_s) AS onset, max(time_s) AS offset_ FROM rn WHERE mask GROUP BY recording_id, run)"""
MERGED = f"""{RUNS}, gp AS (SELECT *, (NOT coalesce(onset - lag(offset_) OVER (PARTITION BY recording_id ORDER BY onset) < 0.02::DOUBLE, false))::INT AS n FROM intervals),
  gr AS (SELECT *, sum(n) OVER (PARTITION BY recording_id ORDER BY onset) AS run FROM gp), merged AS (SELECT recording_id, min(onset) AS onset, max(offset_) AS offset_ FROM gr GROUP BY recording_id, run)"""
POWER = f"""waves AS (SELECT vec_id AS recording_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
  grid AS (SELECT t, k, n, abs(t * {FFT_HOP} + n - {N_FFT // 2}) AS raw, 0.5 - 0.5 * cos(2 * pi() * n / {N_FFT}) AS w FROM range(17) a(t), range({N_FFT // 2 + 1}) b(k), range({N_FFT}) c(n)),
  terms AS (SELECT recording_id, t, k, n, w * x[(CASE WHEN raw > 63 THEN 126 - raw ELSE raw END + 1)::INT] AS v FROM waves, grid),
  power AS (SELECT recording_id, t::INT AS frame_idx, k::INT AS bin, pow(sum(v * cos(2 * pi() * k * n / {N_FFT})), 2) + pow(sum(v * sin(2 * pi() * k * n / {N_FFT})), 2) AS power FROM terms GROUP BY recording_id, t, k)"""
_EDGES = f"SELECT i::INT AS band, {LOW}::DOUBLE * pow({HIGH}::DOUBLE / {LOW}, i / {BANDS}::DOUBLE) AS lo, CASE WHEN i = {BANDS - 1} THEN {HIGH}::DOUBLE ELSE {LOW}::DOUBLE * pow({HIGH}::DOUBLE / {LOW}, (i + 1) / {BANDS}::DOUBLE) END AS hi FROM range({BANDS}) r(i)"
ENERGY = f"""{POWER}, bands AS ({_EDGES}), energy AS (SELECT recording_id, frame_idx, band::INT AS band, sum(CASE WHEN bin >= lo AND bin < hi THEN power ELSE 0 END) AS energy FROM power, bands GROUP BY recording_id, frame_idx, band)"""


def _median(table: str, value: str, part: str, kernel: int, out: str) -> str:
    half = kernel // 2
    return f"""{out} AS (SELECT *, list_sort(list_concat(w, list_transform(range({kernel} - len(w)), lambda i: 0.0::DOUBLE)))[{half + 1}] AS baseline FROM (SELECT *, list({value}) OVER (PARTITION BY {part} ORDER BY frame_idx ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS w FROM {table}))"""


def _normalised(table: str, value: str, part: str, out: str, eps: str = "1e-12") -> str:
    return f"""md AS (SELECT {part}, quantile_disc({value}, 0.5) AS m FROM {table} GROUP BY ALL), dv AS (SELECT {table}.*, m FROM {table} JOIN md USING ({part})), mad AS (SELECT {part}, quantile_disc(abs({value} - m), 0.5) AS s FROM dv GROUP BY ALL),
  {out} AS (SELECT dv.*, ({value} - m) / (1.4826 * (s + {eps})) AS z FROM dv JOIN mad USING ({part}))"""


def _r(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in cols})


def query(sql: str | None = None):
    """Registers a query under its name, and its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        Q[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _ratios(a: str, b: str, c: str) -> str:
    p, r = (f"(CASE WHEN {a} + {x} > 0 THEN {a} / ({a} + {x} + 1e-12) ELSE 0.0::DOUBLE END)" for x in (b, c))
    return f"round({p}, 6) + 0.0 AS precision, round({r}, 6) + 0.0 AS recall, round(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r} + 1e-12) ELSE 0.0::DOUBLE END, 6) + 0.0 AS f1"


@query(f"WITH {MERGED}, ends AS (SELECT recording_id, min(time_s) AS a, max(time_s) AS b FROM timed GROUP BY recording_id) SELECT recording_id, round(greatest(onset - 0.004::DOUBLE, a), 6) + 0.0 AS onset, round(least(offset_ + 0.004::DOUBLE, b), 6) + 0.0 AS offset FROM merged JOIN ends USING (recording_id) WHERE offset_ - onset >= 0.03::DOUBLE")
def hysteresis_decode(spark, sf_dir):
    return rounded(decode.hysteresis_decode(T.frames(spark, sf_dir), RULE, [KEY]), "onset", "offset")


@query(ORACLE_SQL["hysteresis_decode"])
def hysteresis_stream(spark, sf_dir):
    """All frames as a stream of micro-batches, cut by their times as they would arrive, and not in order within one."""
    frames = T.frames(spark, sf_dir).select(KEY, "frame_idx", "time_s", "prob")
    sized = frames.join(frames.groupBy(KEY).agg(F.count("*").alias("n_frames")), KEY)
    stream = streaming.hysteresis_stream(replayed(sized.repartitionByRange(8, "frame_idx"), 4), RULE, n_frames="n_frames")
    return rounded(drained(stream), "onset", "offset")


@query(f"WITH {MASK} SELECT recording_id, frame_idx, mask FROM masked")
def hysteresis_mask(spark, sf_dir):
    return decode.hysteresis_mask(T.frames(spark, sf_dir), RULE, [KEY]).select(KEY, "frame_idx", "mask")


@query(f"WITH {RUNS} SELECT recording_id, round(onset, 6) + 0.0 AS onset, round(offset_, 6) + 0.0 AS offset FROM intervals")
def mask_intervals(spark, sf_dir):
    return rounded(decode.mask_intervals(decode.hysteresis_mask(T.frames(spark, sf_dir), RULE, [KEY]), [KEY]), "onset", "offset")


@query(f"WITH {MERGED} SELECT recording_id, round(onset, 6) + 0.0 AS onset, round(offset_, 6) + 0.0 AS offset FROM merged")
def merge_gaps(spark, sf_dir):
    runs = decode.mask_intervals(decode.hysteresis_mask(T.frames(spark, sf_dir), RULE, [KEY]), [KEY])
    return rounded(decode.merge_gaps(runs, RULE.min_gap_s, [KEY]), "onset", "offset")


@query("SELECT o_orderkey AS recording_id, round_even(o_totalprice / 10000 / 0.008::DOUBLE, 0)::INT AS n_frames FROM orders")
def seconds_to_frames(spark, sf_dir):
    return T.recordings(spark, sf_dir).select(KEY, S.seconds_to_frames("duration_s", T.HOP_S).alias("n_frames"))


@query(f"WITH {FRAMES} SELECT recording_id, frame_idx, round(frame_idx * 0.008::DOUBLE, 6) + 0.0 AS time_s FROM frames")
def frames_to_seconds(spark, sf_dir):
    return rounded(T.frames(spark, sf_dir).select(KEY, "frame_idx", S.frames_to_seconds("frame_idx", T.HOP_S).alias("time_s")), "time_s")


@query("""WITH p AS (SELECT p_partkey AS recording_id, p_size::DOUBLE AS a, p_size + p_retailprice AS b FROM part), e AS (SELECT *, unnest(range(8)) AS i FROM p)
  SELECT recording_id, i::INT AS band, round(CASE WHEN i = 0 THEN a ELSE a * pow(b / a, i / 8.0::DOUBLE) END, 6) + 0.0 AS lo, round(CASE WHEN i = 7 THEN b ELSE a * pow(b / a, (i + 1) / 8.0::DOUBLE) END, 6) + 0.0 AS hi FROM e""")
def band_edges(spark, sf_dir):
    """Each part's own lowest and highest frequency."""
    rows = T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias(KEY), F.col("p_size").alias("a"), (F.col("p_size") + F.col("p_retailprice")).alias("b"))
    return rounded(rows.select(KEY, F.inline(S.band_edges_of("a", "b", 8))), "lo", "hi")


@query(f"WITH {GT} SELECT recording_id, gi, offset_ - onset AS duration FROM gt")
def interval_duration(spark, sf_dir):
    return T.annotated(spark, sf_dir).select(KEY, "gi", S.interval_duration("onset", "offset").alias("duration"))


@query(f"WITH {PAIRS.replace('>= 0.2::DOUBLE', '>= 0')} SELECT recording_id, gi, pi, round(iou, 6) + 0.0 AS iou FROM pairs")
def interval_iou(spark, sf_dir):
    return rounded(matching.iou_pairs(T.annotated(spark, sf_dir), T.predicted(spark, sf_dir), 0.0).select(KEY, "gi", "pi", "iou"), "iou")


@query(f"WITH RECURSIVE {COUNTS} SELECT recording_id, {_ratios('tp', 'fp', 'fn')} FROM counts")
def precision_recall_f1(spark, sf_dir):
    return rounded(matching.event_metrics(_counts(spark, sf_dir)).select(KEY, "precision", "recall", "f1"), "precision", "recall", "f1")


@query(f"WITH {FRAMES} SELECT recording_id, frame_idx, round(1 / (1 + exp(-logit)), 6) + 0.0 AS p FROM frames")
def sigmoid(spark, sf_dir):
    return rounded(T.frames(spark, sf_dir).select(KEY, "frame_idx", S.sigmoid("logit").alias("p")), "p")


@query("SELECT vec_id AS recording_id, i::INT AS i, round((embedding[2 * i + 1]::DOUBLE + embedding[2 * i + 2]::DOUBLE) / 2, 6) + 0.0 AS x FROM embeddings, range(32) t(i)")
def mono_mix(spark, sf_dir):
    return rounded(T.waveforms(spark, sf_dir).select(KEY, F.posexplode(S.mono_mix("samples", 2)).alias("i", "x")), "x")


@query("SELECT vec_id AS recording_id, i::INT AS i, round(embedding[least(i, 63) + 1]::DOUBLE, 6) + 0.0 AS x FROM embeddings, range(80) t(i)")
def edge_pad(spark, sf_dir):
    return rounded(T.waveforms(spark, sf_dir).select(KEY, F.posexplode(S.edge_pad("samples", 80)).alias("i", "x")), "x")


@query("SELECT vec_id AS recording_id, i::INT AS i, round(embedding[least(vec_id % 64, 48) + i + 1]::DOUBLE, 6) + 0.0 AS x FROM embeddings, range(16) t(i)")
def window_slice(spark, sf_dir):
    cut = T.waveforms(spark, sf_dir).withColumn("start", (F.col(KEY) % 64).cast("int"))
    return rounded(cut.select(KEY, F.posexplode(S.window_slice("samples", "start", 16)).alias("i", "x")), "x")


def _chunks(spark, sf_dir):
    """Waveforms as chunks of 20 samples, as if they were long recordings."""
    return features.cut_waves(T.waveforms(spark, sf_dir), 20, N_FFT // 2)


@query(f"WITH {POWER} SELECT recording_id, frame_idx, bin, {_r('power')} FROM power")
def stft_power(spark, sf_dir):
    return rounded(features.stft_power(_chunks(spark, sf_dir), N_FFT, FFT_HOP), "power")


def _energy(spark, sf_dir):
    return features.band_energy(features.stft_power(_chunks(spark, sf_dir), N_FFT, FFT_HOP), LOW, HIGH, BANDS, 1.0)


@query(f"WITH {ENERGY} SELECT recording_id, frame_idx, band, {_r('energy')} FROM energy")
def band_energy(spark, sf_dir):
    return rounded(_energy(spark, sf_dir), "energy")


@query(f"WITH {FRAMES}, {_median('frames', 'value', 'recording_id', 9, 'based')} SELECT recording_id, frame_idx, round(baseline, 6) + 0.0 AS baseline FROM based")
def median_filter(spark, sf_dir):
    return rounded(features.median_filter(T.frames(spark, sf_dir), "value", 9, [KEY], "frame_idx").select(KEY, "frame_idx", "baseline"), "baseline")


@query(f"WITH {FRAMES}, {_median('frames', 'value', 'recording_id', 9, 'based')} SELECT recording_id, frame_idx, round(10 * log10((value + 1e-12) / (baseline + 1e-12)), 6) + 0.0 AS snr FROM based")
def snr_db(spark, sf_dir):
    based = features.median_filter(T.frames(spark, sf_dir), "value", 9, [KEY], "frame_idx")
    return rounded(based.select(KEY, "frame_idx", S.snr_db("value", "baseline").alias("snr")), "snr")


@query(f"WITH {FRAMES}, {_normalised('frames', 'value', 'recording_id', 'nz')} SELECT recording_id, frame_idx, round(z, 6) + 0.0 AS z FROM nz")
def robust_normalize(spark, sf_dir):
    return rounded(features.robust_normalize(T.frames(spark, sf_dir), "value", [KEY]).select(KEY, "frame_idx", "z"), "z")


#: The small transforms' bins are 1 kHz wide at this rate, so windows, hops and bands are those of the other queries.
SNR = features.SnrSettings(16_000, hop_ms=0.25, n_bands=BANDS, win_ms=1.0, band_low=LOW * 1000, band_high=HIGH * 1000, baseline_s=0.00075, eps=0.01)


@query(f"WITH {ENERGY}, {_median('energy', 'energy', 'recording_id, band', KERNEL, 'based')}, snrs AS (SELECT recording_id, frame_idx, band, 10 * log10((energy + 0.01::DOUBLE) / (baseline + 0.01::DOUBLE)) AS snr FROM based), {_normalised('snrs', 'snr', 'recording_id, band', 'nz', '0.01::DOUBLE')} SELECT recording_id, frame_idx, round(frame_idx * 0.25::DOUBLE, 3) AS time_ms, band, round(z, 4) + 0.0 AS feature FROM nz")
def snr_features(spark, sf_dir):
    found = features.snr_features(_chunks(spark, sf_dir), SNR)
    return found.select(KEY, "frame_idx", F.round(F.col("time_s").cast("double") * 1000, 3).alias("time_ms"), "band", (F.round("feature", 4) + 0.0).alias("feature"))


@query(f"WITH {FRAMES}, {_median('frames', 'value', 'recording_id', 51, 'based')} SELECT recording_id, frame_idx, round(baseline, 6) + 0.0 AS baseline FROM based")
def median_filter_wide(spark, sf_dir):
    return rounded(features.median_filter(T.frames(spark, sf_dir).select(KEY, "frame_idx", "value"), "value", 51, [KEY], "frame_idx").select(KEY, "frame_idx", "baseline"), "baseline")


def _sizes(spark, sf_dir):
    return T.frames(spark, sf_dir).groupBy(KEY).agg(F.count("*").alias("n_frames"))


@query(f"WITH {FRAMES}, sizes AS (SELECT recording_id, count(*) AS n FROM frames GROUP BY ALL) SELECT recording_id, unnest(range(0, n - 25 + 1, 6))::INT AS start_frame FROM sizes WHERE n >= 25")
def window_index(spark, sf_dir):
    return windows.window_index(_sizes(spark, sf_dir), 25, 6)


@query("SELECT o_orderkey AS recording_id, n_frames, CASE WHEN n_frames >= 250 THEN ((n_frames - 250) // 62 + 1)::BIGINT ELSE 0::BIGINT END AS n_windows FROM (SELECT o_orderkey, round_even(o_totalprice / 10000 / 0.008::DOUBLE, 0)::INT AS n_frames FROM orders)")
def estimate_windows(spark, sf_dir):
    return windows.estimate_windows(T.recordings(spark, sf_dir), T.HOP_S, 2.0, 0.5).select(KEY, "n_frames", "n_windows")


_WINDOWS = f"{FRAMES}, sizes AS (SELECT recording_id, count(*) AS n FROM frames GROUP BY ALL), starts AS (SELECT recording_id, unnest(range(0, n - 25 + 1, 6)) AS s FROM sizes WHERE n >= 25)"


@query(f"WITH {_WINDOWS}, scored AS (SELECT f.recording_id, f.frame_idx, avg(prob * (1 + s % 3)) AS score FROM frames f JOIN starts USING (recording_id) WHERE frame_idx >= s AND frame_idx < s + 25 GROUP BY ALL) SELECT f.recording_id, f.frame_idx, round(coalesce(score, 0.0::DOUBLE), 6) + 0.0 AS score FROM frames f LEFT JOIN scored USING (recording_id, frame_idx)")
def overlap_average(spark, sf_dir):
    frames = T.frames(spark, sf_dir).select(KEY, "frame_idx", "prob")
    covered = windows.window_index(_sizes(spark, sf_dir), 25, 6).select(KEY, "start_frame", F.explode(F.sequence(F.col("start_frame"), F.col("start_frame") + 24)).alias("frame_idx"))
    scores = covered.join(frames, [KEY, "frame_idx"]).withColumn("score", F.col("prob") * (1 + F.col("start_frame") % 3))
    return rounded(windows.overlap_average(frames, scores), "score")


@query()
def sliding_predict_cnn(spark, sf_dir):
    """Rows only: a convolutional model's forward pass has no SQL."""
    frames = T.frames(spark, sf_dir).select(KEY, "frame_idx", F.array(F.col("value") / 100, F.col("prob")).alias("features"))
    return sliding_predict(frames, random_weights(n_bands=2, base=8, seed=1), 25, 6)


@query(f"WITH {FRAMES}, {GT}, i AS (SELECT DISTINCT recording_id, onset, offset_ FROM gt) SELECT f.recording_id, f.frame_idx, (EXISTS (SELECT 1 FROM i WHERE i.recording_id = f.recording_id AND i.onset <= f.frame_idx AND f.frame_idx <= i.offset_))::INT::DOUBLE AS label FROM frames f")
def frame_labels(spark, sf_dir):
    frames = T.frames(spark, sf_dir).select(KEY, "frame_idx", F.col("frame_idx").cast("double").alias("time_s"))
    return windows.frame_labels(frames, T.annotated(spark, sf_dir)).select(KEY, "frame_idx", "label")


def _pairs(spark, sf_dir):
    return matching.iou_pairs(T.annotated(spark, sf_dir), T.predicted(spark, sf_dir), 0.2)


def _aligned(spark, sf_dir):
    return matching.aligned(T.annotated(spark, sf_dir), T.predicted(spark, sf_dir), 0.2)


def _counts(spark, sf_dir):
    return matching.aligned_counts(_aligned(spark, sf_dir))


def _errors(spark, sf_dir, tolerance=None):
    return matching.aligned_errors(_aligned(spark, sf_dir), tolerance)


@query(f"WITH {PAIRS} SELECT recording_id, gi, pi, round(iou, 6) + 0.0 AS iou FROM pairs")
def iou_pairs(spark, sf_dir):
    return rounded(_pairs(spark, sf_dir).select(KEY, "gi", "pi", "iou"), "iou")


@query(f"WITH RECURSIVE {MATCHES} SELECT recording_id, match_rank, gi, pi, round(iou, 6) + 0.0 AS iou FROM matches")
def iou_match(spark, sf_dir):
    return rounded(matching.matched(_aligned(spark, sf_dir)), "iou")


@query(f"WITH RECURSIVE {MATCHES} SELECT recording_id, gi, onset, offset_ AS offset FROM gt WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.recording_id = gt.recording_id AND m.gi = gt.gi)")
def missed_events(spark, sf_dir):
    return matching.alone(_aligned(spark, sf_dir), "g")


@query(f"WITH RECURSIVE {MATCHES} SELECT recording_id, pi, onset, offset_ AS offset FROM pred WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.recording_id = pred.recording_id AND m.pi = pred.pi)")
def false_alarms(spark, sf_dir):
    return matching.alone(_aligned(spark, sf_dir), "p")


@query(f"WITH RECURSIVE {COUNTS} SELECT recording_id, n_gt, n_pred, tp, fp, fn, {_ratios('tp', 'fp', 'fn')} FROM counts")
def event_metrics(spark, sf_dir):
    return rounded(matching.event_metrics(_counts(spark, sf_dir)), "precision", "recall", "f1")


@query(f"WITH {FRAMES}, c AS (SELECT recording_id, count(*) FILTER (prob >= 0.5 AND label >= 0.5) AS tp, count(*) FILTER (prob >= 0.5 AND label < 0.5) AS fp, count(*) FILTER (prob < 0.5 AND label >= 0.5) AS fn, count(*) FILTER (prob < 0.5 AND label < 0.5) AS tn FROM frames GROUP BY ALL) SELECT recording_id, tp, fp, fn, tn, {_ratios('tp', 'fp', 'fn')} FROM c")
def frame_metrics(spark, sf_dir):
    return rounded(matching.frame_metrics(T.frames(spark, sf_dir), [KEY]), "precision", "recall", "f1")


_STATS = ", ".join(f"round({f}, 6) + 0.0 AS {side}_{name}_ms" for side in ("onset", "offset") for name, f in (("median", f"quantile_cont({side}_error_ms, 0.5)"), ("mae", f"avg(abs({side}_error_ms))"), ("p95", f"quantile_cont(abs({side}_error_ms), 0.95)")))
_STAT_COLS = [f"{side}_{name}_ms" for side in ("onset", "offset") for name in ("median", "mae", "p95")]


@query(f"WITH RECURSIVE {ERRORS} SELECT recording_id, gi, pi, {_r('onset_error_ms', 'offset_error_ms')} FROM errors")
def boundary_errors(spark, sf_dir):
    return rounded(_errors(spark, sf_dir), "onset_error_ms", "offset_error_ms")


@query(f"WITH RECURSIVE {ERRORS} SELECT recording_id, count(*) AS n_matches, {_STATS} FROM errors GROUP BY recording_id")
def boundary_accuracy(spark, sf_dir):
    return rounded(matching.error_stats(_errors(spark, sf_dir), [KEY]), *_STAT_COLS)


@query(f"WITH RECURSIVE {ERRORS} SELECT recording_id, count(*) AS n_matches, {_STATS} FROM errors WHERE abs(onset_error_ms) <= 5000 AND abs(offset_error_ms) <= 5000 GROUP BY recording_id")
def boundary_accuracy_tol(spark, sf_dir):
    return rounded(matching.error_stats(_errors(spark, sf_dir, 5000.0), [KEY]), *_STAT_COLS)


@query(f"WITH RECURSIVE {ERRORS} SELECT count(*) AS n_matches, {_STATS} FROM errors")
def error_stats(spark, sf_dir):
    return rounded(matching.error_stats(_errors(spark, sf_dir), []), *_STAT_COLS)


_FLAGGED = f"""{FRAMES}, flagged AS (SELECT recording_id, count(*) FILTER (prob >= 0.5 AND label >= 0.5) AS frame_tp, count(*) FILTER (prob >= 0.5 AND label < 0.5) AS frame_fp, count(*) FILTER (prob < 0.5 AND label >= 0.5) AS frame_fn, count(*) FILTER (prob < 0.5 AND label < 0.5) AS frame_tn FROM frames GROUP BY ALL)"""
_ROWS = f"""{COUNTS}, {ERRORS.removeprefix(MATCHES)[2:]}, {_FLAGGED}, stats AS (SELECT recording_id, count(*) AS n_matches, {_STATS} FROM errors GROUP BY recording_id),
  rows_ AS (SELECT o_orderkey AS recording_id, o_totalprice / 10000 AS duration_s, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("n_gt", "n_pred", "tp", "fp", "fn", "frame_tp", "frame_fp", "frame_fn", "frame_tn", "n_matches"))}, {", ".join(_STAT_COLS)}
    FROM orders LEFT JOIN counts ON counts.recording_id = o_orderkey LEFT JOIN flagged ON flagged.recording_id = o_orderkey LEFT JOIN stats ON stats.recording_id = o_orderkey)"""
_FRAME_RATIOS = _ratios("frame_tp", "frame_fp", "frame_fn").replace("AS precision", "AS frame_precision").replace("AS recall", "AS frame_recall").replace("AS f1", "AS frame_f1")
_RATES = ["precision", "recall", "f1", "frame_precision", "frame_recall", "frame_f1"]


def _evaluated(spark, sf_dir):
    """Rows by recording and pooled errors, of matches that are computed once."""
    rows = materialise(_aligned(spark, sf_dir))
    errors = matching.aligned_errors(rows)
    return matching.evaluation_rows(T.recordings(spark, sf_dir), matching.aligned_counts(rows), errors, T.frames(spark, sf_dir)), errors


@query(f"WITH RECURSIVE {_ROWS} SELECT recording_id, round(duration_s, 6) + 0.0 AS duration_s, n_gt, n_pred, tp, fp, fn, {_ratios('tp', 'fp', 'fn')}, frame_tp, frame_fp, frame_fn, frame_tn, {_FRAME_RATIOS}, n_matches, {', '.join(_STAT_COLS)} FROM rows_")
def evaluation_rows(spark, sf_dir):
    """Statistics are null where a recording has no match."""
    rows, _ = _evaluated(spark, sf_dir)
    return rounded(rows.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in _STAT_COLS}), "duration_s", *_RATES, *_STAT_COLS)


@query(f"WITH RECURSIVE {_ROWS}, t AS (SELECT {', '.join(f'sum({c})::BIGINT AS {c}' for c in ('n_gt', 'n_pred', 'tp', 'fp', 'fn', 'frame_tp', 'frame_fp', 'frame_fn', 'frame_tn'))}, sum(duration_s) / 60 AS m FROM rows_), e AS (SELECT count(*) AS n_matches, {_STATS} FROM errors) SELECT t.* EXCLUDE (m), {_ratios('tp', 'fp', 'fn')}, {_FRAME_RATIOS}, e.*, round(m, 3) AS minutes, round(fp / m, 4) AS fp_per_minute FROM t, e")
def evaluation_report(spark, sf_dir):
    report = matching.evaluation_report(*_evaluated(spark, sf_dir))
    return rounded(report, *_RATES, *_STAT_COLS).withColumn("minutes", F.round("minutes", 3)).withColumn("fp_per_minute", F.round("fp_per_minute", 4))


@query(f"WITH {FRAMES} SELECT round((count(*) - sum(label)) / sum(label), 6) AS pos_weight FROM frames")
def pos_weight(spark, sf_dir):
    return rounded(windows.pos_weight(T.frames(spark, sf_dir)), "pos_weight")


def _bce_sql(weight: float) -> str:
    return f"(1 - label) * logit + (1 + {weight - 1} * label) * (ln(1 + exp(-abs(logit))) + greatest(-logit, 0))"


@query(f"WITH {FRAMES} SELECT round(avg({_bce_sql(1.0)}), 6) AS loss FROM frames")
def loss_bce(spark, sf_dir):
    return rounded(windows.bce_loss(T.frames(spark, sf_dir)), "loss")


@query(f"WITH {FRAMES} SELECT round(avg({_bce_sql(3.0)}), 6) AS loss FROM frames")
def loss_bce_weighted(spark, sf_dir):
    return rounded(windows.bce_loss(T.frames(spark, sf_dir), pos_weight=3.0), "loss")


_P = f"{FRAMES}, p AS (SELECT *, 1 / (1 + exp(-logit)) AS p FROM frames)"


@query(f"WITH {_P} SELECT round(avg((0.25 * label + 0.75 * (1 - label)) * pow(1 - (p * label + (1 - p) * (1 - label)), 2) * ({_bce_sql(1.0)})), 6) AS loss FROM p")
def loss_focal(spark, sf_dir):
    return rounded(windows.focal_loss(T.frames(spark, sf_dir)), "loss")


@query(f"WITH {_P} SELECT round(1 - (2 * sum(p * label) + 1) / (sum(p) + sum(label) + 1), 6) AS loss FROM p")
def loss_dice(spark, sf_dir):
    return rounded(windows.dice_loss(T.frames(spark, sf_dir)), "loss")


@query(f"WITH {_P} SELECT round(1 - (sum(p * label) + 1) / (sum(p * label) + 0.3 * sum(p * (1 - label)) + 0.7 * sum((1 - p) * label) + 1), 6) AS loss FROM p")
def loss_tversky(spark, sf_dir):
    return rounded(windows.tversky_loss(T.frames(spark, sf_dir), 0.3, 0.7), "loss")


@query("""WITH s AS (SELECT c_custkey AS recording_id, (c_custkey % 7)::BIGINT AS n_windows, md5(c_custkey::VARCHAR) AS pos FROM customer WHERE c_custkey % 7 > 0),
  a AS (SELECT *, sum(n_windows) OVER () AS total, coalesce(sum(n_windows) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s), b AS (SELECT *, before < total * 0.7::DOUBLE AS train FROM a),
  c AS (SELECT *, coalesce(sum(CASE WHEN train THEN 0 ELSE n_windows END) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM b)
  SELECT recording_id, n_windows, CASE WHEN train THEN 'train' WHEN rest < total * 0.1::DOUBLE THEN 'val' ELSE 'test' END AS split FROM c""")
def split_by_windows(spark, sf_dir):
    r = T.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias(KEY), (F.col("c_custkey") % 7).alias("n_windows"), F.md5(F.col("c_custkey").cast("string")).alias("pos"))
    return windows.split_by_windows(r, 0.7, 0.1, "pos").select(KEY, "n_windows", "split")


@query("""WITH d AS (SELECT date_trunc('day', ts)::DATE AS epoch, round(avg(value), 6) AS metric FROM events GROUP BY 1),
  b AS (SELECT *, max(metric) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM d) SELECT epoch, metric FROM b WHERE best IS NULL OR metric > best""")
def best_epoch(spark, sf_dir):
    daily = T.read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("metric"))
    return windows.best_epochs(daily, "metric", "epoch")


_RAW = "SELECT l_orderkey AS recording_id, l_partkey::DOUBLE AS start_seconds, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_partkey + (l_quantity - 5) * 10 END AS stop_seconds FROM lineitem"


def _raw(spark, sf_dir):
    stop = F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_partkey") + (F.col("l_quantity") - 5) * 10)
    return T.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias(KEY), F.col("l_partkey").cast("double").alias("start_seconds"), stop.alias("stop_seconds"))


@query(f"WITH r AS ({_RAW}) SELECT recording_id, start_seconds, stop_seconds FROM r WHERE stop_seconds > start_seconds")
def annotations_clean(spark, sf_dir):
    return annotations.clean_annotations(_raw(spark, sf_dir))


@query(f"WITH r AS ({_RAW}) SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY start_seconds, stop_seconds) - 1 AS gi, round(start_seconds / 1000, 6) + 0.0 AS onset, round(stop_seconds / 1000, 6) + 0.0 AS offset FROM r WHERE stop_seconds > start_seconds")
def annotations_load(spark, sf_dir):
    return rounded(annotations.order_annotations(annotations.clean_annotations(_raw(spark, sf_dir)), KEY), "onset", "offset")


_SCAN = f"""r AS ({_RAW}), v AS (SELECT recording_id, count(*)::INT AS n_annotations FROM r WHERE stop_seconds > start_seconds GROUP BY 1),
  s AS (SELECT '/calls/' || o_orderkey AS recording_id, '/calls/' || o_orderkey || '.wav' AS audio_path, '/calls/' || o_orderkey || '_annotations.csv' AS annotation_path, o_totalprice / 10000 AS duration_s, n_annotations FROM orders JOIN v ON v.recording_id = o_orderkey)"""


def _scan(spark, sf_dir):
    """Orders as audio files, their lines as annotation files beside them."""
    name = lambda c, suffix: F.concat(F.lit("/calls/"), F.col(c).cast("string"), F.lit(suffix))
    audio = T.recordings(spark, sf_dir).select(name(KEY, ".wav").alias("audio_path"), "duration_s")
    rows = _raw(spark, sf_dir).select(name(KEY, "").alias(KEY), name(KEY, "_annotations.csv").alias("annotation_path"), "start_seconds", "stop_seconds")
    return annotations.scan_recordings(audio, rows)


@query(f"WITH {_SCAN} SELECT recording_id, audio_path, annotation_path, round(duration_s, 6) AS duration_s, n_annotations FROM s")
def scan_recordings(spark, sf_dir):
    return rounded(_scan(spark, sf_dir), "duration_s")


@query(f"WITH {_SCAN} SELECT count(*) AS n_recordings, round(sum(duration_s) / 3600, 4) AS hours, sum(n_annotations)::BIGINT AS n_annotations FROM s")
def scan_summary(spark, sf_dir):
    return _scan(spark, sf_dir).agg(F.count("*").alias("n_recordings"), F.round(F.sum("duration_s") / 3600, 4).alias("hours"), F.sum("n_annotations").alias("n_annotations"))


@query(f"WITH {_WINDOWS}, d AS (SELECT recording_id, s::INT AS start_frame, row_number() OVER (ORDER BY md5('7:' || recording_id || ':' || s), recording_id, s) - 1 AS place FROM starts) SELECT recording_id, start_frame, place // 32 AS batch FROM d WHERE place // 32 < (SELECT count(*) // 32 FROM d)")
def batched_windows(spark, sf_dir):
    return training.batched(windows.window_index(_sizes(spark, sf_dir), 25, 6), 32, seed=7, drop_last=True)


@query(f"WITH {_WINDOWS} SELECT recording_id, s::INT AS start_frame, (frame_idx - s)::INT AS place, value / 100 AS first, prob AS second, label FROM frames f JOIN starts USING (recording_id) WHERE frame_idx >= s AND frame_idx < s + 25")
def training_windows(spark, sf_dir):
    """Windows, spread out to a row for each of their frames."""
    frames = T.frames(spark, sf_dir).select(KEY, "frame_idx", F.array(F.col("value") / 100, F.col("prob")).alias("features"), "label")
    found = training.training_windows(frames, 25, 6)
    return found.select(KEY, "start_frame", F.posexplode(F.arrays_zip(F.col("features")[0].alias("first"), F.col("features")[1].alias("second"), F.col("labels").alias("label"))).alias("place", "x")).select(KEY, "start_frame", "place", "x.first", "x.second", "x.label")


@query(f"WITH {MERGED}, kept AS (SELECT recording_id, count(*) AS n FROM merged WHERE offset_ - onset >= 0.03::DOUBLE GROUP BY 1), spans AS (SELECT recording_id, max(time_s) - min(time_s) AS d FROM timed GROUP BY 1) SELECT count(*) AS n_recordings, coalesce(sum(n), 0)::BIGINT AS n_intervals, round(sum(d), 6) AS duration_s FROM spans LEFT JOIN kept USING (recording_id)")
def prediction_totals(spark, sf_dir):
    frames = T.frames(spark, sf_dir)
    return rounded(pipeline.prediction_totals(pipeline.as_predictions(frames, decode.hysteresis_decode(frames, RULE, [KEY]))), "duration_s")


QUERIES = Q
