"""From audio to intervals and to an evaluation: what a user calls with a trained model."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonora.operators import matching, windows
from sonora.sources.annotations import clean_annotations, order_annotations, stem
from sonora.sources.audio import load_chunks
from sonora.sources.storage import materialise

from .components import KEY, Decoder, Detector, Extractor, Matcher

_INTERVALS = "array<struct<onset:double,offset:double>>"


def infer(audio: DataFrame, trained: Detector, extractor: Extractor, decoder: Decoder, hop_frames: int | None = None, features: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Frames (recording_id, frame_idx, time_s, prob) and intervals (recording_id, onset, offset) of ``audio`` (recording_id, samples).

    ``features``: the extractor's frames where they are at hand, as from ``store.stored_features``; then no audio is read.
    """
    frames = materialise(extractor.extract(audio)) if features is None else features
    probs = trained.predict(frames, hop_frames)
    scored = materialise(frames.select(KEY, "frame_idx", "time_s").join(probs, [KEY, "frame_idx"]))
    return scored, decoder.decode(scored)


def as_predictions(frames: DataFrame, found: DataFrame) -> DataFrame:
    """(recording_id, intervals in order, duration_s from the first to the last frame, 0 for one frame) of each recording that has frames."""
    lasts = frames.groupBy(KEY).agg((F.max("time_s").cast("double") - F.min("time_s").cast("double")).alias("duration_s"))
    lists = found.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("onset", "offset"))).alias("intervals"))
    return lasts.join(lists, KEY, "left").select(KEY, F.coalesce("intervals", F.array().cast(_INTERVALS)).alias("intervals"), "duration_s")


def predict(audio: DataFrame, trained: Detector, extractor: Extractor, decoder: Decoder, hop_frames: int | None = None) -> DataFrame:
    """The predictions of each row of ``audio`` (recording_id, samples)."""
    return as_predictions(*infer(audio, trained, extractor, decoder, hop_frames))


def recordings(audio: DataFrame) -> DataFrame:
    """What ``load_chunks`` or ``load_audio`` give, with each recording's id."""
    return audio.withColumn(KEY, stem(F.col("audio_path")))


def predict_recordings(spark: SparkSession, trained: Detector, extractor: Extractor, audio_paths: list[str], decoder: Decoder, hop_frames: int | None = None) -> DataFrame:
    """(position, audio_path, intervals, duration_s), a row for each of ``audio_paths`` in their order; a path may come twice."""
    schema = f"position int, audio_path string, intervals {_INTERVALS}, duration_s double"
    if not audio_paths:
        return spark.createDataFrame([], schema)
    asked = [(i, re.sub("/+", "/", re.sub("^file:/+", "/", str(p)))) for i, p in enumerate(audio_paths)]
    audio = recordings(load_chunks(spark, list({own: str(p) for (_, own), p in zip(asked, audio_paths)}.values()), extractor.sample_rate, halo=extractor.halo))
    found = predict(audio, trained, extractor, decoder, hop_frames)
    listed = spark.createDataFrame(asked, "position int, audio_path string").withColumn(KEY, stem(F.col("audio_path")))
    return listed.join(found, KEY).select("position", "audio_path", "intervals", "duration_s").orderBy("position")


def prediction_totals(predictions: DataFrame) -> DataFrame:
    """Recordings, intervals and seconds of all predictions."""
    return predictions.agg(F.count("*").alias("n_recordings"), F.coalesce(F.sum(F.size("intervals")), F.lit(0)).cast("long").alias("n_intervals"), F.coalesce(F.sum("duration_s"), F.lit(0.0)).alias("duration_s"))


@dataclass(frozen=True)
class Evaluation:
    """A row per recording, a row over all, and the intervals that both are about."""

    rows: DataFrame
    report: DataFrame
    annotated: DataFrame
    predicted: DataFrame
    matches: DataFrame


def evaluate(audio: DataFrame, annotations: DataFrame, trained: Detector, extractor: Extractor, decoder: Decoder, matcher: Matcher, hop_frames: int | None = None, boundary_tolerance_ms: float | None = None, features: DataFrame | None = None) -> Evaluation:
    """``audio`` (recording_id, samples, duration_s; whole or by chunks) against ``annotations`` as ``read_annotations`` gives them.

    With ``features`` (see ``infer``), ``audio`` needs no samples.

    Recordings without audio don't count; those without annotations do, with none.
    """
    if audio.isEmpty():
        raise ValueError("there are no recordings to evaluate")
    frames, found = infer(audio, trained, extractor, decoder, hop_frames, features)
    known = (audio.filter("chunk = 0 and channel = 0") if "chunk" in audio.columns else audio).select(KEY, "duration_s")
    gt = materialise(order_annotations(clean_annotations(annotations)).join(known.select(KEY).distinct(), KEY, "left_semi"))
    order = Window.partitionBy(KEY).orderBy("onset", "offset")
    pred = materialise(found.withColumn("pi", (F.row_number().over(order) - 1).cast("long")))
    matches = materialise(matcher.match(gt, pred))
    errors = matching.boundary_errors(gt, pred, matches, boundary_tolerance_ms)
    rows = matching.evaluation_rows(known, matching.event_counts(gt, pred, matches), errors, windows.frame_labels(frames, gt))
    return Evaluation(rows, matching.evaluation_report(rows, errors), gt, pred, matches)
