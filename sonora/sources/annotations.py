"""Annotation files and scans of recordings: CSV beside audio, times in milliseconds."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import paths_must_exist

REQUIRED = ("start_seconds", "stop_seconds")
SUFFIX = "_annotations.csv"
_ROWS = pa.schema([("annotation_path", pa.string()), ("start_seconds", pa.string()), ("stop_seconds", pa.string()), ("name", pa.string())])


def clean_annotations(raw: DataFrame) -> DataFrame:
    """Rows with both bounds and a positive length. A missing column is an error; NaN and text count as missing."""
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"annotations lack columns: {', '.join(missing)}")
    number = {c: F.nanvl(F.expr(f"try_cast({c} AS DOUBLE)"), F.lit(None).cast("double")) for c in REQUIRED}
    return raw.withColumns(number).dropna(subset=list(REQUIRED)).filter("stop_seconds > start_seconds")


def order_annotations(clean: DataFrame, key: str = "recording_id") -> DataFrame:
    """(key, gi, onset, offset) in seconds, by onset; despite their names the columns hold milliseconds."""
    gi = F.row_number().over(Window.partitionBy(key).orderBy(*REQUIRED)) - 1
    return clean.select(key, gi.cast("long").alias("gi"), (F.col("start_seconds") / 1000.0).alias("onset"), (F.col("stop_seconds") / 1000.0).alias("offset"))


def stem(path: Column) -> Column:
    """A path without its last suffix; names may hold other dots."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def plain_path(uri: Column) -> Column:
    """A file's URI as one readable path, so that all readers' paths compare: percent signs decoded, slashes behind the scheme set right."""
    decoded = F.url_decode(F.regexp_replace(uri, r"\+", "%2B"))
    return F.regexp_replace(F.regexp_replace(decoded, "^file:/+", "/"), "(?<!:)//+", "/")


def read_annotations(spark: SparkSession, paths: str | list[str], strict: bool = True) -> DataFrame:
    """(recording_id, annotation_path, start_seconds, stop_seconds, name) of all rows of annotation CSVs.

    Each file's columns go by its own header. A file without one of the required columns fails, or has no rows unless
    ``strict``. A recording's id is its path without the last suffix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = csv.DictReader(io.StringIO(text.removeprefix("\ufeff"), newline=""))
                missing = [c for c in REQUIRED if c not in (lines.fieldnames or ())]
                if missing and strict:
                    raise ValueError(f"{path} lacks columns: {', '.join(missing)}")
                rows = [] if missing else [{c: r.get(c) for c in ("start_seconds", "stop_seconds", "name")} | {"annotation_path": path} for r in lines]
                yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)

    with paths_must_exist(paths):
        texts = spark.read.text(paths, wholetext=True)
    files = texts.select(plain_path(F.col("_metadata.file_path")).alias("path"), "value")
    rows = files.mapInArrow(run, "annotation_path string, start_seconds string, stop_seconds string, name string")
    return rows.select(F.regexp_replace("annotation_path", SUFFIX.replace(".", r"\.") + "$", "").alias("recording_id"), "*")


def load_annotations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(recording_id, gi, onset, offset) in seconds of all valid rows of annotation CSVs."""
    return order_annotations(clean_annotations(read_annotations(spark, paths)))


def scan_recordings(audio: DataFrame, annotations: DataFrame) -> DataFrame:
    """(recording_id, audio_path, annotation_path, duration_s, n_annotations) of recordings that have audio and a valid annotation, by path parts.

    ``audio``: audio_path and duration_s, null where a file can't be read; a path that comes twice stays twice.
    ``annotations``: recording_id, annotation_path and the required columns, as ``read_annotations`` gives them.
    """
    counts = clean_annotations(annotations).groupBy("recording_id").agg(F.first("annotation_path").alias("annotation_path"), F.count("*").cast("int").alias("n_annotations"))
    named = audio.filter("duration_s is not null").withColumn("recording_id", stem(F.col("audio_path")))
    return named.join(counts, "recording_id").select("recording_id", "audio_path", "annotation_path", "duration_s", "n_annotations").orderBy(F.split("audio_path", "/"))
