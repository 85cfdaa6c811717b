"""Features that are extracted once: a table of frames beside a table of the files that they are of.

A folder holds ``frames``, a partition for each time that features were added, and ``files``, which says of each file by its
path, length and time of change, and by the extractor's settings, which of these has its frames. A row of ``files`` is written
after the frames, so what a lost job leaves behind is never read. A file that changed is extracted anew.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonora.sources.annotations import stem
from sonora.sources.audio import audio_headers, listed, load_chunks
from sonora.sources.storage import materialise

from .components import KEY, Extractor

_FILES = "path string, length long, modified timestamp, settings string, run string"
_FILE = ["path", "length", "modified"]


def settings_key(extractor: Extractor) -> str:
    """What tells an extractor's features from others': its name and settings."""
    return hashlib.sha256(json.dumps([type(extractor).__name__, asdict(extractor)], sort_keys=True).encode()).hexdigest()


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the folder, empty before the first run."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def stored_features(spark: SparkSession, paths: str | list[str], extractor: Extractor, folder: str) -> DataFrame:
    """(recording_id, frame_idx, time_s, features) of the files, of which only those that ``folder`` lacks are extracted."""
    files, own = materialise(listed(spark, paths)), settings_key(extractor)
    known = _read(spark, f"{folder}/files", _FILES).filter(F.col("settings") == own)
    new = materialise(files.join(known, _FILE, "left_anti"))
    if not new.isEmpty():
        run = uuid.uuid4().hex
        sound = load_chunks(spark, new, extractor.sample_rate, halo=extractor.halo).withColumn(KEY, stem(F.col("audio_path")))
        extractor.extract(sound).select(KEY, "frame_idx", "time_s", "features").write.parquet(f"{folder}/frames/run={run}")
        new.select(*_FILE, F.lit(own).alias("settings"), F.lit(run).alias("run")).write.mode("append").parquet(f"{folder}/files")
        known = _read(spark, f"{folder}/files", _FILES).filter(F.col("settings") == own)
    # Should two sessions have added a file at once, one of them counts.
    chosen = known.join(files, _FILE, "left_semi").groupBy("path").agg(F.min("run").alias("run")).select(stem(F.col("path")).alias(KEY), "run")
    frames = _read(spark, f"{folder}/frames", f"{KEY} string, frame_idx int, time_s float, features array<double>, run string")
    return frames.join(chosen, [KEY, "run"], "left_semi").select(KEY, "frame_idx", "time_s", "features")


def durations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(recording_id, duration_s) of the files, from their headers: what an evaluation needs besides stored features."""
    return audio_headers(spark, paths).filter("duration_s is not null").select(stem(F.col("audio_path")).alias(KEY), "duration_s")
