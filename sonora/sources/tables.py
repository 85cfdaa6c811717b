"""Views of the driver's tables in the shape of recordings, frames and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOP_S = 0.008


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in order are a recording's frames."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(
        F.col("user_id").alias("recording_id"), idx.alias("frame_idx"), (idx * F.lit(HOP_S)).alias("time_s"), "value", F.least(F.col("value") / 100, F.lit(1.0)).alias("prob"),
        F.col("event_type").isin("purchase", "signup").cast("double").alias("label"), F.col("event_type").isin("purchase", "signup").cast("double").alias("target"), ((F.col("value") - 50) / 25).alias("logit"),
    )


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines are a recording's annotated intervals."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    gi = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    on = (F.col("l_partkey") % 50).cast("double")
    return li.select(F.col("l_orderkey").alias("recording_id"), gi.cast("long").alias("gi"), on.alias("onset"), (on + F.col("l_quantity")).alias("offset"))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated intervals, some left out, all moved by exact binary fractions so that ties are real."""
    g, r, i = annotated(spark, sf_dir), F.col("recording_id"), F.col("gi")
    kept = g.filter((i + r) % 5 != 0)
    return kept.select("recording_id", i.alias("pi"), (F.col("onset") + ((i * 7 + r) % 9 - 4) * 0.5).alias("onset"), (F.col("offset") + ((i * 5 + r) % 11) * 0.5 + 4).alias("offset"))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("recording_id"), (F.col("o_totalprice") / 10000).alias("duration_s"))


def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("recording_id"), F.col("embedding").cast("array<double>").alias("samples"))
