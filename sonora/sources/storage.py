"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where it is unset, a session with a local master gets one of its own;
    any other is refused, as executors would not see it."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("sonora.shared.dir", None)
    if not conf:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="sonora-")
        spark.conf.set("sonora.shared.dir", conf)
    return conf.rstrip("/")


def _folder(spark: SparkSession) -> tuple[str, object, object]:
    """A new path in the shared folder, which goes when the application ends, and its file system."""
    path = f"{shared_dir(spark)}/sonora/{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    system.deleteOnExit(at)
    return path, at, system


def _stored(df: DataFrame) -> tuple[DataFrame, object, object]:
    """``df`` written and read back, and its folder with that one's file system. The folder goes when the application ends."""
    spark = df.sparkSession
    path, at, system = _folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), at, system


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives a lost executor.

    The files go when the application ends.
    """
    return _stored(df)[0]


def replayed(df: DataFrame, files_per_trigger: int) -> DataFrame:
    """``df`` written to the shared folder and read back as a stream, so many of its files in each micro-batch."""
    path = _folder(df.sparkSession)[0]
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drained(stream: DataFrame) -> DataFrame:
    """All that a stream gives for the input there is now, written to the shared folder by its micro-batches."""
    spark = stream.sparkSession
    path = _folder(spark)[0]
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """As ``materialise``, for tables that nothing reads any more when the block ends: then the files go."""
    table, at, system = _stored(df)
    try:
        yield table
    finally:
        system.delete(at, True)


@contextmanager
def paths_must_exist(paths: object) -> Iterator[None]:
    """What Spark says of a missing path becomes a FileNotFoundError."""
    try:
        yield
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no such file: {paths}") from None
        raise
