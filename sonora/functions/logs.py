"""The library's log, on the driver, and what it runs on."""

from __future__ import annotations

import logging
import platform
from collections.abc import Iterator
from contextlib import contextmanager
from importlib import metadata

from pyspark.sql import SparkSession

from .checks import level_of

log = logging.getLogger("sonora")
FORMAT = "%(asctime)s %(levelname)s %(name)s: %(message)s"


def configure(level: bool | int | str | None = None, file: str | None = None, append: bool = True, file_level: bool | int | str | None = None) -> logging.Handler | None:
    """Sets the log's level and, with ``file``, writes it there, too; the file's handler is returned, for ``release``.

    Levels: names or numbers of the logging module, True for INFO, False for WARNING. A level of None stays as it is; a file
    without one of its own takes what the log lets through.
    """
    if level is not None:
        log.setLevel(level_of(level))
    if file is None:
        return None
    to_file = logging.FileHandler(file, mode="a" if append else "w", encoding="utf-8")
    to_file.setLevel(logging.NOTSET if file_level is None else level_of(file_level))
    to_file.setFormatter(logging.Formatter(FORMAT))
    log.addHandler(to_file)
    return to_file


def release(handler: logging.Handler) -> None:
    """Ends writing to a file."""
    log.removeHandler(handler)
    handler.close()


@contextmanager
def at_level(level: bool | int | str) -> Iterator[None]:
    """Another level within a block."""
    held = log.level
    log.setLevel(level_of(level))
    try:
        yield
    finally:
        log.setLevel(held)


def sys_info(spark: SparkSession | None = None, packages: tuple[str, ...] = ("pyspark", "pyarrow", "numpy", "pandas")) -> dict[str, str]:
    """Versions of what the library runs on by name; with a session also its Spark, Java, master and cores."""
    found = {"platform": platform.platform(), "python": platform.python_version()}
    for name in packages:
        try:
            found[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            found[name] = "not installed"
    if spark is not None:
        context = spark.sparkContext
        java = spark._jvm.java.lang.System.getProperty
        found |= {"spark": spark.version, "java": java("java.version"), "master": context.master, "parallelism": str(context.defaultParallelism)}
    return found
