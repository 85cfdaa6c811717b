"""Checks of what callers pass: each returns the value in the form that the library uses, or raises."""

from __future__ import annotations

import logging
import operator
import os
from collections.abc import Collection
from numbers import Real

import numpy as np


def whole(value: object, name: str = "value", least: int | None = None) -> int:
    """A whole number of any type that counts as an index; booleans aren't numbers."""
    if isinstance(value, (bool, np.bool_)) or not hasattr(value, "__index__"):
        raise TypeError(f"{name} must be a whole number, not {type(value).__name__}")
    n = operator.index(value)
    if least is not None and n < least:
        raise ValueError(f"{name} must be {least} at least, not {n}")
    return n


def number(value: object, name: str = "value") -> float:
    """A real number, whole or not; booleans aren't numbers."""
    if isinstance(value, (bool, np.bool_)) or not isinstance(value, Real):
        raise TypeError(f"{name} must be a number, not {type(value).__name__}")
    return float(value)


def instance[T](value: T, kinds: type | tuple[type, ...], name: str = "value") -> T:
    if not isinstance(value, kinds):
        names = " or ".join(k.__name__ for k in (kinds if isinstance(kinds, tuple) else (kinds,)))
        raise TypeError(f"{name} must be of type {names}, not {type(value).__name__}")
    return value


def one_of[T](value: T, allowed: Collection[T], name: str = "value") -> T:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(map(repr, allowed))}, not {value!r}")
    return value


def local_path(value: object, name: str = "path", exists: bool = False) -> str:
    """A path of the driver's own file system."""
    if not isinstance(value, (str, os.PathLike)):
        raise TypeError(f"{name} must be a path, not {type(value).__name__}")
    path = os.fspath(value)
    if exists and not os.path.exists(path):
        raise FileNotFoundError(f"{name} does not exist: {path}")
    return path


def level_of(verbose: bool | int | str | None) -> int:
    """A level of the logging module: its name in any case or its number; True is INFO, False and None are WARNING."""
    if verbose is None or isinstance(verbose, (bool, np.bool_)):
        return logging.INFO if verbose else logging.WARNING
    if isinstance(verbose, str):
        return logging.getLevelNamesMapping()[one_of(verbose.upper(), logging.getLevelNamesMapping(), "level")]
    return whole(verbose, "level", 1)
