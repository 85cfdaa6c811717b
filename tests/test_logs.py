"""The log, its levels and files; checks of arguments; what the library runs on."""

import logging
from pathlib import Path

import numpy as np
import pytest

from sonora.functions import checks, logs
from sonora.plans import components as C


def test_files_and_levels(tmp_path):
    before = logs.log.level
    path = tmp_path / "log.txt"
    path.write_text("old\n")
    handler = logs.configure("info", str(path), append=False, file_level="INFO")
    try:
        C.LoggingCallback().on_epoch_end(1, {"train_loss": 0.5, "val_f1": 0.25}, None)
        logs.log.debug("not this")
        with logs.at_level(False):
            logs.log.info("nor this")
        logs.log.info("this")
    finally:
        logs.release(handler)
        logs.log.setLevel(before)
    logs.log.warning("nor this, after the release")
    first, second = path.read_text().splitlines()
    assert "Epoch 001" in first and "0.5000" in first and "0.2500" in first and "old" not in first
    assert second.endswith("INFO sonora: this")


def test_a_level_alone_and_a_file_alone(tmp_path):
    before = logs.log.level
    try:
        assert logs.configure(True) is None and logs.log.level == logging.INFO
        handler = logs.configure(file=str(tmp_path / "a.txt"))
        logs.log.info("kept")
        logs.release(handler)
        assert logs.log.level == logging.INFO and "kept" in (tmp_path / "a.txt").read_text()
    finally:
        logs.log.setLevel(before)


@pytest.mark.parametrize("given, level", [(None, 30), (True, 20), (False, 30), (np.True_, 20), ("debug", 10), ("WARNING", 30), (7, 7), (np.int64(40), 40)])
def test_levels(given, level):
    assert checks.level_of(given) == level


@pytest.mark.parametrize("given, error", [(0, ValueError), (-1, ValueError), ("loud", ValueError), (1.5, TypeError), ([], TypeError)])
def test_no_levels(given, error):
    with pytest.raises(error):
        checks.level_of(given)


def test_numbers():
    assert checks.whole(np.int32(3)) == 3 and type(checks.whole(np.int32(3))) is int and checks.number(np.float32(0.5)) == 0.5 and checks.number(2) == 2.0
    for bad in (True, np.True_, 1.0, "1", None):
        with pytest.raises(TypeError, match="width"):
            checks.whole(bad, "width")
    for bad in (True, np.False_, "1", None, 1j):
        with pytest.raises(TypeError):
            checks.number(bad)
    with pytest.raises(ValueError, match="width must be 1 at least"):
        checks.whole(0, "width", 1)


def test_types_and_values(tmp_path):
    assert checks.instance(1, (int, str)) == 1 and checks.one_of("a", ("a", "b")) == "a"
    with pytest.raises(TypeError, match="int or str"):
        checks.instance(1.0, (int, str))
    with pytest.raises(ValueError, match="'a', 'b'"):
        checks.one_of("c", ("a", "b"))
    assert checks.local_path(Path("x")) == "x" and checks.local_path(tmp_path, exists=True) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        checks.local_path(tmp_path / "none", exists=True)
    with pytest.raises(TypeError):
        checks.local_path(3)


def test_what_it_runs_on(spark):
    alone, whole = logs.sys_info(packages=("numpy", "surely-not-there")), logs.sys_info(spark)
    assert alone["numpy"] == np.__version__ and alone["surely-not-there"] == "not installed" and "spark" not in alone
    assert whole["spark"] == spark.version and whole["master"].startswith("local") and whole["java"]
