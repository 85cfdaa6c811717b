"""Operator 12, periodic run detection: an all-lag vectorised scan.

A run is a stretch of words with smallest period q, at least ``min_exp`` periods and ``least`` words long, that cannot be
extended at either end with that period. Words become whole numbers, and for each lag q up to a ``min_exp``-th of the words
the array is compared with itself shifted by q. A stretch of L places where both agree is L + q words of period q; the
stretches long enough are the candidates. What has a smaller period, too, was found at that lag with the same ends (a
stretch of two periods and more has one smallest period, which divides the others), so the smallest lag of equal ends is
the run's period.

Texts of up to ``LONG`` characters are scanned where they are read, those of an Arrow batch end to end and together: no
word is the same number in two texts, and longer texts come first, so each lag's texts are a prefix of the array. Longer
texts are dealt out: their words become numbers once, and ranges of lags, each of about ``UNIT`` comparisons, go to any
machine, with the array (4 bytes a word). Their candidates meet by text and ends, their runs by text. Only these texts are
shuffled. All lags of a text cost the square of its words, an eighth of it here.

Defined cases: a null text or one without words has no runs and collapses to an empty text; rows that repeat are answered
each; all words equal are one run of period 1; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import WORD, materialise

MIN_EXP, LEAST = 4, 6
#: Characters of a text that is scanned where it is read, at most.
LONG = 1 << 17
#: Comparisons of a range of lags, and characters of the texts that are scanned together.
UNIT, TOGETHER = 1 << 30, 1 << 22
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN_SQL = "struct<start:bigint,length:bigint,period:bigint>"


def word_numbers(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, end to end, no number in two texts; and the texts' bounds."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(w) for w in texts], out=at[1:])
    coded = pa.array([w for words in texts for w in words], pa.large_string()).dictionary_encode()
    kinds = max(1, len(coded.dictionary))
    numbers = coded.indices.to_numpy()
    kind = np.int32 if kinds * len(texts) < 1 << 31 else np.int64
    return numbers.astype(kind) + np.repeat(np.arange(len(texts)).astype(kind) * kind(kinds), np.diff(at)), at


def stretches(numbers: np.ndarray, at: np.ndarray, first: int, last: int, min_exp: int = MIN_EXP, least: int = LEAST) -> np.ndarray:
    """(text, start, length, lag) of every stretch that is long enough for its lag, for the lags ``first`` to ``last``.

    Texts come longest first, and no number lies in two of them.
    """
    size = np.diff(at)
    out = []
    for q in range(first, min(last, int(size.max(initial=0)) // min_exp) + 1):
        end = at[np.searchsorted(-size, -max(least, min_exp * q), side="right")]
        same = np.flatnonzero(numbers[q:end] == numbers[: end - q]) if end > q else ()
        need = max(least, min_exp * q) - q
        if len(same) < need or not (same[need - 1 :] - same[: len(same) - need + 1] == need - 1).any():
            continue
        edge = np.flatnonzero(np.diff(same) != 1)
        begin, stop = same[np.append(0, edge + 1)], same[np.append(edge, len(same) - 1)] + 1
        good = stop - begin >= need
        begin, length = begin[good], (stop - begin)[good] + q
        text = np.searchsorted(at, begin, side="right") - 1
        out.append(np.stack([text, begin - at[text], length, np.full(len(begin), q)], 1))
    return np.concatenate(out) if out else np.zeros((0, 4), np.int64)


def shortest(found: np.ndarray) -> np.ndarray:
    """Of stretches of the same text and ends the one of the smallest lag, by text, start and lag."""
    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
    new = np.append(True, (found[1:, :3] != found[:-1, :3]).any(1))[: len(found)]
    found = found[new]
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def collapsed(words: list[str], runs: np.ndarray) -> str:
    """The words outside all runs and in the first period of those that hold them, joined by single spaces."""
    if not len(runs):
        return " ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return " ".join(w for w, inside in zip(words, np.cumsum(change).tolist()) if not inside)


def _answer(keys: pa.Array, texts: list[list[str]], runs: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    bounds = np.cumsum([0, *map(len, runs)])
    flat = np.concatenate([np.zeros((0, 3), np.int64), *runs])
    listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(RUN)))
    return pa.RecordBatch.from_arrays([keys, pa.array([len(w) for w in texts], pa.int64()), listed, pa.array([collapsed(w, r) for w, r in zip(texts, runs)], pa.string())], names=names)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_exp: int = MIN_EXP, least: int = LEAST) -> DataFrame:
    """(key, n_words, runs, collapsed): each text's runs as structs of start, length and period, by start and period, and the
    text without the repeats."""
    if min_exp < 2 or least < 2:
        raise ValueError("a run needs two periods and two words at least")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = [key, "n_words", "runs", "collapsed"]
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words long, runs array<{RUN_SQL}>, collapsed string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            part = np.cumsum([len(t) for t in texts]) // TOGETHER
            for lo, hi in zip(begins := np.flatnonzero(np.append(True, np.diff(part))[: len(part)]), [*begins[1:], len(texts)]):
                some = [WORD.findall(t) for t in texts[lo:hi]]
                order = sorted(range(len(some)), key=lambda i: -len(some[i]))
                numbers, at = word_numbers([some[i] for i in order])
                found = shortest(stretches(numbers, at, 1, len(numbers), min_exp, least))
                cuts = np.searchsorted(found[:, 0], np.arange(len(some) + 1))
                runs: list[np.ndarray] = [found[:0, 1:]] * len(some)
                for k, i in enumerate(order):
                    runs[i] = found[cuts[k] : cuts[k + 1], 1:]
                yield _answer(batch.column(0).slice(lo, hi - lo), some, runs, names)

    here = rows.filter(F.length("text") <= LONG).mapInArrow(scan, schema)
    return here.unionByName(_long_runs(rows.filter(F.length("text") > LONG), schema, names, min_exp, least))


def _long_runs(rows: DataFrame, schema: str, names: list[str], min_exp: int, least: int) -> DataFrame:
    """The same for texts each of which is dealt out by ranges of lags."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                numbers, _ = word_numbers([WORD.findall(batch.column("text")[i].as_py())])
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns), pa.array([len(numbers)], pa.int64()), pa.array([numbers.astype("<i4").tobytes()], pa.binary())], names=[*batch.schema.names, "n", "numbers"])

    kind = rows.schema["key"].dataType.simpleString()
    stored = materialise(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(number, f"key {kind}, text string, row long, n long, numbers binary"))
    lags = F.floor(F.col("n") / min_exp)
    step = F.greatest(F.lit(1), F.floor(F.lit(UNIT) / F.col("n")))
    units = stored.filter(lags > 0).select("row", "n", "numbers", F.explode(F.sequence(F.lit(1).cast("long"), lags, step.cast("long"))).alias("first"), step.alias("step"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, first, step, numbers in zip(*(batch.column(c).to_pylist() for c in ("row", "n", "first", "step")), batch.column("numbers")):
                found = shortest(stretches(np.frombuffer(numbers.as_buffer(), "<i4"), np.array([0, n]), first, first + step - 1, min_exp, least))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row)), *(pa.array(found[:, k]) for k in (1, 2, 3))], names=["row", "start", "length", "period"])

    # An Arrow batch ends at 64 MB, so a task holds few arrays at a time.
    found = units.repartition("row", "first").mapInArrow(scan, "row long, start long, length long, period long")
    runs = found.groupBy("row", "start", "length").agg(F.min("period").alias("period")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                at = np.array([(r["start"], r["length"], r["period"]) for r in batch.column("runs")[i].as_py() or []], np.int64).reshape(-1, 3)
                yield _answer(batch.column("key").slice(i, 1), [WORD.findall(batch.column("text")[i].as_py())], [at], names)

    return stored.select("row", "key", "text").join(runs, "row", "left").mapInArrow(finish, schema)


def with_periods(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` as the contract has them: in texts whose id's crc32 divides by ten, words from a place on repeat.

    Words of such a text are joined by single spaces; all else stays. Texts of null ids stay, too.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))

    @F.arrow_udf("string")
    def repeated(texts: pa.Array, sums: pa.Array) -> pa.Array:
        out = []
        for text, g in zip(texts.to_pylist(), sums.to_pylist()):
            words = WORD.findall(text or "")
            if words:
                a = g % len(words)
                p = 1 + (len(words) - a) // (3 + g % 8)
                words[a:] = [words[a + i % p] for i in range(len(words) - a)]
            out.append(" ".join(words) if words else text)
        return pa.array(out, pa.string())

    mine = h % 10 == 0
    return docs.withColumn(text, F.when(mine, repeated(F.when(mine, F.col(text)), F.floor(h / 10))).otherwise(F.col(text)))


def run_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent, and digests of all runs and of the collapsed text."""
    more = lambda x, y: F.when(x["length"] * y["period"] != y["length"] * x["period"], x["length"] * y["period"] > y["length"] * x["period"]).otherwise(F.struct(x["start"], x["period"]) < F.struct(y["start"], y["period"]))
    best = F.aggregate("runs", F.lit(None).cast(RUN_SQL), lambda b, x: F.when(b.isNull() | more(x, b), x).otherwise(b))
    text = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    text = F.when(F.size("runs") > 0, F.concat(text, F.lit("\n"))).otherwise("")
    sha: Column = F.sha2(F.col("collapsed").cast("binary"), 256)
    told = found.withColumn("best", best)
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"), sha.alias("collapsed_sha256"), "n_words",
    )
