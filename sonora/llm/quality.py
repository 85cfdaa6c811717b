"""Operator 7, quality rules [native]: base rules, then a hashed n-gram log-likelihood ratio.

The ratio is between a multinomial over the hashed 1- and 2-grams of trusted documents (those labelled of quality)
and one over all documents, both smoothed. A document's score is the mean over its n-grams, so lengths compare. The
threshold is fixed by the trusted documents: their mean score less a number of their standard deviations, rounded
to six places; every document at or above it is kept unless a base rule failed. All of it is SQL functions; no
Python runs on the executors.

Bounds: both multinomials count all their documents and have ``buckets`` cells. Trusted ids meet the documents as
broadcast bitmaps of a checked size, or else in a join whose kind Spark chooses, so nothing of them is capped; counts and
scores are stored once without texts, and the threshold is taken from all stored scores of trusted documents.

Defined cases: a null or blank text has no words, fails the base rules and scores 0; without trusted documents all
scores are 0 and the base rules decide; an empty table gives no rows; repeated rows count as often as they come;
other columns are not read. A null doc_id is scored and never trusted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import materialise, text_or_empty

# Fixed values of the contract: what separates words, what counts as a symbol.
BLANK = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

BUCKETS, SMOOTH = 1 << 15, 1.0
#: Bitmaps of 4 kB that are broadcast at most: 64 MB.
MOST_MAPS = 1 << 14
#: Standard deviations below the trusted mean at which a document still is kept.
BELOW = 4.0


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often a lambda inside it looks the value up."""
    return F.transform(F.array(value), body)[0]


def words(col: str = "text") -> Column:
    """The words of a text in order."""
    return F.filter(F.split(text_or_empty(col), BLANK), lambda w: w != "")


def repeat_words(ws: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more.

    Windows are sorted with their places, equal neighbours marked, and the marked places' three words united: a
    sort instead of a look-up for each window, so a very long text stays near linear.
    """
    windows = F.transform(F.sequence(F.lit(1), F.size(ws) - 2), lambda i: F.struct(F.xxhash64(F.get(ws, i - 1), F.get(ws, i), F.get(ws, i + 1)).alias("h"), i.alias("i")))

    def marked(z: Column) -> Column:
        same = lambda a, k: F.coalesce(F.get(z, k)["h"] == a["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(F.transform(z, lambda a, k: F.struct(a["i"].alias("i"), ((k > 0) & same(a, k - 1) | same(a, k + 1)).alias("d"))), lambda a: a["d"]), lambda a: a["i"]))

    def united(p: Column) -> Column:
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last"))
        return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-2).alias("last")), step, lambda acc: acc["n"])

    spread = let(F.sort_array(windows), lambda z: united(marked(z)))
    hashes = F.transform(windows, lambda s: s["h"])
    return F.when(F.size(ws) < 4, 0).when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(spread).cast("long")


def grams(ws: Column, buckets: int) -> Column:
    """Buckets of all 1- and 2-grams."""
    one = F.transform(ws, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    two = F.transform(F.sequence(F.lit(1), F.size(ws) - 1), lambda i: F.pmod(F.xxhash64(F.get(ws, i - 1), F.get(ws, i)), F.lit(buckets)).cast("int"))
    return F.when(F.size(ws) > 1, F.concat(one, two)).otherwise(one)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled of quality, each once."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    return good.groupBy("doc_id").agg(F.lit(True).alias("trusted"))


def mark_trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``trusted``, true or null.

    The ids are packed into bitmaps of 32,768 neighbours each. As long as these are few, which is counted first, they
    are broadcast and no text is shuffled; otherwise ids and texts meet in a join whose kind Spark chooses.
    """
    ids = trusted_ids(labels)
    maps = materialise(ids.groupBy(F.bitmap_bucket_number("doc_id").alias("map")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc_id")).alias("bits")))
    if maps.count() > MOST_MAPS:
        return docs.join(ids, "doc_id", "left")
    at = F.bitmap_bit_position("doc_id")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("bit_get", byte, (at % 8).cast("int"))
    return docs.join(F.broadcast(maps), F.bitmap_bucket_number("doc_id") == F.col("map"), "left").select("doc_id", "text", F.when(bit == 1, True).alias("trusted"))


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """log(trusted probability / raw probability) of each bucket; zeros where nothing is trusted."""
    texts = mark_trusted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)
    counted = texts.select("trusted", words().alias("ws")).select("trusted", F.explode(let_words("ws", lambda ws: grams(ws, buckets))).alias("b"))
    rows = counted.groupBy("b").agg(F.count("*").alias("raw"), F.count("trusted").alias("good")).collect()
    raw, good = [SMOOTH] * buckets, [SMOOTH] * buckets
    for r in rows:
        raw[r["b"]] += r["raw"]
        good[r["b"]] += r["good"]
    n, m = sum(raw), sum(good)
    if m == SMOOTH * buckets:
        return [0.0] * buckets
    # The raw multinomial lends its shape to the trusted one's smoothing, so that a bucket unseen in the smaller sample is not overrated.
    mass = 0.01 * m
    return [round(math.log((g - SMOOTH + mass * r / n) / (m - SMOOTH * buckets + mass) / (r / n)), 6) for g, r in zip(good, raw)]


def let_words(col: str, body) -> Column:
    return let(F.col(col), body)


def score(ws: Column, ratios: list[float]) -> Column:
    """The mean log ratio over a document's n-grams. The ratios are one constant array of fixed size."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    total = F.aggregate(grams(ws, len(ratios)), F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    return F.when(F.size(ws) > 0, total / F.greatest(F.lit(1), 2 * F.size(ws) - 1)).otherwise(0.0)


def keep_limit(counted: DataFrame, labels: DataFrame, below: float = BELOW) -> float:
    """The least score kept: the mean over all trusted documents of enough words, less ``below`` standard deviations."""
    trusted = counted.filter(F.col("n_words") >= MIN_WORDS).select("doc_id", "score").join(trusted_ids(labels), "doc_id")
    stats = trusted.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).first()
    return -math.inf if stats["m"] is None else round(stats["m"] - below * stats["s"], 6)


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, below: float = BELOW) -> DataFrame:
    """One row per document: counts of the base rules, ``score``, ``base_failed`` and ``kept``."""
    ratios = log_ratios(docs, labels, buckets)
    text = text_or_empty()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_BLANK))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words().alias("ws"), (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    counted = split.select(
        "doc_id",
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        let_words("ws", repeat_words).alias("n_repeat_words"),
        let_words("ws", lambda ws: score(ws, ratios)).alias("score"),
    )
    counted = materialise(counted)
    limit = keep_limit(counted, labels, below)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.round("score", 6) >= F.lit(limit)))
