"""Operator 2, secret scans: patterns plus a randomness test battery over encoded-looking tokens.

Every whole text is searched for the three fixed patterns (the base). Tokens of 20 and more characters of an inferred
encoding (hex, base 32, 36, 62 or 64, or letters alone; one letter at least) then face three tests, each giving the
probability that ordinary text would look as random: chi-squared uniformity over the encoding's alphabet, runs of
character classes, and lag-1 serial correlation. Fisher's method combines them. Which tokens count is decided over
the whole corpus by a weighted false-discovery procedure, weights growing with the square root of the length, since
a long token carries more evidence than a short one that happens upon the same probability.

Defined cases: a null text is empty and yields no span; an empty table no rows (and no threshold); repeated rows are
scanned each for themselves but all count as tests; other columns are not read, whatever their names. Very long
texts are scanned whole, in time linear in their length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialise, small_batches, text_or_empty

# The base patterns, their kinds in order, and the least lengths.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}
# '=' only ends a token, as padding: what follows it within a text (NAME=value) is a token by itself.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}(?:={1,6}(?![A-Za-z0-9+/_=-]))?")
# The same searches for a first look at a whole batch.
LOOK = {
    "assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": r"AKIA[A-Z0-9]",
    "hex": r"[0-9a-f]{16}",
    "random": r"[A-Za-z0-9+/_-]{20}",
}
# Alphabets from the narrowest, as encoders define them.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-",
}
#: How far ordinary text is from each test's ideal: chi-squared a character, class changes a character (where letters of
#: both cases or signs may change, and where only digits do), correlation.
TEXT_CHI, TEXT_RUNS, TEXT_SERIAL = 1.0, {"base62": 0.2, "base64": 0.2}, 0.5
DIGIT_RUNS = 0.08
#: The share of false discoveries to stay under, and the width of a bin of log10 probabilities.
FALSE_SHARE, BIN = 1e-3, 0.05

_SETS = {name: frozenset(a) for name, a in ALPHABETS.items()}
_CLASS = np.zeros(128, np.int8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 1, 2, 3
_INDEX = {name: np.array([a.find(chr(i)) for i in range(128)], np.int64) for name, a in ALPHABETS.items()}


def _below(z: float) -> float:
    return max(0.5 * math.erfc(-z / math.sqrt(2)), 1e-300)


def infer_encoding(token: str) -> str | None:
    """The narrowest alphabet that holds the token; None without letters."""
    chars = set(token.rstrip("="))
    if not any(c.isalpha() for c in chars):
        return None
    return next((name for name, a in _SETS.items() if chars <= a), None)


def battery(token: str, encoding: str) -> float:
    """log10 of the combined probability that ordinary text looks as random as this token."""
    codes = np.frombuffer(token.rstrip("=").encode("ascii"), np.uint8)
    at, n, k = _INDEX[encoding][codes], len(codes), len(ALPHABETS[encoding])
    chi = float(((np.bincount(at, minlength=k) - n / k) ** 2).sum() * k / n)
    far = n * TEXT_CHI * (k - 16) / 32 if k > 16 else n * TEXT_CHI / 4
    p_chi = _below((chi - (k - 1 + far)) / math.sqrt(2 * (k - 1 + 2 * far)))
    rate = TEXT_RUNS.get(encoding, DIGIT_RUNS)
    changes, expect = int((np.diff(_CLASS[codes]) != 0).sum()), rate * (n - 1)
    p_runs = _below((expect - changes) / math.sqrt(expect * (1 - rate)))
    x = at - at.mean()
    rho = abs(float((x[1:] * x[:-1]).sum() / max(float((x * x).sum()), 1e-12)))
    p_serial = _below((math.atanh(min(rho, 0.999)) - math.atanh(TEXT_SERIAL)) * math.sqrt(max(n - 3, 1)))
    half = -(math.log(p_chi) + math.log(p_runs) + math.log(p_serial))  # half of Fisher's statistic, six degrees of freedom
    return (math.log(1 + half + half * half / 2) - half) / math.log(10)


def scan(text: str, look: dict[str, bool]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, float]]]:
    """Base spans (start, kind's place, end) and candidate tokens (start, end, log10 of probability over weight)."""
    base = []
    if look["assign"]:
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if look["access"]:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if look["hex"]:
        base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    found, k, reach = [], 0, -1
    if look["random"]:
        for m in TOKEN.finditer(text):
            while k < len(base) and base[k][0] < m.end():
                reach = max(reach, base[k][2])
                k += 1
            if reach <= m.start() and (encoding := infer_encoding(m[0])):
                found.append((m.start(), m.end(), battery(m[0], encoding) - 0.5 * math.log10(len(m[0]) / 20)))
    return base, found


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, n = batch.column(1), len(batch)
        looks = {k: pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for k, p in LOOK.items()}
        base, found = [[] for _ in range(n)], [[] for _ in range(n)]
        for i in np.flatnonzero(np.logical_or.reduce(list(looks.values()))):
            b, f = scan(texts[i].as_py(), {k: v[i] for k, v in looks.items()})
            base[i] = [{"start": s, "kind": k, "end": e} for s, k, e in b]
            found[i] = [{"start": s, "end": e, "score": p} for s, e, p in f]
        span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
        token = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(token))], names=["doc_id", "base", "found"])


SCANNED = "doc_id long, base array<struct<start: long, kind: int, end: long>>, found array<struct<start: long, end: long, score: double>>"


def discovery_threshold(scanned: DataFrame, share: float = FALSE_SHARE) -> float:
    """The highest score (log10 of probability over weight) that still counts, by the weighted step-up procedure.

    A token's weight is the square root of its length over 20, scaled to a mean of one. The scores meet in a
    histogram of fixed width, so what reaches the driver is bounded whatever the corpus holds.
    """
    tokens = scanned.select(F.explode("found").alias("t")).select(F.col("t.score").alias("score"), F.sqrt((F.col("t.end") - F.col("t.start")) / 20).alias("w"))
    bins = sorted((r["bin"], r["n"], r["w"]) for r in tokens.groupBy(F.greatest(F.ceil(F.col("score") / BIN), F.lit(-6000)).alias("bin")).agg(F.count("*").alias("n"), F.sum("w").alias("w")).collect())
    m, scale = sum(n for _, n, _ in bins), math.log10(sum(w for *_, w in bins) / max(1, sum(n for _, n, _ in bins))) if bins else 0.0
    best, seen = -math.inf, 0
    for b, n, _ in bins:
        seen += n
        if m * 10 ** min(b * BIN + scale, 0.0) <= share * seen:
            best = b * BIN
    return best


def find_secrets(docs: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    """doc_id and ``spans``: an array of (start, kind, end, base) for each document, base patterns and discoveries."""
    scanned = materialise(small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_scan_batches, SCANNED))
    limit = discovery_threshold(scanned, share)
    added = F.transform(F.filter("found", lambda t: t["score"] <= F.lit(limit)), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return scanned.select("doc_id", "base", F.sort_array(F.concat("base", added)).alias("spans"))


def _joined(col: str):
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_digest(found: DataFrame) -> DataFrame:
    """The contract's columns, and how many spans there are in all."""
    count = [F.size(F.array_remove(F.transform("base", lambda s: (s["kind"] == k).cast("int")), 0)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return found.select("doc_id", *count, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
