"""Connected components of a distributed edge table, and a bounded filter of keys; used by the operators that link."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialise

#: 64-bit words of a key filter at most: 16 MB to broadcast, whatever the number of keys.
MOST_WORDS = 1 << 21


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of an edge in columns u and v (long); the root is the component's smallest node.

    Alternating large-star and small-star steps: each is a minimum by node, which combines before its shuffle, and
    one join, so a node of many neighbours is no burden. Each round is written to the shared folder.
    """
    now = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        now = materialise(large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct())
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def key_filter(keys: DataFrame, bits_per_key: int = 16) -> np.ndarray:
    """A Bloom filter of the one long column of ``keys``: words of 64 bits, three bits a key in one word.

    It only spares work: what passes it still meets an exact join. Beyond its size bound it passes more, never less.
    """
    col = F.col(keys.columns[0])
    n = keys.count()
    words = 1 << max(10, min(int(np.log2(MOST_WORDS)), int(n * bits_per_key // 64).bit_length()))
    name = keys.columns[0]
    bits = F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned({name}, {at}) & 63 AS INT))" for at in (40, 46, 52)))
    rows = keys.select(col.bitwiseAND(words - 1).cast("int").alias("w"), bits.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(words, np.uint64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return out


def passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit keys may be in the filter."""
    keys = keys.view(np.uint64)
    one, low = np.uint64(1), np.uint64(63)
    bits = one << (keys >> np.uint64(40) & low) | one << (keys >> np.uint64(46) & low) | one << (keys >> np.uint64(52) & low)
    return words[(keys & np.uint64(len(words) - 1)).astype(np.int64)] & bits == bits
