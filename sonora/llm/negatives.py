"""Operator 13, hard-negative mining: bit-sliced integer products.

Vectors become integers, floor(scale * x). An anchor's positives are the rows of its own label with the highest inner
products; for each positive, the best rows of other labels whose score lies between ``low`` and ``high`` per cent of the
positive's score are its hard negatives.

Both searches take block by block of candidates. A block's components are cut into bit-planes (two's complement), and
products with the planes come most significant first. After each, what the planes below can still add lies between the
sums of the anchor's negative and of its positive components, times the largest number those planes can state: an interval
for each pair, half as wide with each plane. A pair goes as soon as its interval cannot qualify: below the k-th best lower
end, or outside the band of every positive, or below the k-th best lower end of those surely within it. While many pairs
are left a plane is one matrix product; of few pairs, each is gathered. What survives all planes has its exact score.

Candidates of a search are dealt into blocks of at most ``BLOCK`` rows: by label and a hash of the row for positives (so a
label with a third of all rows is many blocks), by a hash alone for negatives. A block's candidates come first in its
partition, its anchors stream past them an Arrow batch at a time, and each anchor leaves at most k rows a block, whose top
k is then taken by anchor: by struct-ordered slices, never a whole list. Anchors move once for each block they must meet,
(anchors x candidates / ``BLOCK``) rows; a candidate moves once a search. Nothing is collected or broadcast.

Defined cases: rows whose label or vector is null, or whose vector holds a null, NaN or infinite component, take no part,
nor do those without an id; empty vectors score 0; shorter vectors count as filled up with zeros; "other rows" leaves out
every row of the anchor's own id among positives; an id that repeats as an anchor is answered once, by its least (label,
vector); candidates that repeat an id fill ranks of their own; components of any finite size take part: beyond exact doubles,
products are of Python's integers, and scores are held to 64 bits where they leave a block, so a positive whose score
needs more has no negatives; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import materialise
from .mtree import quantised

SCALE, EVERY, MOVED = 256, 50, 7
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Candidates of a block, and of it and its anchors those that one matrix of pairs holds.
BLOCK, ROWS, QUERIES = 1 << 16, 4096, 128
#: Below this share of pairs left, these are gathered one by one.
FEW = 1 / 32
Judge = Callable[[np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray], Callable[[np.ndarray, int], np.ndarray]], np.ndarray]


class Planes:
    """Integer vectors as packed bit-planes, most significant first; the first counts negatively."""

    def __init__(self, values: np.ndarray, kind: type) -> None:
        self.kind, self.width = kind, values.shape[1]
        whole = _integers(values, object) if kind is object else values.astype(np.int64)
        most = max((int(x) for x in (whole.max(initial=0), -1 - whole.min(initial=0))), default=0)
        self.bits = most.bit_length() + 1
        self.packed = [np.packbits(((whole >> j) & 1).astype(np.uint8), axis=1) for j in reversed(range(self.bits))]
        #: Of each plane its factor, and the largest number that the planes below it can state.
        self.weights = [((-1 if j == self.bits - 1 else 1) << j, (1 << j) - 1) for j in reversed(range(self.bits))]

    def rows(self, plane: int, lo: int, hi: int) -> np.ndarray:
        return np.unpackbits(self.packed[plane][lo:hi], axis=1, count=self.width).astype(self.kind)


def kth_largest(rows: np.ndarray, values: np.ndarray, n: int, k: int) -> np.ndarray:
    """For each of ``n`` rows the k-th largest of its values, minus infinity where it has fewer."""
    at = first_of(rows, values, np.zeros(len(rows)), k)
    begins = np.searchsorted(rows[at], np.arange(n + 1))
    out = np.full(n, -np.inf, values.dtype)
    has = np.flatnonzero(np.diff(begins) == k)
    out[has] = values[at[begins[has] + k - 1]]
    return out


def first_of(rows: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's first k by score, ties by smaller id; row by row."""
    if score.dtype == object:
        order = np.array(sorted(range(len(rows)), key=lambda i: (rows[i], -score[i], ids[i])), np.int64)
    else:
        order = np.lexsort((ids, -score, rows))
    sorted_rows = rows[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_rows, sorted_rows) < k]


def surviving(planes: Planes, lo: int, hi: int, anchors: np.ndarray, may: np.ndarray, judge: Judge) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(anchor, candidate, exact score) of the pairs that ``judge`` leaves, and how many pairs met a plane in all.

    ``may``: which pairs take part. ``judge(low, high, of, kth)`` says which intervals may yet qualify; ``of`` spreads a
    value of each anchor over its pairs, ``kth(mask, k)`` is the k-th largest low end of each anchor's pairs in the mask.
    """
    up, down = np.maximum(anchors, 0).sum(1), np.minimum(anchors, 0).sum(1)
    n, alive, done = len(anchors), may.copy(), 0
    score = np.zeros(may.shape, anchors.dtype)
    a = c = None
    for i, (factor, below) in enumerate(planes.weights):
        part = planes.rows(i, lo, hi)
        if a is None:
            done += np.count_nonzero(alive)
            score += (anchors @ part.T) * factor
            low, high = score + (down * below)[:, None], score + (up * below)[:, None]

            def kth(mask: np.ndarray, k: int, low=low) -> np.ndarray:
                held = np.where(mask & alive, low, -np.inf)
                return np.partition(held, -k, axis=1)[:, -k] if held.shape[1] >= k else np.full(n, -np.inf, low.dtype)

            alive &= judge(low, high, lambda x: x[:, None], kth)
            if np.count_nonzero(alive) < FEW * alive.size or i == planes.bits - 1:
                a, c = np.nonzero(alive)
                score = score[a, c]
            continue
        done += len(a)
        for k in range(0, len(a), 1 << 16):
            at = slice(k, k + (1 << 16))
            score[at] += (anchors[a[at]] * part[c[at]]).sum(1) * factor
        low, high = score + down[a] * below, score + up[a] * below
        left = judge(low, high, lambda x, a=a: x[a], lambda mask, k, a=a, low=low: kth_largest(a[mask], low[mask], n, k))
        a, c, score = a[left], c[left], score[left]
    return a, c, score, done


def best_positives(planes: Planes, ids: np.ndarray, labels: np.ndarray, own: np.ndarray, own_label: np.ndarray, anchors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, candidate, score): each anchor's k best of a block's candidates that have its label."""
    kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, anchors.dtype))
    for lo in range(0, len(ids), ROWS):
        hi = min(len(ids), lo + ROWS)
        floor = kth_largest(kept[0], kept[2], len(own), k)

        def judge(low, high, of, kth, floor=floor):
            return high >= of(np.maximum(floor, kth(np.ones(low.shape, bool), k)))

        a, c, score, _ = surviving(planes, lo, hi, anchors, (ids[None, lo:hi] != own[:, None]) & (labels[None, lo:hi] == own_label[:, None]), judge)
        both = [np.concatenate(x) for x in zip(kept, (a, c + lo, score))]
        at = first_of(both[0], both[2], ids[both[1]], k)
        kept = tuple(x[at] for x in both)
    return kept


def best_negatives(planes: Planes, ids: np.ndarray, labels: np.ndarray, own_label: np.ndarray, anchors: np.ndarray, bands: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, band, candidate, score): for each anchor and band the k best of a block's candidates of other labels.

    ``bands``: for each band its lowest and highest score by anchor; an empty one has its lowest above its highest.
    """
    n, m = len(own_label), len(bands)
    kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, anchors.dtype))  # anchor * m + band
    for lo in range(0, len(ids), ROWS):
        hi = min(len(ids), lo + ROWS)
        floor = kth_largest(kept[0], kept[2], n * m, k)

        def judge(low, high, of, kth, floor=floor):
            left = np.zeros(low.shape, bool)
            for j, (least, most) in enumerate(bands):
                reach = high >= of(np.maximum(least, floor[j::m]))
                reach &= low <= of(most)
                sure = (low >= of(least)) & (high <= of(most))
                if sure.any():
                    reach &= high >= of(kth(sure, k))
                left |= reach
            return left

        a, c, score, _ = surviving(planes, lo, hi, anchors, labels[None, lo:hi] != own_label[:, None], judge)
        for j, (least, most) in enumerate(bands):
            good = (score >= least[a]) & (score <= most[a])
            kept = tuple(np.concatenate(x) for x in zip(kept, (a[good] * m + j, c[good] + lo, score[good])))
        at = first_of(kept[0], kept[2], ids[kept[1]], k)
        kept = tuple(x[at] for x in kept)
    return kept[0] // m, kept[0] % m, kept[1], kept[2]


def _integers(values: np.ndarray, kind: type) -> np.ndarray:
    """Whole doubles in the kind of number that products are exact in."""
    return np.array([[int(x) for x in row] for row in values.tolist()], object).reshape(values.shape) if kind is object else values.astype(kind)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows, filled up with zeros."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width)[None] < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _long(score: np.ndarray) -> pa.Array:
    return pa.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in score.tolist()], pa.int64())


def _search(rows: DataFrame, width: int, kind: type, schema: str, answer: Callable[[Planes, dict[str, np.ndarray], pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Runs ``answer(planes, candidates, anchors)`` for each block's candidates and some of its anchors at a time.

    ``rows`` are dealt and sorted: block by block, candidates before anchors. Their columns: block, anchor (whether it is
    one), id, label, v, and what else ``answer`` reads of anchors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, ready = None, [], None
        for batch in batches:
            blocks, flags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "anchor"))
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (flags[1:] != flags[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(batch)]):
                if hi == lo:
                    continue
                part = batch.slice(lo, hi - lo)
                if blocks[lo] != block:
                    block, held, ready = blocks[lo], [], None
                if not flags[lo]:
                    held.append(part.select(["id", "label", "v"]))
                    continue
                if held:
                    mine, held = pa.Table.from_batches(held).combine_chunks(), []
                    ready = (Planes(_vectors(mine["v"].chunk(0), width), kind), {c: mine[c].to_numpy() for c in ("id", "label")})
                if ready:
                    yield from (answer(*ready, part.slice(k, QUERIES)) for k in range(0, len(part), QUERIES))

    return rows.sortWithinPartitions("block", "anchor").mapInArrow(run, schema)


def _first(found: DataFrame, keys: list[str], k: int, score: str, id_: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(score), id_)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, every: int = EVERY, scale: int = SCALE, label: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose vec_id divides by ``every``. ``label``: an expression to use in place of the column of that name.
    Each anchor and positive has up to ``negatives`` rows, with low * positive_score <= 100 * negative_score <= high *
    positive_score; highest scores first, ties by smaller vec_id.
    """
    if not (positives > 0 and negatives > 0 and every > 0):
        raise ValueError("positives, negatives and every must be positive")
    v = quantised("embedding", scale)
    named = vectors.select(F.col("vec_id").cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"), v.alias("v"))
    ints = materialise(named.filter("id is not null and label is not null and v is not null"))
    shape = ints.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))).alias("most")).first()
    n, width, most = shape["n"], max(1, shape["width"] or 0), shape["most"] or 0.0
    # No sum of products on the way reaches this; it decides in which numbers they are exact.
    reach = width * (most + 1) * 4 * (most + 1)
    kind = np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else object
    if most < 1 << 31:
        ints = ints.withColumn("v", F.col("v").cast("array<int>"))
    anchors = ints.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "v")).alias("b")).select("id", "b.label", "b.v")
    row, cores = F.xxhash64("id", "v"), ints.sparkSession.sparkContext.defaultParallelism
    columns = ["block", "anchor", "id", "label", "v"]

    # Positives: blocks of one label each; anchors meet those of theirs.
    sizes = ints.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("subs"))
    own = ints.join(sizes, "label").withColumn("sub", F.pmod(row, "subs")).withColumn("anchor", F.lit(False))
    asked = anchors.join(sizes, "label").withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1))).withColumn("anchor", F.lit(True))
    # Blocks whose hashes agree are searched together; labels are compared all the same.
    both = own.unionByName(asked).withColumn("block", F.xxhash64("label", "sub")).select(columns)

    def near(planes: Planes, mine: dict[str, np.ndarray], batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("id").to_numpy()
        a, c, score = best_positives(planes, mine["id"], mine["label"], ids, batch.column("label").to_numpy(), _integers(_vectors(batch.column("v"), width), kind), positives)
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(mine["id"][c]), _long(score)], names=["anchor_id", "positive_id", "positive_score"])

    tasks = max(cores, int(ints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = _search(both.repartition(tasks, "block"), width, kind, "anchor_id long, positive_id long, positive_score long", near)
    # At most ``positives`` of each anchor are left before they are listed.
    bands = _first(found, ["anchor_id"], positives, "positive_score", "positive_id").groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("bands"))

    # Negatives: blocks of any rows; anchors meet them all, with the scores of their positives.
    blocks = max(-(-n // BLOCK), min(2 * cores, -(-n // ROWS)), 1)
    asked = anchors.join(bands, "id").withColumn("anchor", F.lit(True)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    own = ints.withColumn("anchor", F.lit(False)).withColumn("block", F.pmod(row, F.lit(blocks)).cast("int"))
    both = own.select(columns).unionByName(asked.select(*columns, "bands"), allowMissingColumns=True)

    def hard(planes: Planes, mine: dict[str, np.ndarray], batch: pa.RecordBatch) -> pa.RecordBatch:
        given = batch.column("bands").to_pylist()
        edges = []
        for j in range(positives):
            p = [g[j]["positive_score"] if j < len(g) else None for g in given]
            edges.append(tuple(np.array([f(x) if x is not None else none for x in p], kind) for f, none in ((lambda x: -(-low * x // 100), 1), (lambda x: high * x // 100, 0))))
        a, j, c, score = best_negatives(planes, mine["id"], mine["label"], batch.column("label").to_numpy(), _integers(_vectors(batch.column("v"), width), kind), edges, negatives)
        of = [given[x][y] for x, y in zip(a.tolist(), j.tolist())]
        ids = batch.column("id").to_numpy()
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[a]), *(pa.array([o[f] for o in of], pa.int64()) for f in ("rank", "positive_id", "positive_score")), pa.array(mine["id"][c]), _long(score)],
            names=["anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"],
        )

    found = _search(both.repartitionById(blocks, "block"), width, kind, "anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long", hard)
    return _first(found, ["anchor_id", "place"], negatives, "negative_score", "negative_id").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def moved_label(every: int = MOVED) -> Column:
    """The contract's labels: of rows whose vec_id divides by ``every``, the next of ten."""
    return F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


NEGATIVES_ORACLE = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % {MOVED} = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM v a, v c WHERE a.vec_id % {EVERY} = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= {NEGATIVES}
"""
