"""Operator 1, exact top-k search: M-trees with best-first search.

Vectors become integers, floor(scale * x). The largest inner product is the smallest distance once each candidate
has one more coordinate, sqrt(M - |v|^2) with M the largest squared norm, and each query a zero there: a metric, in
which candidates of each bucket (by a hash of the id) form a paged M-tree. A node keeps a pivot, a covering radius
and the distance to its parent's pivot; a leaf's entries keep their distances to its pivot. The search takes nodes by
their lower bounds, and the triangle inequality over the stored distances leaves out nodes and entries without
computing their distances. Bounds are in floating point with some slack; scores are exact integers: products of
doubles while these are exact, Python's integers beyond 2^53.

A tree of ``TREE_ROWS`` candidates is built once, in the task that its bucket was dealt to; the queries reach it in
blocks of fixed size behind it, one at a time, so queries move as often as there are trees and candidates move once. A
task with several trees carries each query's k-th best score on from tree to tree. A tree gives each query at most k
rows, and these meet in a top-k by query.

What the bounds spare depends on the data: on vectors in clusters most distances, on vectors without any structure in
many dimensions next to none (``MTree.computed`` counts them).

Defined cases: vectors that are null, or hold a null, NaN or infinite component take no part; shorter vectors, empty ones
too, count as filled up with zeros; a query's own vec_id is no candidate, in any of its rows; a query id that repeats is
answered once, by its least vector; ties go to the smaller vec_id (rows that repeat an id and a score fill ranks of
their own); scores beyond 64 bits rank by their value and are returned as the nearest 64-bit integer; an empty table
gives no rows; other columns are not read. Finite components of any size take part, as long as their square is finite.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import materialise

SCALE, K, EVERY = 1024, 10, 100
LEAF, FAN, TREE_ROWS, BLOCK = 256, 12, 8192, 256
#: Queries whose k-th best score a task carries on, at most.
CARRIED = 100_000


class Node:
    """A page: its pivot, covering radius and distance to the parent's pivot, and children or entries."""

    __slots__ = ("pivot", "radius", "to_parent", "children", "pivots", "child_to_parent", "child_radius", "entries", "entry_to_pivot")

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, pivot: np.ndarray, to_pivot: np.ndarray, to_parent: float, rng: np.random.RandomState) -> None:
        self.pivot, self.radius, self.to_parent = pivot, float(to_pivot.max(initial=0.0)), to_parent
        self.children: list[Node] = []
        self.entries = self.entry_to_pivot = None
        if len(rows) <= LEAF or self.radius == 0.0:
            order = np.argsort(to_pivot, kind="stable")
            self.entries, self.entry_to_pivot = rows[order], to_pivot[order]
            return
        seeds = rows[rng.choice(len(rows), FAN, replace=False)]
        d = np.sqrt(np.maximum(((vectors[rows] ** 2).sum(1)[:, None] - 2 * vectors[rows] @ vectors[seeds].T + (vectors[seeds] ** 2).sum(1)), 0))
        near = d.argmin(1)
        if (near == near[0]).all():  # copies of one vector about: halve by distance instead
            near = (np.arange(len(rows)) >= len(rows) // 2).astype(int)
        for j in np.unique(near):
            mine = near == j
            p = vectors[seeds[j]]
            self.children.append(Node(rows[mine], vectors, p, np.sqrt(((vectors[rows[mine]] - p) ** 2).sum(1)), float(np.sqrt(((p - pivot) ** 2).sum())), rng))
        self.pivots = np.stack([c.pivot for c in self.children])
        self.child_to_parent = np.array([c.to_parent for c in self.children])
        self.child_radius = np.array([c.radius for c in self.children])


class MTree:
    """An M-tree over integer vectors (as doubles) lifted onto a sphere, searched for the largest inner products.

    ``most``: at least the largest squared norm of all candidates.
    """

    def __init__(self, ids: np.ndarray, values: np.ndarray, most: float) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.values, self.most = ids[order], values[order].astype(float), float(most)
        # Sums of products of integers are exact in doubles as long as no norm exceeds 2^53.
        self.exact = None if self.most < 1 << 53 else np.array([[int(x) for x in row] for row in self.values], object).reshape(self.values.shape)
        self.vectors = np.column_stack([self.values, np.sqrt(np.maximum(self.most - (self.values**2).sum(1), 0))])
        pivot = self.vectors.mean(0) if len(ids) else np.zeros(values.shape[1] + 1)
        self.root = Node(np.arange(len(ids)), self.vectors, pivot, np.sqrt(((self.vectors - pivot) ** 2).sum(1)), 0.0, np.random.RandomState(len(ids)))
        self.computed = 0

    def search(self, own: int, query: np.ndarray, k: int, floor: float = -np.inf) -> list[tuple[int, int]]:
        """The k best (score, vec_id) of candidates other than ``own``: highest scores, then smallest ids.

        Candidates below ``floor`` may be left out.
        """
        q = np.append(query.astype(float), 0.0)
        whole = None if self.exact is None or not len(self.ids) else np.array([int(x) for x in query], object)
        if whole is None and float(np.abs(q).max(initial=0.0)) ** 2 * len(q) >= 1 << 53:
            whole = np.array([int(x) for x in query], object)
        both = float((q**2).sum()) + self.most
        slack = 1e-9 * both + 1e-6
        best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst first
        reach = np.inf if floor == -np.inf else np.sqrt(max(both - 2 * floor, 0.0) + slack)  # no candidate farther than this can enter

        def distance(p: np.ndarray) -> np.ndarray:
            self.computed += len(p)
            return np.sqrt(((p - q) ** 2).sum(1))

        def scored(rows: np.ndarray) -> np.ndarray:
            if whole is None:
                return self.values[rows] @ q[:-1]
            part = self.exact[rows] if self.exact is not None else self.values[rows].astype(np.int64).astype(object)
            return part @ whole

        heap = [(0.0, 0, self.root, float(distance(self.root.pivot[None])[0]))]
        tick = 1
        while heap:
            bound, _, node, d = heapq.heappop(heap)
            if bound > reach:
                break
            if node.entries is not None:
                near = np.abs(d - node.entry_to_pivot) <= reach
                rows = node.entries[near]
                if not len(rows):
                    continue
                self.computed += len(rows)
                scores = scored(rows)
                if len(best) >= k:
                    take = scores >= best[0][0]
                    rows, scores = rows[take], scores[take]
                for s, v in zip(scores.tolist(), self.ids[rows].tolist()):
                    if v != own:
                        if len(best) < k:
                            heapq.heappush(best, (s, -v))
                        elif (s, -v) > best[0]:
                            heapq.heapreplace(best, (s, -v))
                if len(best) >= k:
                    reach = min(reach, np.sqrt(max(both - 2 * float(best[0][0]), 0.0) + slack))
                continue
            may = np.flatnonzero(np.abs(d - node.child_to_parent) - node.child_radius <= reach)
            if not len(may):
                continue
            for j, dj in zip(may.tolist(), distance(node.pivots[may]).tolist()):
                low = max(bound, dj - node.children[j].radius - slack)
                if low <= reach:
                    heapq.heappush(heap, (low, tick, node.children[j], dj))
                    tick += 1
        return sorted(((int(s), -v) for s, v in best), key=lambda x: (-x[0], x[1]))


def quantised(col: str, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, as doubles; null where the vector takes no part."""
    doubles = F.transform(col, lambda x: x.cast("double"))
    good = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # From 2^53 on, doubles are whole.
    whole = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(F.when(F.abs(x) < 2.0**53, x).otherwise(0.0)).cast("double")).otherwise(x)
    return F.when(F.coalesce(good, F.lit(False)), F.transform(doubles, lambda x: whole(x * scale)))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists.to_pylist()):
        out[i, : len(x)] = x
    return out


def _packed(df: DataFrame, group: Column, width: int) -> DataFrame:
    """Rows of (id, v) as one binary of 64-bit ids and one of doubles per group."""

    def pack(key, table):
        table = table.sort_by([("id", "ascending")])
        ids, body = table["id"].to_numpy(), _matrix(table["v"].combine_chunks(), width)
        return pa.table({"g": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "body": pa.array([body.astype("<f8").tobytes()], pa.binary())})

    return df.withColumn("g", group).groupBy("g").applyInArrow(pack, "g int, ids binary, body binary")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score: the k largest inner products for each vector whose id divides by ``every``."""
    ints = materialise(vectors.select(F.col("vec_id").cast("long").alias("id"), quantised("embedding", scale).alias("v")).filter("id is not null and v is not null"))
    shape = ints.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("most"), F.count(F.when(F.col("id") % every == 0, 1)).alias("queries")).first()
    n, width, most = shape["n"], shape["width"] or 0, (shape["most"] or 0.0) * (1 + 1e-9)
    trees, blocks = max(1, -(-n // TREE_ROWS)), max(1, -(-shape["queries"] // BLOCK))
    spread = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    tree = _packed(ints, F.pmod(F.xxhash64("id", "v"), F.lit(trees)).cast("int"), width).select(F.col("g").alias("tree"), F.lit(-1).alias("block"), "ids", "body")
    query = _packed(ints.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")), spread(blocks), width)
    query = query.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.col("g").alias("block"), "ids", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: MTree | None = None
        floors: dict[int, float] = {}
        for batch in batches:
            for i in range(len(batch)):
                ids, body = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in (("ids", "<i8"), ("body", "<f8")))
                body = body.reshape(-1, width)
                if batch.column("block")[i].as_py() < 0:
                    built = MTree(ids, body, most)
                    continue
                out = []
                for own, q in zip(ids.tolist(), body):
                    found = built.search(own, q, k, floors.get(own, -np.inf)) if built else []
                    if len(found) == k and (own in floors or len(floors) < CARRIED):
                        floors[own] = max(floors.get(own, -np.inf), float(found[-1][0]))
                    out += [(own, v, min(max(s, -(1 << 63)), (1 << 63) - 1), str(s)) for s, v in found]
                if out:
                    yield pa.RecordBatch.from_arrays([*(pa.array([x[j] for x in out], pa.int64()) for j in range(3)), pa.array([x[3] for x in out])], names=["query_id", "vec_id", "score", "whole"])

    # A tree comes before the queries that follow it: blocks count from 0.
    dealt = tree.unionByName(query).repartition(trees, "tree").sortWithinPartitions("tree", "block")
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long, whole string")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.col("whole").cast("double")), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.v) * len(c.v) > 0 THEN list_inner_product(q.v, c.v) ELSE 0 END::BIGINT AS score FROM v q, v c WHERE q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
