"""Scans along an order: rows are dealt by ranges of keys and order, folded range by range, and what passes a range's edge
is settled from a row or two of each range. No task needs all rows of a key, and keys of any size make ranges alike.

A range begins within its first key and ends within its last one; all other keys lie in it whole. So what a range must
learn from those before it concerns its first key alone, and is one value: the fold of that key's rows in earlier ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonora.sources.storage import materialise


#: Rows of a range of a stored table, about.
ROWS = 1 << 18


def ranged(df: DataFrame, keys: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` dealt by ranges of keys and order, sorted within each; so many ranges, where a number is given."""
    return df.repartitionByRange(*([ranges] if ranges else []), *keys, *order).sortWithinPartitions(*keys, *order)


def ranges_of(stored: DataFrame) -> int | None:
    """How many ranges a stored table's rows make, so that a task's rows are bounded: left alone, Spark makes ranges of so
    many compressed bytes, and narrow rows that repeat take many times that in memory. None for a small table."""
    n = -(-stored.count() // ROWS)
    return n if n > 8 else None


def changes(columns: list[pa.Array], n: int) -> np.ndarray:
    """Where any of the columns differs from the row before; nulls are alike. The first row counts as different."""
    out = np.zeros(n, bool)
    out[:1] = True
    for c in columns:
        a, b = c.slice(1), c.slice(0, max(0, n - 1))
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        out[1:] |= np.asarray(other.to_numpy(zero_copy_only=False) if isinstance(other, pa.Array) else other.to_numpy(), bool)
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 15) -> Iterator[pa.Table]:
    """Tables of whole groups, of about ``rows`` rows or one larger group, of batches that are sorted by their keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            last = int(np.flatnonzero(changes([table[k].chunk(0) for k in keys], len(table)))[-1])
            if last:
                yield table.slice(0, last).combine_chunks()
            held = table.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _running(kind: str, value: np.ndarray, good: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The fold of each row's group up to and with it, within one batch; NaN (or 0) while there is nothing to fold."""
    n = len(value)
    group = np.cumsum(new) - 1
    begin = np.flatnonzero(new)[group] if n else new
    if kind == "sum":
        total = np.cumsum(np.where(good, value, 0))
        return total - np.where(begin > 0, total[begin - 1], 0)
    if kind == "max":
        held = np.where(good, value, -np.inf)
        order = np.argsort(held, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        top = held[order[np.maximum.accumulate(rank + group * n) - group * n]]
        return np.where(top == -np.inf, np.nan, top)
    at = np.maximum.accumulate(np.where(good, np.arange(n), -1))
    return np.where(at >= begin, value[at], np.nan)


def _join(kind: str, earlier: float | int | None, later: np.ndarray) -> np.ndarray:
    if earlier is None or earlier != earlier:
        return later
    if kind == "sum":
        return later + earlier
    return np.where(np.isnan(later), earlier, later) if kind == "last" else np.fmax(later, earlier)


def before(df: DataFrame, keys: list[str], order: list[str], name: str, value: Column, kind: str = "sum", ranges: int | None = None) -> DataFrame:
    """Adds ``name``: the sum (of whole numbers), ``max`` or ``last`` value of ``value`` over the rows before each row within
    its keys; null before the first. Null values are passed over; NaN must not occur.

    The result is stored, as the ranges' edges are read from it: at most two rows of each range go to the driver.
    """
    if kind not in ("sum", "max", "last"):
        raise ValueError("a scan folds by sum, max or last")
    sql, dtype = ("long", np.int64) if kind == "sum" else ("double", np.float64)
    given, names = df.withColumn("_value", value.cast(sql)), df.columns
    flat = lambda x: x.to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last_key, total, any_, lead, held = None, None, False, True, None
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            columns = [batch.column(k) for k in keys]
            new = changes(columns, n)
            first_key = [c[0].as_py() for c in columns]
            joined = last_key is not None and first_key == last_key
            x = batch.column("_value")
            good = flat(x.is_valid())
            own = _running(kind, np.where(good, np.nan_to_num(flat(pc.fill_null(x, 0))), 0).astype(dtype), good, new)
            seen = np.cumsum(new) == 1  # rows of the batch's first key
            if joined:
                own = np.where(seen, _join(kind, total, own), own)
            lead_rows = seen & (lead if last_key is None or joined else False)
            # What lies before a row: the fold up to the row before it, unless that is of another key.
            shifted = np.concatenate([np.array([total if joined and any_ else 0], dtype), own[:-1].astype(dtype)])
            empty = new.copy()
            empty[0] = not (joined and any_)
            if kind != "sum":
                empty |= np.isnan(shifted)
            lead = bool(lead_rows[-1])
            last_key, total, any_ = [c[-1].as_py() for c in columns], own[-1], True
            edge = np.zeros(n, np.int8)
            if held is None:
                edge[0] |= 1
            else:
                yield held
            held = pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(shifted, mask=empty), pa.array(own, mask=np.isnan(own) if kind != "sum" else None), pa.array(lead_rows), pa.array(edge), pa.array(np.full(n, part, np.int32))],
                names=[*names, "_own", "_with", "_lead", "_edge", "_part"],
            )
        if held is not None:
            edge = held.column("_edge").to_numpy(zero_copy_only=False).copy()
            edge[-1] |= 2
            yield held.set_column(held.schema.get_field_index("_edge"), "_edge", pa.array(edge))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    cut = materialise(ranged(given, keys, order, ranges).mapInArrow(run, f"{fields}, _own {sql}, _with {sql}, _lead boolean, _edge byte, _part int"))
    carried = _carries(kind, cut.filter("_edge > 0").select(*keys, "_with", "_lead", "_edge", "_part").orderBy("_part", "_edge").collect(), keys)
    type_ = df.select(value.alias("v")).schema["v"].dataType
    out = F.col("_own")
    if carried:
        rows = df.sparkSession.createDataFrame(carried, f"_part int, _carry {sql}")
        cut = cut.join(F.broadcast(rows), "_part", "left")  # a row for each range at most
        carry = F.when(F.col("_lead"), F.col("_carry"))
        both = {"sum": F.coalesce(out + carry, out, carry), "max": F.greatest(out, carry), "last": F.coalesce(out, carry)}
        out = both[kind]
    return cut.select(*(F.col(f"`{c}`") for c in names if c != name), (out if kind == "sum" else out.cast(type_)).alias(name))


def _carries(kind: str, edges: list, keys: list[str]) -> list[tuple[int, float | int]]:
    """(range, fold of its first key's rows in earlier ranges), for ranges where there are such rows. ``edges``: a range's
    first and last row, the fold within the range at the last one."""
    parts: dict[int, dict[str, object]] = {}
    for r in edges:
        at = parts.setdefault(r["_part"], {})
        if r["_edge"] & 1:
            at["first"] = [r[k] for k in keys]
        if r["_edge"] & 2:
            at.update(last=[r[k] for k in keys], total=r["_with"], whole=r["_lead"])
    out, key, fold = [], None, None
    for part in sorted(parts):
        at = parts[part]
        mine = fold if key is not None and at["first"] == key else None
        if mine is not None:
            out.append((part, mine))
        total = at["total"]
        if at["whole"] and mine is not None:
            total = mine if total is None else {"sum": lambda: mine + total, "max": lambda: max(mine, total), "last": lambda: total}[kind]()
        key, fold = at["last"], total
    return out


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: each row's place from 0 within its keys."""
    return before(df, keys, order, name, F.lit(1)).withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("long")))
