"""Operator 6, suffix-array dedup: every byte covered by a string of ``length`` bytes that also starts elsewhere goes.

Sorting the suffixes of all positions would move the corpus many times over, so only some are sorted. Each window of
200 bytes names one suffix, the one whose first bytes hash lowest among those with 100 bytes of it left; equal windows
name suffixes that begin with equal 100 bytes (the key), as far from their own beginnings. A suffix owns the windows
that name it, a run of them; the bytes that these cover are its region, of 300 bytes at most. Then, for all keys alike:

- a key that occurs once settles its windows as unique (counted with partial aggregation);
- a region that occurs twice or more, as bytes about a key, settles its windows as repeats (counted likewise);
- one suffix of each different region of a key is sorted: sampled splitters range-partition them by leading bytes,
  each bucket is sorted by multikey quicksort (eight bytes at a time, to the right of the key and to the left), and
  neighbours' common lengths give the repeats. Splitters never part equal keys, so no two suffixes to compare lie
  across a boundary; a group that an Arrow batch cuts is carried on to the next.

A key with more than ``GROUP`` different regions would need more memory than a task has, whatever the splitters: its
regions are cut into parts of ten windows, then into single windows, and these are counted as the keys were.

Matches never cross documents: a region ends where its document does. Hashes of strings have 64 bits.

Defined cases: a null text is empty; texts under 200 bytes lose nothing and are nobody's source; repeated rows are
sources of each other, so both lose what they share (all, from 200 bytes on); an empty table gives no rows; null and
repeated doc_ids are told apart by their texts; other columns are not read. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_bytes, materialise, mix, prefix_sums, range_hash, small_batches, text_or_empty
from .graph import key_filter, passes

LENGTH, KEY = 200, 100
#: Different regions of one key that a bucket sorts at most (some 30 MB), and bytes of text worked on at once.
GROUP, CHUNK = 100_000, 1 << 18
#: Sorted suffixes that are compared at a time, at least.
ROWS = 8192
WIDTH = LENGTH - KEY + 1
_TOP = np.uint64((1 << 64) - 1)


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The minimum (or maximum) of each run of ``width`` values."""
    f, fill = (np.minimum, _TOP) if least else (np.maximum, np.uint64(0))
    padded = np.full(-(-len(x) // width) * width, fill, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead, back = f.accumulate(rows, axis=1).ravel(), f.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return f(back[:n], ahead[width - 1 : width - 1 + n])


def sampled(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places in the buffer of the sampled suffixes, the rows they lie in, and where their regions begin and end.

    ``at``: where each row begins, and the end.
    """
    n = len(buf)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 4
    eight = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(buf), 0, (1,))
    with np.errstate(over="ignore"):
        h = (eight * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32) << np.uint64(32) | np.arange(n - 7, dtype=np.uint64)
    h = h[: n - KEY + 1]
    least = _sliding(h, WIDTH, True)
    inside = np.zeros(len(least), bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= LENGTH:
            inside[a : b - LENGTH + 1] = True
    # The low half of each window's minimum is the place that it names; windows that name the same come in runs.
    window = np.flatnonzero(inside)
    named = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(named, prepend=-1))
    last = np.append(first[1:], len(named)) - 1
    places = named[first]
    return places, np.searchsorted(at, places, "right") - 1, window[first], window[last] + LENGTH


def regions(batch_ids: np.ndarray, texts: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """Per chunk of text: buffer, row ids, places, region starts and ends, row starts, keys and region hashes."""
    buf, at = arrow_bytes(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1)
        part, ends = np.ascontiguousarray(buf[at[lo] : at[hi]]), at[lo : hi + 1] - at[lo]
        p, row, start, end = sampled(part, ends)
        if len(p):
            sums = prefix_sums(part)
            with np.errstate(over="ignore"):
                whole = mix(range_hash(sums, start, end) + (p - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield part, batch_ids[lo:hi][row], p, start, end, ends[row], range_hash(sums, p, p + KEY), whole
        lo = hi


#: Regions that a task remembers; beyond it, equal ones are sorted once more, to the same end.
SEEN = 1_000_000
_STATS = "key long, region long"
_SHARED = "key long, region long, row long, start long, width int"
_ROWS = "key long, region long, row long, start long, width int, left int, lead long, body binary"
_FIELDS = [("key", pa.int64()), ("region", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("width", pa.int32()), ("left", pa.int32()), ("lead", pa.int64()), ("body", pa.binary())]


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for *_, key, whole in regions(batch.column(0).to_numpy(), batch.column(1)):
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(whole.view(np.int64))], names=["key", "region"])


def _states(stats: DataFrame) -> DataFrame:
    """Keys that occur twice or more, and whether their regions are all equal."""
    return stats.groupBy("key").agg(F.count("*").alias("n"), F.min("region").alias("a"), F.max("region").alias("b")).filter("n > 1").select("key", F.expr("a = b").alias("same"))


def _shared(known: object) -> Callable:
    """Suffixes whose key may occur twice or more, without their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, p, start, end, first, key, whole in regions(batch.column(0).to_numpy(), batch.column(1)):
                i = np.flatnonzero(passes(known.value, key))
                if len(i):
                    columns = [key[i].view(np.int64), whole[i].view(np.int64), ids[i], start[i] - first[i], (end - start)[i].astype(np.int32)]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["key", "region", "row", "start", "width"])

    return run


def _bodies(differing: object) -> Callable:
    """Suffixes whose key may have different regions, with their bytes: each region once a task, as equal ones are settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for buf, ids, p, start, end, first, key, whole in regions(batch.column(0).to_numpy(), batch.column(1)):
                i = np.flatnonzero(passes(differing.value, key))
                i = i[np.sort(np.unique(whole[i], return_index=True)[1])]
                names = whole[i].tolist()
                i = i[[x not in seen for x in names]]
                if len(seen) < SEEN:
                    seen.update(names)
                if len(i):
                    raw = buf.tobytes()
                    body = pa.array([raw[a:b] for a, b in zip(start[i].tolist(), end[i].tolist())], pa.binary())
                    lead = np.ndarray((len(buf) - 7,), ">u8", buf, 0, (1,))[p[i]].astype(np.uint64).view(np.int64)
                    columns = [key[i].view(np.int64), whole[i].view(np.int64), ids[i], start[i] - first[i], (end - start)[i].astype(np.int32), (p - start)[i].astype(np.int32), lead]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), body], schema=pa.schema(_FIELDS))

    return run


def multikey_sort(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (group, words) and each row's common words with the row before it in its group (-1: none).

    ``words``: a matrix of 8-byte words, the first leading. Multikey quicksort: rows are parted by one word, and
    only rows that still share all words so far with another go on to the next.
    """
    n, k = words.shape
    order = np.argsort(group, kind="stable")
    common = np.where(np.concatenate([[False], np.diff(group[order]) == 0]), k, -1) if n else np.zeros(0, np.int64)
    live = np.arange(n)
    for j in range(k):
        # Runs that still agree, as numbered by their beginnings.
        tied = common[live] > j - 1
        alone = ~tied & ~np.concatenate([tied[1:] & (np.diff(live) == 1), [False]])
        live = live[~alone]
        if not len(live):
            break
        run = np.cumsum(~(common[live] > j - 1))
        part = order[live]
        by = np.lexsort((words[part, j], run))
        order[live] = part[by]
        w = words[order[live], j]
        split = np.concatenate([[False], (np.diff(w.view(np.int64)) != 0) & (np.diff(run) == 0)])
        common[live[split]] = j
    return order, common


def _words(body: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(body).view(">u8").astype(np.uint64)


def repeats(keys: np.ndarray, bodies: list[bytes], left: np.ndarray) -> list[list[tuple[int, int]]]:
    """For suffixes sorted into a bucket: each one's repeated byte ranges, relative to its body.

    In a group of equal keys a window d bytes left of the key repeats where another's left d and right 100 - d bytes
    are equal. Groups of two take the common lengths as they are; in larger ones each depth's classes, which the
    sorted order gives, are compared for all depths.
    """
    n, side = len(keys), WIDTH - 1
    lefts, rights = np.full((n, 104), 255, np.uint8), np.full((n, 104), 255, np.uint8)  # no byte of UTF-8 is 255
    l_len, r_len = left.astype(np.int64), np.array([len(b) for b in bodies], np.int64) - left - KEY
    for i, b in enumerate(bodies):
        k = left[i]
        lefts[i, :k] = np.frombuffer(b, np.uint8, k)[::-1]
        rights[i, : r_len[i]] = np.frombuffer(b, np.uint8, r_len[i], k + KEY)
    classes = []
    for side_bytes, lens in ((lefts, l_len), (rights, r_len)):
        order, common = multikey_sort(keys, _words(side_bytes))
        before = np.concatenate([order[:1], order[:-1]])
        differ = side_bytes[order] != side_bytes[before]
        shared = np.where(differ.any(1), differ.argmax(1), side)
        shared = np.minimum(np.minimum(shared, lens[order]), lens[before])
        shared[common < 0] = -1
        classes.append((order, shared))
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    _, index, size = np.unique(keys, return_inverse=True, return_counts=True)
    # Groups of two.
    two = np.flatnonzero(size[index] == 2)
    if len(two):
        most = []
        for order, shared in classes:
            got = np.full(n, -1)
            second = shared >= 0
            got[order[second]] = shared[second]
            got[order[np.flatnonzero(second) - 1]] = np.maximum(got[order[np.flatnonzero(second) - 1]], shared[second])
            most.append(got)
        for i in two[most[0][two] + most[1][two] >= side].tolist():
            out[i].append((int(l_len[i] - most[0][i]), int(l_len[i] + KEY + most[1][i])))
    # Larger groups.
    many = np.flatnonzero(size[index] > 2)
    if len(many):
        some = np.zeros(n, bool)
        some[many] = True
        ids = []
        for order, shared in classes:
            at = order[some[order]]
            ids.append((at, shared[some[order]]))
        hit = np.zeros((n, WIDTH), bool)
        for d in range(WIDTH):
            label = np.zeros((2, n), np.int64)
            for which, depth in ((0, d), (1, side - d)):
                at, shared = ids[which]
                label[which, at] = np.cumsum(shared < depth)
            fit = many[(l_len[many] >= d) & (r_len[many] >= side - d)]
            both = label[0, fit] << 32 | label[1, fit]
            _, back, count = np.unique(both, return_inverse=True, return_counts=True)
            hit[fit[count[back] > 1], d] = True
        for i in np.flatnonzero(hit.any(1)).tolist():
            d = np.flatnonzero(hit[i])[::-1]
            s = l_len[i] - d  # window starts, ascending
            cut = np.flatnonzero(np.diff(s) > LENGTH)
            for a, b in zip(np.append(s[:1], s[cut + 1]), np.append(s[cut], s[-1:])):
                out[i].append((int(a), int(b) + LENGTH))
    return out


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans from rows that come sorted by (lead, key); a group that a batch cuts waits for the next."""
    rest: pa.Table | None = None

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, rows, start = (table[c].to_numpy() for c in ("key", "row", "start"))
        found = repeats(keys, table["body"].to_pylist(), table["left"].to_numpy())
        out = [(rows[i], start[i] + a, start[i] + b) for i, spans in enumerate(found) for a, b in spans]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["row", "start", "end"])

    for batch in batches:
        rest = pa.concat_tables([rest, pa.Table.from_batches([batch])]) if rest is not None else pa.Table.from_batches([batch])
        if len(rest) < ROWS:
            continue
        key = rest["key"].to_numpy()
        cut = len(key) - 1
        while cut > 0 and key[cut - 1] == key[cut]:
            cut -= 1
        if cut:
            yield from solve(rest.slice(0, cut))
            rest = rest.slice(cut)
    if rest is not None and len(rest):
        yield from solve(rest)


def _parts(batch: pa.RecordBatch, step: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Hot regions cut at fixed distances from their keys: of each part, the item, first window, last window, and the
    hashes of what all windows of a whole part share (core) and of all bytes they cover (whole).

    Both hashes include the key and the part's distance: equal windows agree in them, and a window that two suffixes
    of its document stand for is not its own repeat.
    """
    names = batch.schema.names
    key, left = (batch.column(names.index(c)).to_numpy() for c in ("key", "left"))
    buf, at = arrow_bytes(batch.column(names.index("body")))
    sums = prefix_sums(buf)
    skipped = (WIDTH - 1) - left.astype(np.int64)
    windows = np.diff(at) - LENGTH + 1
    low, high = skipped // step, (skipped + windows - 1) // step
    n = high - low + 1
    item = np.repeat(np.arange(len(batch)), n)
    part = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n) + low[item]
    first = np.maximum(part * step - skipped[item], 0)
    last = np.minimum(part * step + step - 1 - skipped[item], windows[item] - 1)
    salt = mix(key.view(np.uint64)[item] + part.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    core = range_hash(sums, at[item] + part * step + step - 1 - skipped[item], at[item] + part * step - skipped[item] + LENGTH)
    whole = range_hash(sums, at[item] + first, at[item] + last + LENGTH)
    yield item, first, last, mix(core ^ salt), mix(whole ^ salt), (at, sums, salt, part * step - skipped[item])


def hot_spans(hot: DataFrame) -> DataFrame:
    """Spans of regions whose keys have too many different ones to sort: by counting parts of ten windows, then single windows.

    A part whose whole bytes occur twice is a repeat, and is cut further only once a task, for others to be compared
    with; a part whose core occurs once holds no repeat; the windows of the others are counted. Counts combine before
    they are shuffled, so nothing here gathers a frequent key. Equal regions are settled before.
    """
    spark, step = hot.sparkSession, 10

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in small batches."""
        for batch in batches:
            yield from (batch.slice(lo, 2048) for lo in range(0, len(batch), 2048))

    def place(batch: pa.RecordBatch, item: np.ndarray) -> tuple[np.ndarray, ...]:
        return tuple(batch.column(batch.schema.names.index(c)).to_numpy()[item] for c in ("row", "start"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in fresh(batches):
            for item, first, last, core, whole, _ in _parts(batch, step):
                row, start = place(batch, item)
                yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(row), pa.array(start + first), pa.array(start + last + LENGTH)], names=["core", "whole", "row", "start", "end"])

    parts = hot.mapInArrow(cut, "core long, whole long, row long, start long, end long")
    wholes = materialise(parts.groupBy("whole").agg(F.count("*").alias("n")).filter("n > 1").select("whole"))
    cores = materialise(parts.groupBy("core").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).filter("a <> b").select("core"))
    settled = parts.select("whole", "row", "start", "end").join(wholes, "whole").select("row", "start", "end")
    some, open_ = spark.sparkContext.broadcast(key_filter(wholes)), spark.sparkContext.broadcast(key_filter(cores))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in fresh(batches):
            for item, first, last, core, whole, (at, sums, salt, base) in _parts(batch, step):
                take = passes(open_.value, core)
                for i in np.flatnonzero(take & passes(some.value, whole)).tolist():  # settled: once is enough to compare with
                    take[i] = whole[i] not in seen
                    if len(seen) < 1_000_000:
                        seen.add(whole[i])
                i = np.flatnonzero(take)
                n = (last - first + 1)[i]
                i = np.repeat(i, n)
                s = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                with np.errstate(over="ignore"):
                    h = mix(range_hash(sums, at[item[i]] + s, at[item[i]] + s + LENGTH) ^ salt[i] + (s - base[i]).astype(np.uint64))
                row, start = place(batch, item[i])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(row), pa.array(start + s)], names=["window", "row", "start"])

    windows = hot.mapInArrow(single, "window long, row long, start long")
    twice = windows.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window")
    return settled.unionByName(windows.join(twice, "window").select("row", "start", (F.col("start") + LENGTH).alias("end")))


def spans(texts: DataFrame) -> DataFrame:
    """(row, start, end): byte ranges that repeat, for texts in columns row (a hash) and text."""
    spark = texts.sparkSession
    states = materialise(_states(texts.mapInArrow(_stats, _STATS)))
    known, differing = (spark.sparkContext.broadcast(key_filter(k.select("key"))) for k in (states, states.filter("not same")))
    # What the filter lets through besides occurs once and is no region that comes twice.
    shared = materialise(texts.mapInArrow(_shared(known), _SHARED))
    pairs = materialise(shared.groupBy("key", "region").agg(F.count("*").alias("n")))
    found = shared.join(pairs.filter("n > 1").select("region"), "region").select("row", "start", (F.col("start") + F.col("width")).alias("end"))
    bodies = texts.mapInArrow(_bodies(differing), _ROWS)
    large = pairs.groupBy("key").agg(F.count("*").alias("n")).filter(f"n > {GROUP}").select("key")
    if not (large := materialise(large)).isEmpty():
        found = found.unionByName(hot_spans(materialise(bodies.join(large, "key").select("key", "region", "row", "start", "width", "left", "body"))))
        bodies = bodies.join(large, "key", "left_anti")
    sort = bodies.select("key", "row", "start", "left", "lead", "body").repartitionByRange(F.col("lead"), F.col("key")).sortWithinPartitions("lead", "key").mapInArrow(_bucket, "row long, start long, end long")
    return found.unionByName(sort)


def union_spans(found: np.ndarray) -> np.ndarray:
    """Sorted disjoint ranges, touching ones joined."""
    found = found[np.argsort(found[:, 0], kind="stable")]
    reach = np.maximum.accumulate(found[:, 1])
    new = np.concatenate([[True], found[1:, 0] > reach[:-1]])
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(found) - 1)
    return np.column_stack([found[new, 0], reach[ends]])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of each row."""
    for batch in batches:
        buf, at = arrow_bytes(batch.column(1))
        raw, out = memoryview(buf.tobytes()), []
        lists = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * len(batch)
        for i, found in enumerate(lists):
            text, cut = raw[at[i] : at[i + 1]], np.zeros((0, 2), np.int64)
            kept = bytes(text)
            if found:
                cut = union_spans(np.array([(x["start"], x["end"]) for x in found], np.int64))
                edges = [0, *cut.ravel().tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((len(text), len(text) - len(kept), len(cut), kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        if out:
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept`` (binary) of every document.

    Texts without a repeat, all but a few of which a filter of bounded size names, are not shuffled.
    """
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    found = materialise(spans(texts.select("row", "text")).select("row", "start", "end").distinct().groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("found")))
    some = texts.sparkSession.sparkContext.broadcast(key_filter(found.select("row")))

    def named(yes: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(passes(some.value, batch.column(2).to_numpy()) == yes))

        return run

    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    touched = texts.mapInArrow(named(True), "doc_id long, text string, row long").join(found, "row", "left").select("doc_id", "text", "found").mapInArrow(_removed, out)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _removed(b.select([0, 1]) for b in named(False)(batches))

    return touched.unionByName(texts.mapInArrow(untouched, out))


def removal_digest(removed: DataFrame) -> DataFrame:
    """The contract's columns."""
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
