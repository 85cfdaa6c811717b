"""Operator 3, n-gram Jaccard join: adaptive multi-match prefixes.

Documents with equal shingle sets form one class. The shingles of all classes are put in one global order, those that
the fewest classes hold first. Two classes that link share at least l of the first |x| - ceil(t|x|) + l shingles of
both, for any l up to ceil(t|x|). Each class takes the l whose prefix costs least by the counts of its shingles:
entries to scan, plus the candidates (at most scanned / l of them share l entries) times the cost of verifying one. A
pair must share as many prefix shingles as the smaller l of the two before its whole sets are compared.

Counts are exact where they matter. Most shingles occur in one class alone, which the first step finds out for all
documents: each chunk of documents deals its distinct shingles to buckets by hash, four bytes each, every bucket says
how many shingles of which document occur elsewhere, too, and a class of which less than ceil(t|x|) do so can link
with nothing. Only the other classes, as a rule a small part, give rows of shingles, which are counted and ranked.

Candidates meet by leaders, so no group emits its pairs. Each prefix shingle is led by the class, of those that hold
it, with the least share of shingles of its own (the text that the others were made from, if it is there). A class is
compared with its leaders first; what links is settled by that link. Only a class that doesn't link with its leader
meets the whole group of that leader, in blocks of bounded size, and a block is compared with another only if one of
them is of such classes. Two classes that share a prefix shingle share its leader, so no link between components is
lost; no bucket is capped.

Bounds: a task holds a chunk or a bucket of four-byte shingles (buckets are as many as shuffle partitions, 64 at
least) or two blocks. A filter of the classes that remain, of 16 MB at most, spares moving other texts; beyond about
8 million classes it passes more and more, up to moving each text once.

Defined cases: null, empty and blank texts have no shingles and link with nothing; a text of fewer than n words is
one shingle, the whole sequence; A-Z are folded; repeated rows and repeated ids fall into one class; an empty table
gives no rows; other columns are not read. Hashes have 64 bits: two different shingles or sets of N are confused with
a probability of about N^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import arrow_bytes, free_name, gram_hashes, materialise, mix, small_batches, text_or_empty, word_hashes
from .graph import components, key_filter, passes

NGRAM, PERCENT = 4, 85
#: Shingles and documents in a chunk, about; its documents have numbers of 16 bits, of which the last means several.
CHUNK, CHUNK_DOCS, SEVERAL = 1 << 20, 60_000, 65_535
#: Bytes of text whose shingles a bucket holds, about: some two million of them, at six bytes each.
BUCKET_BYTES = 12 << 20
#: Matches a prefix may be lengthened to ask for, and shingles compared in the time that scanning one entry takes.
MATCHES, COMPARED = (1, 2, 3, 4, 6, 8, 12), 4
#: Classes and shingles in a block of a group, about.
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 300_000
#: A shingle counts as one of few sets up to this part of a block's pairs; pairs of such shingles counted at a time.
SPARSE, PAIRS = 128, 1 << 21


def shingle_sets(texts: pa.Array, n: int = NGRAM) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes (unsigned 64-bit)."""
    for lo in range(0, len(texts), 64):
        buf, at = arrow_bytes(texts.slice(lo, 64))
        words, first = word_hashes(buf, at)
        grams = gram_hashes(words, n)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= n:
                g = np.sort(grams[a : b - n + 1])
                yield g[np.concatenate([[True], g[1:] != g[:-1]])] if len(g) > 1 else g
            else:
                yield gram_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def set_ids(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A signed 64-bit name of each set, of sets that follow each other in ``flat``; none may be empty."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    at = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        x = np.bitwise_xor.reduceat(mix(flat + np.uint64(0x2545F4914F6CDD1D)), at) + np.add.reduceat(mix(flat), at) * np.uint64(3) + sizes.astype(np.uint64)
    return mix(x).view(np.int64)


def needed(size: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of this size shares at least with one that it links with."""
    return (percent * size + 99) // 100


_SURVEY = "bucket int, chunk long, at int, doc_id long, key long, n long, cls long, known long, first boolean, owners binary, tokens binary"


def _survey(bits: int, n: int):
    """Per chunk of documents: a row for each document, and one for each bucket with its part of the chunk's distinct shingles.

    ``known``: how many of a document's shingles others of its chunk hold, too. ``first``: of documents with equal sets,
    the one that stands for them. A shingle's owner is its document's number in the chunk, or ``SEVERAL``.
    """

    def rows(chunk: int, ids: list, keys: list, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(s) for s in sets], np.int64)
        some = np.flatnonzero(sizes)
        flat = np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in some)])
        cls = set_ids(flat, sizes[some])
        first = np.zeros(len(sets), bool)
        first[some[np.unique(cls, return_index=True)[1]]] = True
        owner = np.repeat(some, sizes[some])
        flat, owner = flat[first[owner]], owner[first[owner]]
        order = np.argsort(flat)
        again = flat[order][1:] == flat[order][:-1]
        both = np.zeros(len(flat), bool)
        both[order[1:][again]] = both[order[:-1][again]] = True
        spare = np.zeros(len(flat), bool)
        spare[order[1:][again]] = True
        known = np.bincount(owner[both], minlength=len(sets))
        owner = np.where(both, SEVERAL, owner)[~spare].astype(np.uint16)
        flat = flat[~spare]
        bucket = (flat >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        bucket, owner, token = bucket[order], owner[order], (flat[order] >> np.uint64(32 - bits)).astype(np.uint32)
        kinds = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("at", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("known", pa.int64()), ("first", pa.bool_()), ("owners", pa.binary()), ("tokens", pa.binary())])
        named = np.zeros(len(sets), np.int64)
        named[some] = cls
        m, chunks = len(sets), lambda k: pa.array(np.full(k, chunk, np.int64))
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int32()), chunks(m), pa.array(np.arange(m), pa.int32()), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(sizes), pa.array(named, mask=sizes == 0), pa.array(known.astype(np.int64)), pa.array(first), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], schema=kinds)
        found, start = np.unique(bucket, return_index=True)
        cuts = list(zip(start.tolist(), [*start[1:].tolist(), len(bucket)]))
        m = len(found)
        none = [pa.nulls(m, kinds.field(i).type) for i in range(2, 9)]
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), chunks(m), *none, pa.array([owner[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([token[a:b].tobytes() for a, b in cuts], pa.binary())], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids, keys, sets, size = [], [], [], 0
        for batch in batches:
            own, key = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, s in enumerate(shingle_sets(batch.column(2), n)):
                ids.append(own[i])
                keys.append(key[i])
                sets.append(s)
                size += len(s)
                if size >= CHUNK or len(sets) >= CHUNK_DOCS:
                    yield from rows(chunk, ids, keys, sets)
                    ids, keys, sets, size, chunk = [], [], [], 0, chunk + 1
        if sets:
            yield from rows(chunk, ids, keys, sets)

    return run


def _elsewhere(key: tuple, table: pa.Table) -> pa.Table:
    """Of a bucket: for each chunk, how many of the shingles of which document another chunk has, too."""
    tokens, owners = ([np.frombuffer(x.as_buffer(), kind) for x in table[c]] for c, kind in (("tokens", np.uint32), ("owners", np.uint16)))
    flat = np.concatenate(tokens)
    order = np.argsort(flat)
    again = flat[order][1:] == flat[order][:-1]
    both = np.zeros(len(flat), bool)
    both[order[1:][again]] = both[order[:-1][again]] = True
    out, lo = [], 0
    for chunk, own in zip(table["chunk"].to_pylist(), owners):
        docs, times = np.unique(own[both[lo : lo + len(own)] & (own != SEVERAL)], return_counts=True)
        out.append((chunk, docs.tobytes(), times.astype(np.uint32).tobytes()))
        lo += len(own)
    return pa.table({name: pa.array([x[i] for x in out], kind) for i, (name, kind) in enumerate((("chunk", pa.int64()), ("owners", pa.binary()), ("times", pa.binary())))})


def _remaining(percent: int):
    def run(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        """Of a chunk: the classes of which enough shingles occur elsewhere."""
        known, at = docs["known"].to_numpy(), docs["at"].to_numpy()
        total = np.zeros(int(at.max(initial=-1)) + 1, np.int64)
        for owners, times in zip(found["owners"], found["times"]):
            total[np.frombuffer(owners.as_buffer(), np.uint16)] += np.frombuffer(times.as_buffer(), np.uint32)
        n = docs["n"].to_numpy()
        take = docs["first"].to_numpy() & (known + total[at] >= needed(n, percent))
        return docs.filter(pa.array(take)).select(["cls", "key", "n"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Shared elements of each of ``left`` with each of ``right``, which are sets.

    An element of few sets is counted for each two of them, one of many by dense products over slices of such elements.
    """
    sizes = [np.array([len(s) for s in side], np.int64) for side in (left, right)]
    rows = [np.repeat(np.arange(len(side)), n) for side, n in zip((left, right), sizes)]
    same = np.zeros((len(left), len(right)), np.int64)
    if not same.size:
        return same
    words, index = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    split = int(sizes[0].sum())
    parts = [index[:split], index[split:]]
    held = [np.bincount(p, minlength=len(words)) for p in parts]
    both = (held[0] > 0) & (held[1] > 0)
    often = both & (held[0] * held[1] * SPARSE > len(left) * len(right))
    few = both & ~often

    def ordered(chosen: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each side's (element's number, set's place) of the chosen elements, by element."""
        number, out = np.cumsum(chosen) - 1, []
        for p, r in zip(parts, rows):
            at = np.flatnonzero(chosen[p])
            at = at[np.argsort(p[at], kind="stable")]
            out.append((number[p[at]], r[at]))
        return out

    (lw, lr), (rw, rr) = ordered(few)
    met = held[1][few]
    begin = np.cumsum(met) - met
    times = met[lw]
    done = np.cumsum(times)
    lo = 0
    while lo < len(lw):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PAIRS, "right")))
        t = times[lo:hi]
        inner = np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t)
        at = np.repeat(lr[lo:hi], t) * len(right) + rr[np.repeat(begin[lw[lo:hi]], t) + inner]
        same += np.bincount(at, minlength=same.size).reshape(same.shape)
        lo = hi
    sides = ordered(often)
    for lo in range(0, int(often.sum()), width):
        dense = []
        for side, (w, r) in enumerate(sides):
            a, b = np.searchsorted(w, [lo, lo + width])
            m = np.zeros((len(sizes[side]), width), np.float32)
            m[r[a:b], w[a:b] - lo] = 1
            dense.append(m)
        same += np.rint(dense[0] @ dense[1].T).astype(np.int64)
    return same


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest, as (left, right) places, of the links that a matrix states."""
    out, new_l, new_r = [], np.ones(linked.shape[0], bool), np.ones(linked.shape[1], bool)
    for i in range(len(new_l)):
        if not new_l[i]:
            continue
        new_l[i], todo = False, [(0, i)]
        while todo:
            side, k = todo.pop()
            if side == 0:
                for j in np.flatnonzero(linked[k] & new_r).tolist():
                    new_r[j] = False
                    out.append((k, j))
                    todo.append((1, j))
            else:
                for j in np.flatnonzero(linked[:, k] & new_l).tolist():
                    new_l[j] = False
                    out.append((j, k))
                    todo.append((0, j))
    return out


class Side:
    """Classes to compare: names, prefixes, matches asked for, and their texts, read as sets when one must be verified."""

    def __init__(self, rows: list[dict], n: int) -> None:
        self.ids, self.least = [r["cls"] for r in rows], np.array([r["least"] for r in rows], np.int64)
        self.prefixes = [np.array(r["prefix"], np.int64) for r in rows]
        self.texts, self.n = [r["text"] for r in rows], n

    def sets(self, places: np.ndarray) -> list[np.ndarray]:
        return list(shingle_sets(pa.array([self.texts[i] for i in places.tolist()], pa.large_string()), self.n))


def side_links(left: Side, right: Side, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two sides, by class names: candidates are pairs that share enough of their prefixes."""
    asked = overlaps(left.prefixes, right.prefixes) >= np.minimum(left.least[:, None], right.least[None, :])
    i, j = np.flatnonzero(asked.any(1)), np.flatnonzero(asked.any(0))
    a, b = left.sets(i), right.sets(j)
    same = overlaps(a, b)
    sizes = [np.array([len(s) for s in side], np.int64) for side in (a, b)]
    linked = asked[np.ix_(i, j)] & (100 * same >= percent * (sizes[0][:, None] + sizes[1][None, :] - same))
    return [(left.ids[i[x]], right.ids[j[y]]) for x, y in forest(linked)]


_PAIRS = "u long, v long"


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])


def candidates(classes: DataFrame, n: int, percent: int) -> DataFrame:
    """For classes (cls, size, text): the prefix shingles (token, others: how many more hold it, cls, own: the share of
    its shingles that no other class holds, least: matches asked for) of all that may link with another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo in range(0, len(batch), 256):
                flat = list(shingle_sets(batch.column(2).slice(lo, 256), n))
                times = [len(s) for s in flat]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(flat).view(np.int64)), pa.array(np.repeat(cls[lo : lo + 256], times)), pa.array(np.repeat(sizes[lo : lo + 256], times))], names=["token", "cls", "size"])

    entries = classes.select("cls", "size", "text").mapInArrow(run, "token long, cls long, size long")
    often = entries.groupBy("token").agg((F.count("*") - 1).alias("others")).filter("others > 0")
    # Shingles of one class come first in the order, so ranks are counted from its end.
    last = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("others"), F.desc("token")))
    need = F.expr(f"cast(({percent} * size + 99) div 100 as long)")
    ranked = entries.join(often, "token").withColumn("rank", F.col("size") + 1 - last).withColumn("extra", F.col("rank") - (F.col("size") - need)).filter((F.col("extra") <= MATCHES[-1]) & (F.col("extra") <= need))
    scan = lambda l: F.sum(F.when(F.col("extra") <= l, F.col("others")).otherwise(0))
    cost = lambda l: F.struct((scan(l) * (1 + F.col("size") / (COMPARED * l))).alias("cost"), F.lit(l).alias("least"))
    best = F.least(F.lit(None).cast("struct<cost: double, least: int>"), *(F.when(need >= l, cost(l)) for l in MATCHES))
    chosen = ranked.groupBy("cls", "size").agg(best["least"].alias("least"), ((F.min("rank") - 1) / F.col("size")).alias("own"))
    return ranked.join(chosen.drop("size"), "cls").filter("extra <= least").select("token", "others", "cls", "own", "least")


def class_links(classes: DataFrame, n: int, percent: int) -> DataFrame:
    """(u, v): links that connect all classes (cls, size, text) which links connect."""
    held = materialise(candidates(classes, n, percent))
    leads = held.groupBy("token").agg(F.min(F.struct("own", "cls"))["cls"].alias("leader"))
    members = held.select("token", "cls").join(leads, "token").select("leader", "cls").distinct()
    full = materialise(held.groupBy("cls", "least").agg(F.collect_list("token").alias("prefix")).join(classes, "cls").select("cls", "least", "size", "prefix", "text"))
    other = full.select(F.col("cls").alias("leader"), *(F.col(c).alias(f"leader_{c}") for c in ("least", "prefix", "text")))
    met = members.filter("leader <> cls").join(full, "cls").join(other, "leader")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: Side | None = None
        for batch in batches:
            names, found = batch.column(0).to_pylist(), []
            at = 0
            while at < len(batch):
                end = at + 1
                while end < len(batch) and names[end] == names[at] and end < at + 256:
                    end += 1
                if last is None or last.ids != [names[at]]:
                    last = Side([{"cls": names[at], **{c: batch.column(f"leader_{c}")[at].as_py() for c in ("least", "prefix", "text")}}], n)
                part = Side(batch.slice(at, end - at).select(["cls", "least", "prefix", "text"]).to_pylist(), n)
                linked = {v for _, v in side_links(last, part, percent)}
                found += [(names[at], c, c in linked) for c in part.ids]
                at = end
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["leader", "cls", "linked"])

    first = materialise(met.select("leader", "leader_least", "leader_prefix", "leader_text", "cls", "least", "prefix", "text").mapInArrow(meet, "leader long, cls long, linked boolean"))

    # Classes that don't link with a leader meet its group, block by block; the leader itself has been met.
    sized = first.join(full.select("cls", "size"), "cls")
    counts = sized.groupBy("leader", "linked").agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    alone = counts.filter("not linked").select("leader")
    counts = materialise(counts.join(alone, "leader"))
    block = lambda i: F.xxhash64("leader", "linked", i)
    blocks = sized.join(counts, ["leader", "linked"]).select("cls", block(F.pmod(F.xxhash64("cls"), F.col("blocks"))).alias("block"))
    listed = counts.select("leader", "linked", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")).select("leader", "linked", block(F.col("i")).alias("block"))
    tasks = listed.filter("not linked").select("leader", "block").join(listed.select("leader", F.col("linked").alias("settled"), F.col("block").alias("other")), "leader").filter("settled or other >= block").select("block", "other")

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "rows": pa.array([table.select(["cls", "least", "prefix", "text"]).to_pylist()], _MEMBERS)})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                left, right = (Side(batch.column(c)[i].as_py(), n) for c in range(2))
                yield _pairs([x for x in side_links(left, right, percent) if x[0] != x[1]])

    packed = materialise(full.select("cls", "least", "prefix", "text").join(blocks, "cls").groupBy("block").applyInArrow(gather, "block long, rows array<struct<cls: long, least: int, prefix: array<long>, text: string>>"))
    facing = tasks.join(packed, "block").join(packed.select(F.col("block").alias("other"), F.col("rows").alias("other_rows")), "other").select("rows", "other_rows")
    return first.filter("linked").select(F.col("leader").alias("u"), F.col("cls").alias("v")).unionByName(facing.mapInArrow(compare, _PAIRS))


_MEMBERS = pa.list_(pa.struct([("cls", pa.int64()), ("least", pa.int32()), ("prefix", pa.list_(pa.int64())), ("text", pa.string())]))


def bucket_bits(text_bytes: int) -> int:
    """Leading bits of a shingle's hash that name its bucket. With 32 more bits a bucket tells its shingles apart."""
    return min(30, max(6, (text_bytes // BUCKET_BYTES).bit_length()))


def grouped(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, key (a hash of id and text), n (shingles), cls and root of every document: the classes of one component have one root."""
    spark = docs.sparkSession
    # Buckets by what there is, whatever the session's number of partitions: a task's buckets come one by one.
    whole = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bucket_bits(whole)
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    survey = materialise(texts.select("doc_id", "key", "text").mapInArrow(_survey(bits, n), _SURVEY))
    named = survey.filter("bucket is null").select("chunk", "at", "doc_id", "key", "n", "cls", "known", "first")
    found = survey.filter("bucket is not null").select("bucket", "chunk", "owners", "tokens").groupBy("bucket").applyInArrow(_elsewhere, "chunk long, owners binary, times binary")
    left = named.filter("first").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_remaining(percent), "cls long, key long, n long")
    chosen = materialise(left.groupBy("cls").agg(F.min("key").alias("key"), F.first("n").alias("size")))
    asked = spark.sparkContext.broadcast(key_filter(chosen.select("key")))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(asked.value, batch.column(0).to_numpy())))

    classes = materialise(texts.select("key", "text").mapInArrow(some, "key long, text string").join(chosen, "key").dropDuplicates(["key"]).select("cls", "size", "text"))
    roots = components(class_links(classes, n, percent)).select(F.col("node").alias("cls"), "root")
    return named.select("doc_id", "key", "n", "cls").join(roots, "cls", "left").select("doc_id", "key", "n", "cls", F.coalesce("root", "cls").alias("root"))


def link(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every document."""
    found = materialise(grouped(docs, n, percent))
    least = found.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """``docs``, all columns, with one row of each group: of the smallest doc_id (null ids last), then of the smallest hash
    of id and text, then of the smallest hash of the row. Documents without shingles stay."""
    key, place = free_name(docs, "key"), free_name(docs, "place")
    first = grouped(docs, n, percent).filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias(key)).select(key)
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    marked = docs.filter(~blank).withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), text_or_empty()))
    order = Window.partitionBy(key).orderBy(F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in docs.columns)))
    own = marked.join(first, key, "left_semi").withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).drop(key, place)
    return own.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(docs.filter(blank))
