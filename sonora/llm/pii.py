"""Operator 5, personal data: patterns plus a skip-chain conditional random field.

The four fixed patterns give each whole text's base spans. Number-like and address-like tokens of the text then are
the nodes of a random field with the labels none, email, ip, card and phone: a potential for the token's shape, one
for neighbouring tokens, and one for each pair of successive tokens with the same normalised content (skip edges),
however far apart. Loopy message passing gives each token's label; tokens that the patterns left out but that the
field labels are added spans, so that a number written once with its country code and later without it, or an
address repeated in another spelling, is found wherever the document repeats it.

The potentials are trained here, piece by piece: counts of (shape, label), (label, next label) and (label, label at
the other end of a skip edge) over all documents, the patterns' own labels being the training labels, smoothed and
turned into logarithms. A skip edge between a token that a pattern found and one that none did is no evidence, as the
latter was never judged, so it isn't counted; a prior of pseudo-counts, stated below, says that what is repeated keeps
its label, until counts of edges that were judged say otherwise. These tables are of fixed size.

Defined cases: a null text is empty; an empty table gives no rows; repeated rows are labelled each for themselves;
other columns are not read (redaction keeps them). Very long texts are read whole, time being linear in the length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialise, small_batches, text_or_empty

# Kinds in order and their patterns.
KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Number-like runs, and addresses written with spaces or words about the sign.
NUMBER = re.compile(r"\+?[0-9](?:[\x20().-]{0,2}[0-9]){8,}")
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]{2,64}(?:\x20?@\x20?|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63})+")
LOOK = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9]([\x20-]?[0-9]){12}", "phone": r"\+[0-9]", "number": r"[0-9]([\x20().-]{0,2}[0-9]){8}", "address": r"[\[(]at[\])]|@"}
LABELS = 5
SHAPES = 128
ROUNDS, SMOOTH = 12, 1.0
#: Pseudo-counts of skip edges whose ends agree, for each label, and of those that don't, for each two labels.
AGREE, DIFFER = 60.0, 0.05


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text: str, look: dict[str, bool]) -> list[tuple[int, int, int]]:
    """(kind's place, start, end) of all base spans, by kind, then start."""
    out = []
    if look["email"]:
        done, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            m = DOMAIN.match(text, at + 1) if start < at else None
            if m:
                out.append((0, start, m.end()))
                done = m.end()
            else:
                done = max(done, at + 1)
            at = text.find("@", at + 1 if not m else done)
    if look["ip"]:
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    if look["card"]:
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if look["phone"]:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(m[0].count, "0123456789")) <= 15]
    return out


def shape(token: str) -> int:
    """A token's shape in 0..127: what its digits, separators and signs look like, and whether a checksum holds."""
    if "@" in token or "at" in token and not token[0].isdigit():
        return 1 if re.fullmatch(r"[^\s@]+@[^\s@]+", token) else 2
    n = sum(map(token.count, "0123456789"))
    size = 0 if n < 10 else 1 if n < 13 else 2 if n < 16 else 3 if n < 20 else 4
    kind = 4 + size * 8 + 4 * token.startswith("+") + 2 * ("." in token) + any(c in token for c in " -()")
    return kind + 64 * (n >= 13 and luhn("".join(c for c in token if "0" <= c <= "9")))


def same(token: str) -> str:
    """What repeated or similar mentions of one thing share."""
    if "@" in token or "at" in token and not token[0].isdigit():
        return re.sub(r"\x20?[\[(]dot[\])]\x20?", ".", re.sub(r"\x20?(?:@|[\[(]at[\])])\x20?", "@", token)).lower()
    return "".join(c for c in token if c.isdigit())[-9:]


def nodes(text: str, look: dict[str, bool], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, int]]:
    """(start, end, shape, key, label) of the field's nodes in order: base spans, and tokens that touch none of them."""
    out = [(s, e, shape(text[s:e]), same(text[s:e]), k + 1) for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    loose = [m.span() for m in NUMBER.finditer(text)] if look["number"] else []
    loose += [m.span() for m in ADDRESS.finditer(text)] if look["address"] else []
    k, reach = 0, -1
    for s, e in sorted(loose):
        while k < len(taken) and taken[k][0] < e:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= s:
            out.append((s, e, shape(text[s:e]), same(text[s:e]), 0))
            reach = e
    return sorted(out)


def edges(found: list[dict]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between successive nodes within 200 characters, and skip edges between successive equal keys."""
    chain = [(i, i + 1) for i, (a, b) in enumerate(pairwise(found)) if b["start"] - a["end"] <= 200]
    last, skip = {}, []
    for i, x in enumerate(found):
        if len(x["key"]) >= 7:
            if x["key"] in last:
                skip.append((last[x["key"]], i))
            last[x["key"]] = i
    return chain, skip


def label(shapes: np.ndarray, chain: list[tuple[int, int]], skip: list[tuple[int, int]], unary: np.ndarray, pair: np.ndarray, tie: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Labels by loopy sum-product. ``fixed``: labels of nodes that the patterns settled, 0 where they didn't."""
    phi = unary[shapes].copy()
    settled = fixed > 0
    phi[settled] = -30.0
    phi[settled, fixed[settled]] = 0.0
    ends = np.array(chain + skip, np.int64).reshape(-1, 2)
    if len(ends) == 0:
        return phi.argmax(1)
    n, kind = len(ends), np.repeat([0, 1], [len(chain), len(skip)])
    table = np.stack([pair, tie])[kind]
    table = np.concatenate([table, table.transpose(0, 2, 1)])
    src, dst = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
    back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    msg = np.zeros((2 * n, LABELS))
    for _ in range(ROUNDS):
        belief = phi.copy()
        np.add.at(belief, dst, msg)
        new = np.logaddexp.reduce((belief[src] - msg[back])[:, :, None] + table, axis=1)
        new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
        msg = 0.5 * msg + 0.5 * new
    belief = phi.copy()
    np.add.at(belief, dst, msg)
    return belief.argmax(1)


_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
_NODE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("shape", pa.int32()), ("key", pa.string()), ("label", pa.int32())]))
SPANS = "array<struct<kind: int, start: long, end: long>>"
SCANNED = f"row long, doc_id long, base {SPANS}, nodes array<struct<start: long, end: long, shape: int, key: string, label: int>>"


def scan_batch(batch: pa.RecordBatch) -> tuple[list[list[tuple[int, int, int]]], list[list[dict]]]:
    texts, n = pc.fill_null(batch.column(batch.schema.names.index("text")), ""), len(batch)
    looks = {k: pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for k, p in LOOK.items()}
    base, found = [[] for _ in range(n)], [[] for _ in range(n)]
    for i in np.flatnonzero(np.logical_or.reduce(list(looks.values()))):
        text, look = texts[i].as_py(), {k: v[i] for k, v in looks.items()}
        base[i] = base_spans(text, look)
        found[i] = [dict(zip(("start", "end", "shape", "key", "label"), x)) for x in nodes(text, look, base[i])]
    return base, found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What training counts, summed over the partition: (table, row, column, count)."""
    total = {0: np.zeros((SHAPES, LABELS), np.int64), 1: np.zeros((LABELS, LABELS), np.int64), 2: np.zeros((LABELS, LABELS), np.int64)}
    for batch in batches:
        for found in batch.column(0).to_pylist():
            chain, skip = edges(found)
            for x in found:
                total[0][x["shape"], x["label"]] += 1
            for t, ends in ((1, chain), (2, skip)):
                for i, j in ends:
                    a, b = found[i]["label"], found[j]["label"]
                    if t == 1 or (a > 0) == (b > 0):
                        total[t][a, b] += 1
    rows = [(t, int(i), int(j), int(c[i, j])) for t, c in total.items() for i, j in zip(*np.nonzero(c))]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["t", "i", "j", "n"])


def train(scanned: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Potentials from the counts over all documents; at most 690 rows reach the driver."""
    tables = [np.full((SHAPES, LABELS), SMOOTH), np.full((LABELS, LABELS), SMOOTH), np.where(np.eye(LABELS, dtype=bool), AGREE, DIFFER)]
    for r in scanned.select("nodes").mapInArrow(_counted, "t int, i int, j int, n long").groupBy("t", "i", "j").agg(F.sum("n").alias("n")).collect():
        tables[r["t"]][r["i"], r["j"]] += r["n"]
    unary = np.log(tables[0] / tables[0].sum(1, keepdims=True))
    # A pair's potential is how much likelier the labels are together than apart.
    pair, tie = (np.log(t / t.sum() / np.outer((t.sum(1) + t.sum(0)) / 2, (t.sum(1) + t.sum(0)) / 2) * t.sum() ** 2) for t in tables[1:])
    return np.maximum(unary, -5.0), np.clip(pair, -1.0, 1.0), np.clip(tie, -6.0, 6.0)


def find_personal(docs: DataFrame) -> DataFrame:
    """doc_id, ``base`` and ``spans`` for each document: arrays of (kind, start, end), kinds as in KINDS."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = scan_batch(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[dict(zip(("kind", "start", "end"), s)) for s in b] for b in base], _SPAN), pa.array(found, _NODE)], names=["doc_id", "base", "nodes"])

    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    scanned = materialise(texts.mapInArrow(scan, SCANNED.removeprefix("row long, ")))
    added = _labeller(train(scanned))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [sorted([tuple(s.values()) for s in b] + added(f)) for b, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[dict(zip(("kind", "start", "end"), s)) for s in x] for x in spans], _SPAN)], names=["doc_id", "base", "spans"])

    return scanned.mapInArrow(run, f"doc_id long, base {SPANS}, spans {SPANS}")


def _labeller(potentials: tuple[np.ndarray, np.ndarray, np.ndarray]):
    def added(found: list[dict]) -> list[tuple[int, int, int]]:
        fixed = np.array([x["label"] for x in found], np.int64)
        if not len(found) or fixed.all():
            return []
        got = label(np.array([x["shape"] for x in found]), *edges(found), *potentials, fixed)
        return [(int(k) - 1, x["start"], x["end"]) for x, k, f in zip(found, got, fixed) if not f and k]

    return added


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of its text replaced by [KIND], overlapping spans by the first one's; n_chars follows.

    Two reads of the text, no shuffle of it: the first trains the potentials, the second labels and rewrites.
    """
    texts = small_batches(docs).select(text_or_empty().alias("text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(scan_batch(batch)[1], _NODE)], names=["nodes"])

    added = _labeller(train(texts.mapInArrow(first, SCANNED[SCANNED.index("nodes") :])))
    place = docs.columns.index("text")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = scan_batch(batch)
            texts = batch.column(place)
            new, hit = [], np.zeros(len(batch), bool)
            for i, (b, f) in enumerate(zip(base, found)):
                if spans := sorted((s, -e, k) for k, s, e in b + added(f)):
                    text, out, done = texts[i].as_py(), [], 0
                    for s, e, k in spans:
                        if s >= done:
                            out += [text[done:s], f"[{KINDS[k].upper()}]"]
                        done = max(done, -e)
                    new.append("".join(out) + text[done:])
                    hit[i] = True
            text = pc.replace_with_mask(texts, pa.array(hit), pa.array(new, texts.type)) if hit.any() else texts
            yield batch.set_column(place, batch.schema.field(place), text)

    out = docs.mapInArrow(second, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _joined(col: str):
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_digest(found: DataFrame) -> DataFrame:
    """The contract's columns, and how many spans there are in all."""
    count = [F.size(F.array_remove(F.transform("base", lambda s: (s["kind"] == k).cast("int")), 0)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *count, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
