"""Operator 8, chat formatting: offset-aligned loss masks.

A conversation's rows, in the order of turn (then role, then text, where turns tie), are rendered into one text:
each turn as ``<|im_start|>role``, a line end, the text, ``<|im_end|>`` and a line end. Control strings inside texts
are escaped by one more backslash after ``<`` and before ``|``, which reading back removes. The whole rendering is
encoded once, with offsets; the sorted spans of assistant texts and the token offsets are intersected by binary
search, which gives each token's mask and, clipped to the spans, the characters under the loss.

Defined cases: a null text or role is empty; rows with a null conv_id form one conversation; repeated rows are turns
of their own; an empty table gives no rows; other columns are not read. Very long conversations are rendered whole.
A token that crosses a span's edge is masked in; its characters outside the span are not under the loss.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import small_batches

START, END, LOSS_ROLE = "<|im_start|>", "<|im_end|>", "assistant"
_HIDE, _SHOW = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
SCHEMA = "conv_id long, formatted string, token_ids array<int>, token_mask binary, loss_starts array<long>, loss_ends array<long>"


def escape(text: str) -> str:
    return _HIDE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHOW.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of assistant texts in it, sorted. A role keeps to one line: its line ends are escaped too."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = START + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
        body = escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END + "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    role = lambda r: re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(r))
    return [(role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def align(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Each token's mask, and the clipped character spans under the loss, joined where they touch within a turn's span."""
    mask = np.zeros(len(offsets), np.uint8)
    out = []
    starts, ends = offsets[:, 0], offsets[:, 1]
    for s, e in spans:
        lo, hi = np.searchsorted(ends, s, "right"), np.searchsorted(starts, e, "left")
        if lo < hi and s < e:
            mask[lo:hi] = 1
            a, b = np.maximum(starts[lo:hi], s), np.minimum(ends[lo:hi], e)
            reach = np.maximum.accumulate(b)
            new = np.concatenate([[True], a[1:] > reach[:-1]])
            out += zip(a[new].tolist(), np.append(reach[np.flatnonzero(new)[1:] - 1], reach[-1]).tolist())
    return mask, np.array(out, np.int64).reshape(-1, 2)


def coder(path: str, pattern: str | None = None) -> Callable[[str], tuple[np.ndarray, np.ndarray]]:
    """A function from a text to its token ids and their (start, end) in code points, from a tokenizer's JSON file or, with
    the pattern that cuts words, from a file of byte ranks. A token of part of a character has the whole one's offsets.
    Control strings are ordinary text to either."""
    if not path.endswith(".tiktoken"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True

        def from_json(text: str) -> tuple[np.ndarray, np.ndarray]:
            coded = whole.encode(text, add_special_tokens=False)
            return np.array(coded.ids, np.int32), np.array(coded.offsets, np.int64).reshape(-1, 2)

        return from_json
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(x): int(n) for x, n in map(bytes.split, f)}
    encoding = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    length = np.zeros(max(ranks.values()) + 1, np.int64)
    for x, n in ranks.items():
        length[n] = len(x)

    def from_ranks(text: str) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(encoding.encode_ordinary(text), np.int32)
        ends = np.cumsum(length[ids])
        starts = ends - length[ids]
        if not text.isascii():
            begun = np.cumsum(np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80)
            starts, ends = begun[starts] - 1, begun[ends - 1]
        return ids, np.column_stack([starts, ends])

    return from_ranks


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts), kind))


def format_chats(rows: DataFrame, tokenizer_path: str, pattern: str | None = None) -> DataFrame:
    """One row per conversation: the formatted text, its token ids, the token mask and the loss spans (code points)."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = small_batches(rows).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(tokenizer_path, pattern)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts, ids, masks, starts, ends = [], [], [], [], []
                for turns in part.column(1).to_pylist():
                    text, spans = render([(t["role"], t["text"]) for t in turns])
                    own, offsets = encode(text)
                    mask, under = align(offsets, spans)
                    texts.append(text)
                    ids.append(own)
                    masks.append(mask.tobytes())
                    starts.append(under[:, 0])
                    ends.append(under[:, 1])
                if texts:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts), _lists(ids, pa.int32()), pa.array(masks, pa.binary()), _lists(starts, pa.int64()), _lists(ends, pa.int64())], names=["conv_id", "formatted", "token_ids", "token_mask", "loss_starts", "loss_ends"])

    return chats.mapInArrow(run, SCHEMA)


def chats_digest(chats: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted text and the loss spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, text, starts, ends in zip(*(batch.column(i).to_pylist() for i in range(4))):
                turns = parse(text)
                loss = "".join(unescape(text[s:e]) for s, e in zip(starts, ends))
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((conv_id, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
