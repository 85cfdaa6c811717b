"""Operator 4, packing: power-of-two decomposition.

Each document's token ids (closed by an end id) are cut into pieces whose lengths are powers of two: as many
pieces of the full length as fit, then the binary digits of what is left, longest first. A piece is a sequence of
its own, so no sequence crosses documents and, a power of two needing no padding, none is padded. Pieces of equal
length share a bucket (``bucket`` = log2 of the length), which the sequence ids and the writer below follow.

Defined cases: a null or empty text gives the one piece that holds the end id. Repeated rows and repeated doc_ids
give pieces of their own each (their sequence ids differ). A null doc_id stays null. An empty table gives no rows.
Columns beside doc_id and text are not read, whatever their names. Very long texts are tokenised whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import small_batches, text_or_empty

SEQUENCE, END_ID = 2048, 1
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, bucket int"


def piece_lengths(n: int, longest: int = SEQUENCE) -> list[int]:
    """n as full pieces, then its remaining binary digits from the largest."""
    full, rest = divmod(n, longest)
    return [longest] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class WordTokenizer:
    """Ids of whole texts by a word-level BPE file: byte symbols, and a mark on each word's last symbol.

    Texts of Latin letters are cut into words here and encoded by byte pairs with the file's own vocabulary and order
    of merges, the mark being a control character after each word. What joins first is decided by the joined bytes
    alone, which gives the file's ids where ``joins_by_bytes`` holds. Any other text, and one with a very long word,
    goes to the file's own tokenizer whole.
    """

    # Fixed value: what the tokenizer file cuts words by beside white space; runs of letters are what is between.
    CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\d|(?:[^\s\w]|_)+")
    # Fixed value: characters for which Python's idea of letter, digit or case could differ from the tokenizer's.
    OTHER = re.compile("[^\x09-\x0D\x20-\x7e\xa1\xbf\xc0-\xd6\xd8-\xf6\xf8-\xff]|<\\|")
    # Fixed value: how the file marks a word's last symbol.
    LAST = "</w>"
    MARK, LONGEST_WORD = "\x01", 400

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.model = json.load(f)["model"]
        self.fast = tiktoken.Encoding("words", pat_str=f"[^{self.MARK}]+{self.MARK}", mergeable_ranks=self._ranks(), special_tokens={}) if self.joins_by_bytes() else None
        self.model = None

    def _ranks(self) -> dict[bytes, int]:
        """Each symbol's bytes, the mark as one more, and its id."""
        own = {c: bytes([b]) for b, c in bytes_shown().items()}
        marked = ((t.removesuffix(self.LAST), t.endswith(self.LAST) and t != self.LAST, i) for t, i in self.model["vocab"].items())
        return {b"".join(own[c] for c in t) + (self.MARK.encode() if last else b""): i for t, last, i in marked}

    def joins_by_bytes(self) -> bool:
        """Whether joining whatever neighbours have the bytes of the lowest id gives the file's own result.

        So it is when ids follow the order of the merges, marked single bytes come before these, and every merge's
        symbol, encoded alone, ends in that merge: two neighbours with the bytes of a symbol then are those of its merge.
        """
        vocab, merges = self.model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in self.model["merges"]]
        first = len(vocab) - len(merges)
        place = {m: i for i, m in enumerate(merges)}
        singles = set(bytes_shown().values())
        if {t for t, i in vocab.items() if i < first} != singles | {c + self.LAST for c in singles} or len({a + b for a, b in merges}) < len(merges):
            return False
        for i, (a, b) in enumerate(merges):
            if vocab.get(a + b) != first + i:
                return False
            parts = list((a + b).removesuffix(self.LAST))
            if (a + b).endswith(self.LAST):
                parts[-1] += self.LAST
            while len(parts) > 2:
                rank, at = min((place.get(p, len(merges)), k) for k, p in enumerate(pairwise(parts)))
                if rank == len(merges):
                    return False
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if parts != [a, b]:
                return False
        return True

    def encode(self, text: str) -> np.ndarray:
        if self.fast and not self.OTHER.search(text):
            words = self.CUT.sub(f"{self.MARK}\\g<0>{self.MARK}", unicodedata.normalize("NFC", text).lower()).split()
            if len(max(words, key=len, default="")) <= self.LONGEST_WORD:
                return np.array(self.fast.encode_ordinary(self.MARK.join(words) + self.MARK), np.uint32)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


def bytes_shown() -> dict[int, str]:
    """The character that byte-level files write for each byte: printable ones themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker: tasks that follow find it ready."""
    return WordTokenizer(path)


def pack(docs: DataFrame, tokenizer_path: str, longest: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece, its ids as little-endian unsigned 32-bit binary.

    Runs within the scan's partitions: nothing is shuffled. A sequence id is (bucket, partition, running number
    in the partition), so equal lengths have neighbouring ids and a recomputed partition gives the same ids.
    """
    if longest & (longest - 1):
        raise ValueError("the sequence length must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = word_tokenizer(tokenizer_path), TaskContext.get().partitionId()
        count = [0] * 64
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(texts), 256):
                rows = []
                for doc_id, text in zip(ids_of[lo : lo + 256], texts[lo : lo + 256]):
                    ids, start = np.append(coder.encode(text), np.uint32(end_id)).astype("<u4"), 0
                    for n in piece_lengths(len(ids), longest):
                        b = n.bit_length() - 1
                        rows.append((doc_id, start, n, ids[start : start + n].tobytes(), len(ids), b << 58 | part << 36 | count[b], 0, b))
                        count[b] += 1
                        start += n
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "bucket"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, SCHEMA)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Equal lengths into folders of their own, so that a trainer can draw batches of one length."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)


def pieces_digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns: the ids as their CRC-32."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
