"""Chunks: consecutive documents as numbers into their chunk's own list of distinct words.

What is known of a word over the whole corpus is worked out once per distinct word; it returns to the documents by
(chunk, word number), so that a shuffle moves each word once per chunk rather than once per occurrence.
"""

from __future__ import annotations

import ctypes
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of text of a chunk and of a piece, about; a longer text is a piece of its own.
CHUNK_BYTES, PIECE_BYTES = 10 << 20, 1 << 20
#: Bytes of a text that are made words at a time.
BLOCK_BYTES = 1 << 20
#: Kinds of words by ending and length; a word's is in the low bits of its hash.
SHAPES = 1 << 12
SCHEMA = "chunk long, h1 long, h2 long, idx int, n long, blob binary"

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def give_back() -> None:
    """Hands freed memory back to the system, as Python workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def words_of(text: bytes, block: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, A-Z lower-cased, in lists of about `block` bytes of text."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + block)
        to = cut.start() if cut else len(text)
        yield text[at:to].lower().split()
        at = to


def hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words for each word: 116 bits of a hash, and in the last 12 bits the word's shape."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
    shapes = np.fromiter((zlib.crc32(w[-3:], min(len(w), 15) // 3) for w in words), np.uint64, len(words))
    low = np.uint64(SHAPES - 1)
    return both[:, 0], (both[:, 1] & ~low) | (shapes & low)


@dataclass(frozen=True)
class Piece:
    """Some documents: ids, a mark of each, and their words' numbers in a row, with 0 after each document's words."""

    ids: list[int | None]
    marks: np.ndarray
    lengths: np.ndarray
    numbers: np.ndarray

    def to_bytes(self) -> bytes:
        known = np.array([i is not None for i in self.ids], np.uint8)
        parts = [np.array([len(self.ids)], "<i8"), np.array([i or 0 for i in self.ids], "<i8"), self.lengths.astype("<i8"), known, self.marks.astype(np.uint8), self.numbers.astype("<i4")]
        return zstandard.ZstdCompressor(level=3).compress(b"".join(p.tobytes() for p in parts))

    @classmethod
    def from_bytes(cls, blob: bytes) -> Piece:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        ids, lengths = np.frombuffer(raw, "<i8", n, 8).tolist(), np.frombuffer(raw, "<i8", n, 8 + 8 * n)
        known, marks = np.frombuffer(raw, np.uint8, n, 8 + 16 * n), np.frombuffer(raw, np.uint8, n, 8 + 17 * n)
        return cls([i if k else None for i, k in zip(ids, known)], marks, lengths, np.frombuffer(raw, "<i4", -1, 8 + 18 * n))


def chunked(docs: DataFrame, id_col: str, text_col: str, mark_of: Callable[[int | None], int] = lambda _: 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """SCHEMA's rows: (chunk, h1, h2, idx, n, null) for each distinct word of a chunk, idx being its number from 1 and n
    counting it in documents with mark 0; and (chunk, h1, h2, -1 - number, 0, blob) for each Piece of a chunk, where
    h1 and h2 only spread pieces over a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, pieces = TaskContext.get().partitionId() << 20, 0, 0
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = lambda: len(number) + 1
        ids, rows, marks, held, counts = [], [], [], 0, np.zeros(1, np.int64)

        def rows_of(idx, h1, h2, n, blobs) -> pa.RecordBatch:
            columns = [pa.array(np.full(len(idx), chunk, np.int64)), *(pa.array(np.ascontiguousarray(h).view(np.int64)) for h in (h1, h2)), pa.array(idx.astype(np.int32)), pa.array(n.astype(np.int64)), blobs]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "h1", "h2", "idx", "n", "blob"])

        def piece() -> pa.RecordBatch:
            nonlocal ids, rows, marks, held, counts, pieces
            learned = np.concatenate([np.zeros(0, np.int32), *(x for x, m in zip(rows, marks) if not m)])
            more = np.bincount(learned, minlength=len(number) + 1)
            more[: len(counts)] += counts
            counts = more
            blob = Piece(ids, np.array(marks, np.uint8), np.array([len(x) for x in rows], np.int64), np.concatenate(rows)).to_bytes()
            spread = np.frombuffer(xxhash.xxh3_128_digest(b"%d %d" % (chunk, pieces)), "<u8")
            out = rows_of(np.array([-1 - pieces]), spread[:1], spread[1:], np.zeros(1), pa.array([blob], pa.binary()))
            ids, rows, marks, held, pieces = [], [], [], 0, pieces + 1
            return out

        def words() -> Iterator[pa.RecordBatch]:
            known = list(number)
            for at in range(0, len(known), 50_000):
                part = known[at : at + 50_000]
                yield rows_of(np.arange(at + 1, at + 1 + len(part)), *hashes(part), counts[at + 1 : at + 1 + len(part)], pa.nulls(len(part), pa.binary()))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                found = [np.fromiter(map(number.__getitem__, w), np.int32, len(w)) for w in words_of(text)]
                rows.append(np.concatenate([*found, np.zeros(1, np.int32)]))
                ids.append(doc_id)
                marks.append(mark_of(doc_id))
                held += len(text)
                size += len(text)
                if held >= PIECE_BYTES:
                    yield piece()
                if size >= chunk_bytes:
                    if ids:
                        yield piece()
                    yield from words()
                    chunk, size, pieces, counts = chunk + 1, 0, 0, np.zeros(1, np.int64)
                    number.clear()
                    give_back()
        if ids:
            yield piece()
        yield from words()
        number.clear()
        give_back()

    return docs.select(F.col(id_col).cast("long"), common.utf8(text_col)).mapInArrow(run, SCHEMA)
