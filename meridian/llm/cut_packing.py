"""Packing with cuts: length patterns by non-negative least squares, no padding.

A document's ids fill whole windows first; what is left of it, shorter than a window,
goes with others. Of some four million tokens (a shard) a task knows the histogram of these
lengths: shallow combinations of up to three lengths that fill a window are enumerated,
their repeat counts solved against the histogram by non-negative least squares and
rounded; then a greedy pass fills windows from what is left, longest piece that fits
first, and cuts a piece where none fits. So every window is full; fewer tokens than a
window stay over and go on to the task's next shard, and those of its last one into
sequences of lengths that are powers of two, which need no padding either.

As any piece may be cut, shards need nothing of each other: nothing is shuffled, ids are
held for one shard at a time, and a lost task is done again from its own input.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import stored, table
from .packing import END_ID, encoder, fit_patterns, patterns, tokenizer_path

CAPACITY = 1024
#: Tokens of short pieces that are held and packed together.
SHARD_TOKENS = 1 << 22
#: Rows of a batch that a task returns.
ROWS = 1 << 16


class Pool:
    """Pieces (document, start) by length, and the lengths in order."""

    def __init__(self) -> None:
        self.by: dict[int, list[tuple[int, int]]] = {}
        self.lengths: list[int] = []

    def put(self, length: int, piece: tuple[int, int]) -> None:
        if length not in self.by:
            self.by[length] = []
            insort(self.lengths, length)
        self.by[length].append(piece)

    def take(self, length: int) -> tuple[int, int]:
        got = self.by[length].pop()
        if not self.by[length]:
            del self.by[length]
            self.lengths.remove(length)
        return got

    def count(self, length: int) -> int:
        return len(self.by.get(length, ()))


def fill(pool: Pool, space: int) -> list[tuple[int, int, int]]:
    """One sequence of space tokens, as (document, start, length): the longest pieces that fit, then a cut one. The pool must hold that many."""
    out = []
    while space:
        k = bisect_right(pool.lengths, space)
        if k:
            length = pool.lengths[k - 1]
            doc, start = pool.take(length)
        else:
            whole = pool.lengths[0]
            doc, start = pool.take(whole)
            length = space
            pool.put(whole - space, (doc, start + space))
        out.append((doc, start, length))
        space -= length
    return out


def by_patterns(pool: Pool, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Full windows of whole pieces: patterns fitted to the pool's histogram, counts rounded by carrying what one leaves to the next."""
    hist = np.zeros(capacity + 1)
    for length in pool.lengths:
        hist[length] = pool.count(length)
    pats = patterns(capacity, np.array(pool.lengths, np.int64))
    if not len(pats):
        return []
    x = fit_patterns(hist, pats)
    order = np.lexsort((pats[:, 1], -pats[:, 2]))
    whole = np.diff(np.floor(np.cumsum(x[order]) + 1e-9), prepend=0).astype(np.int64)
    out = []
    for k in np.flatnonzero(whole > 0).tolist():
        parts = [int(v) for v in pats[order[k]][::-1] if v > 0]
        need = {v: parts.count(v) for v in parts}
        for _ in range(min(int(whole[k]), *(pool.count(v) // n for v, n in need.items()))):
            out.append([(*pool.take(v), v) for v in parts])
    return out


def sequences(pool: Pool, capacity: int, last: bool):
    """All full windows of the pool, and if it is the last one the rest, in powers of two."""
    yield from by_patterns(pool, capacity)
    left = sum(n * pool.count(n) for n in pool.lengths)
    while left >= capacity:
        yield fill(pool, capacity)
        left -= capacity
    while last and left:
        size = 1 << (left.bit_length() - 1)
        yield fill(pool, size)
        left -= size


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Rows (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset), one a piece, kept in the shared folder.

    capacity: a power of two. Every sequence is full or has a power of two of tokens, so
    none is padded. A null or empty text is its end id alone; equal documents are packed
    each for itself, rows without an id like others; an empty table gives no rows. Columns
    other than the two named are not read. Sequence numbers hold the task's number in
    their high bits; the rows are written at once, as a task done anew may pack otherwise.
    """

    def task(it):
        encode = encoder(tokenizer)
        number = TaskContext.get().partitionId() << 40
        held: dict[int, tuple[object, int, np.ndarray]] = {}  # by number of the document in the task: id, tokens, ids after the full windows
        pool, waiting, seen, rows = Pool(), 0, 0, []

        def piece(doc: int, start: int, length: int, at: int) -> None:
            key, tokens, tail = held[doc]
            k = start - tokens + len(tail)
            rows.append((key, start, length, zlib.crc32(tail[k : k + length]), tokens, number, at))

        def pack_all(last: bool):
            nonlocal number, pool, waiting, held
            for seq in sequences(pool, capacity, last):
                at = 0
                for doc, start, length in seq:
                    piece(doc, start, length, at)
                    at += length
                number += 1
                if len(rows) >= ROWS:
                    yield batch()
            left = {doc for v in pool.by.values() for doc, _ in v}
            held = {d: held[d] for d in left}
            waiting = sum(n * pool.count(n) for n in pool.lengths)

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.record_batch([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in it:
            kind = b.schema.field(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.array([*(encode(text.as_py()) if text.is_valid else ()), END_ID], dtype="<u4")
                full = len(ids) - len(ids) % capacity
                for start in range(0, full, capacity):
                    rows.append((key, start, capacity, zlib.crc32(ids[start : start + capacity]), len(ids), number, 0))
                    number += 1
                if full < len(ids):
                    held[seen] = key, len(ids), ids[full:].copy()
                    pool.put(len(ids) - full, (seen, full))
                    waiting += len(ids) - full
                seen += 1
                if waiting >= shard_tokens:
                    yield from pack_all(last=False)
                if len(rows) >= ROWS:
                    yield batch()
        if seen:
            yield from pack_all(last=True)
        if rows:
            yield batch()

    kind_name = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(task, f"{id_col} {kind_name}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return stored(out, "cut-packing")


def op13_cut_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op13_cut_packing": op13_cut_packing}
