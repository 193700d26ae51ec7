"""Best-fit packing by non-negative least squares over length patterns.

The histogram of piece lengths has at most `capacity` bins, so whatever the corpus it
fits the driver. Patterns of up to three lengths that fill a sequence are enumerated;
non-negative least squares fits how often each is used to the histogram; the counts are
rounded, carrying what is left of one to the next, and the pieces left over are packed best fit decreasing, bin by bin of the
histogram and not piece by piece. The plan is a table of runs (length, first rank, count,
pattern run, slot offset) and each piece finds its run by its rank among pieces of its
length. Ranks come from counts per (part, length), so no length is gathered anywhere.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, durable, table

CAPACITY = 2048
END_ID = 0

#: Parts of the fitted counts that are tried, in this order.
PARTS = (1.0, 0.95, 0.9, 0.8)

_encoders: dict = {}


def encoder(path: str):
    """Texts to lists of ids, those of the tokenizer file at path without special tokens added.

    If the same vocabulary lies beside the file as ranks (.tiktoken), those give the same
    ids several times faster; texts that hold the string of a special token, which the
    file makes that token, go through the file itself.
    """
    if path not in _encoders:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        special = [t.content for t in slow.get_added_tokens_decoder().values()]
        fast = _ranked(path)

        def encode(text: str) -> list[int]:
            if fast is not None and not any(t in text for t in special):
                return fast.encode_ordinary(text)
            return slow.encode(text, add_special_tokens=False).ids

        _encoders[path] = encode
    return _encoders[path]


def _ranked(path: str):
    import base64
    import os

    ranks_file = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_file):
        return None
    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Rows (id_col, piece, start, length, ids_crc32): each document's ids and an end id, cut where too long.

    Only documents longer than capacity are cut; their first piece takes the remainder.
    """

    def batch(b: pa.RecordBatch):
        encode = encoder(tokenizer)
        which, out = [], []
        for k, text in enumerate(b.column(1).to_pylist()):
            ids = encode(text) if text else []
            ids.append(END_ID)
            raw = np.array(ids, dtype="<u4")
            first = len(raw) % capacity or capacity
            cuts = [0, *range(first, len(raw) + 1, capacity)]
            for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                which.append(k)
                out.append((i, lo, hi - lo, zlib.crc32(raw[lo:hi].tobytes())))
        cols = np.array(out, dtype=np.int64).reshape(-1, 4)
        return pa.record_batch([b.column(0).take(pa.array(which)), pa.array(cols[:, 0].astype(np.int32)), *(pa.array(cols[:, i]) for i in (1, 2, 3))], names=[id_col, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return batches(docs.select(id_col, text_col), f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long", batch)


def patterns(capacity: int, lengths: np.ndarray) -> np.ndarray:
    """Rows of three ascending lengths that sum to capacity (0: none), all among lengths, above 0."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    have[0] = True
    a, b = np.nonzero(have)[0], np.nonzero(have)[0]
    out = []
    for x in a:
        c = capacity - x - b
        ok = (b >= x) & (c >= b)
        bb, cc = b[ok], c[ok]
        ok = have[cc]
        out.append(np.c_[np.full(int(ok.sum()), x), bb[ok], cc[ok]])
    p = np.concatenate(out) if out else np.empty((0, 3), np.int64)
    return p[p[:, 2] < capacity]


def fit_patterns(hist: np.ndarray, pats: np.ndarray, steps: int = 100) -> np.ndarray:
    """Non-negative repeat counts x that bring the patterns' lengths closest to hist, in least squares.

    Accelerated projected gradient; residuals of long lengths weigh more, as they are
    hardest to place later.
    """
    if not len(pats):
        return np.zeros(0)
    n = len(hist)
    live = pats > 0
    weight = (np.arange(n) / (n - 1)) + 0.05
    norm = (weight[pats] ** 2 * live).sum(axis=1)
    scale = 1 / np.maximum(norm, 1e-12)
    x = np.zeros(len(pats))
    y, t = x.copy(), 1.0
    # the step: one over the largest number of patterns that share a length, per pattern
    share = np.bincount(pats[live], minlength=n).astype(float)
    step = scale / np.maximum.reduce(np.where(live, share[pats], 1), axis=1)
    for _ in range(steps):
        made = np.bincount(pats[live], weights=np.broadcast_to(y[:, None], pats.shape)[live], minlength=n)
        miss = weight**2 * (hist - made)
        miss[0] = 0
        new = np.maximum(0, y + step * (miss[pats] * live).sum(axis=1))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(hist: np.ndarray, capacity: int = CAPACITY) -> pd.DataFrame:
    """Rows (length, first, n, sequence, at): pieces ranked first .. first+n-1 of a length go to
    sequences sequence, sequence+1, ... at offset at. hist[k]: pieces of length k.

    The fitted counts are used whole; if that misses the least number that the tokens need,
    also parts of them (PARTS), which leave more for best fit, and the fewest sequences win.
    """
    lengths = np.flatnonzero(hist[:capacity])
    pats = patterns(capacity, lengths[lengths > 0])
    fitted = fit_patterns(np.r_[0, hist[1:capacity], 0].astype(float), pats)
    least = -(-int((hist * np.arange(capacity + 1)).sum()) // capacity)
    best = None
    for part in PARTS:
        used, runs = _filled(hist, pats, part * fitted, capacity)
        if best is None or used < best[0]:
            best = used, runs
        if used == least:
            break
    taken: dict[int, int] = {}
    rows = []
    for count, first, parts in best[1]:
        at = 0
        for length in parts:
            r = taken.get(length, 0)
            rows.append((length, r, count, first, at))
            taken[length] = r + count
            at += length
    return pd.DataFrame(rows, columns=["length", "first", "n", "sequence", "at"])


def _filled(hist: np.ndarray, pats: np.ndarray, x: np.ndarray, capacity: int) -> tuple[int, list[tuple[int, int, tuple[int, ...]]]]:
    """(sequences, runs): patterns by their counts x rounded, and the rest best fit decreasing; a run is (count, first sequence, lengths)."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    runs: list[tuple[int, int, tuple[int, ...]]] = []  # (count, first sequence, lengths)
    used = 0
    full = int(left[capacity])
    if full:
        runs.append((full, used, (capacity,)))
        used += full
        left[capacity] = 0
    # rounding: the fit spreads a length's count over many patterns, so what one leaves of a
    # whole goes on to the next in order (of its longest length) instead of being cut off
    order = np.lexsort((pats[:, 1], -pats[:, 2])) if len(pats) else np.empty(0, np.int64)
    whole = np.diff(np.floor(np.cumsum(x[order]) + 1e-9), prepend=0).astype(np.int64)
    for k, m in zip(order[whole > 0].tolist(), whole[whole > 0].tolist(), strict=True):
        parts, need = np.unique(pats[k][pats[k] > 0], return_counts=True)
        m = min(m, int((left[parts] // need).min()))
        if m > 0:
            left[parts] -= need * m
            runs.append((m, used, tuple(int(v) for v in pats[k][::-1] if v > 0)))
            used += m
    # the rest: best fit decreasing over groups of equal bins
    spaces: list[int] = []
    groups: dict[int, list[list]] = {}

    def put(space: int, count: int, parts: tuple[int, ...]) -> None:
        if space not in groups:
            insort(spaces, space)
            groups[space] = []
        groups[space].append([count, parts])

    for length in range(capacity - 1, 0, -1):
        n = int(left[length])
        while n:
            k = bisect_left(spaces, length)
            if k == len(spaces):
                each = capacity // length
                if n >= each:
                    put(capacity - each * length, n // each, (length,) * each)
                if n % each:
                    put(capacity - (n % each) * length, 1, (length,) * (n % each))
                n = 0
                continue
            space = spaces[k]
            g = groups[space]
            count, parts = g.pop()
            m = min(count, n)
            if count > m:
                g.append([count - m, parts])
            if not g:
                del groups[space]
                spaces.pop(k)
            put(space - length, m, (*parts, length))
            n -= m
    for g in groups.values():
        for count, parts in g:
            runs.append((count, used, parts))
            used += count
    return used, runs


def ranked(cut: DataFrame) -> DataFrame:
    """Pieces with rank: 0, 1, ... among those of a length. No length is gathered in one task."""
    dealt = cut.withColumn("part", F.spark_partition_id())
    dealt = durable(dealt)
    w = W.partitionBy("part", "length").orderBy("_order")
    dealt = dealt.withColumn("_order", F.monotonically_increasing_id())
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    local = dealt.withColumn("rank", F.row_number().over(w) - 1).drop("_order")
    out = local.join(before.drop("n"), ["length", "part"])
    return out.withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0))).drop("before", "part")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Rows (id_col, piece, start, length, ids_crc32, sequence_id, offset), one a piece.

    A null or empty text is its end id alone. Copies are packed like any others; an empty
    table gives no rows. Columns other than the two named are not read. The plan's table
    has a row for each run and slot: its size follows capacity, not the corpus.
    """
    rank = durable(ranked(pieces(docs, tokenizer, id_col, text_col, capacity)))
    hist = np.zeros(capacity + 1, np.int64)
    for r in rank.groupBy("length").count().collect():
        hist[r[0]] = r[1]
    runs = plan(hist, capacity)
    by = {int(k): g.sort_values("first") for k, g in runs.groupby("length")}
    tables = {k: (g["first"].to_numpy(), g["sequence"].to_numpy(), g["at"].to_numpy()) for k, g in by.items()}
    shared = rank.sparkSession.sparkContext.broadcast(tables)

    def place(length: pd.Series, r: pd.Series) -> pd.DataFrame:
        seq, at = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
        lens, rk = length.to_numpy(), r.to_numpy()
        for v in np.unique(lens):
            k = np.flatnonzero(lens == v)
            first, s, o = shared.value[int(v)]
            i = np.searchsorted(first, rk[k], "right") - 1
            seq[k], at[k] = s[i] + (rk[k] - first[i]), o[i]
        return pd.DataFrame({"sequence_id": seq, "offset": at})

    spot = F.pandas_udf(place, "sequence_id long, offset long")(F.col("length"), F.col("rank"))
    return rank.withColumn("_p", spot).select(id_col, "piece", "start", "length", "ids_crc32", "_p.sequence_id", "_p.offset")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op3_packing": op3_packing}
