"""Repeated substrings: per-shard suffix arrays, common prefixes and a merge across shards.

A byte goes if a string of LENGTH bytes that covers it also starts earlier. Suffix arrays
of everything against everything would grow with the square of the shards, so shards are
made by content: every window of LENGTH bytes names an anchor, the least hash of its
GRAM-byte strings, and equal windows name equal anchors, so they come to one shard or to
the shards of one anchor. Consecutive windows of one anchor are a segment (about 35
windows on average). Hashes only rule strings out; that two are equal is decided on their
bytes (for whole copies of a text, which go first, on its SHA-256).

1. Segments are counted by anchor. One whose anchor is met once repeats nothing.
2. The bytes of the others, by shard: segments equal byte for byte are one. A suffix array
   by Larsson-Sadakane refinement that sorts only the groups that are still open, common
   prefixes in text order by Kasai's bound, all segments in step; suffixes that share
   LENGTH bytes are one window, and all but its first go.
3. An anchor with more segments than SHARD_SEGMENTS has several shards, dealt by document,
   so a passage that a third of all documents share is in one task nowhere. The sorted first windows of
   its shards are merged: each shard's are looked up in those merged so far by binary
   search, the later of two equal ones goes and new ones are inserted.

Windows are judged on the input, so the order of these steps does not matter.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, release, stored, table

LENGTH = 100
GRAM = 32
#: Segments of one anchor that go to one shard.
SHARD_SEGMENTS = 4096
#: Bytes of a shard (of several anchors) that are sorted together.
SHARD_BYTES = 1 << 20
#: Tasks over which the first windows of one anchor's shards are merged.
MERGE_PARTS = 64
#: Windows whose hashes are made together; their places fit _PLACE_BITS.
PIECE = 1 << 15
#: Bytes of texts that are taken together.
TOGETHER = 1 << 20
_PLACE_BITS = 16
_BYTES, _MIX = (np.random.default_rng(k).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1) for k, n in ((11, 256), (12, 16)))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all substrings of gram bytes (a power of two), by doubling."""
    h = _BYTES[data]
    k = 1
    while k < gram:
        h = h[:-k] * _MIX[k.bit_length()] + h[k:]
        k *= 2
    h ^= h >> np.uint64(32)
    h *= _MIX[0]
    h ^= h >> np.uint64(29)
    return h


def anchors(h: np.ndarray, span: int) -> np.ndarray:
    """For each run of span hashes the place of its least one (by the high bits), the leftmost if equal."""
    low = np.uint64((1 << _PLACE_BITS) - 1)
    val, k = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while k * 2 <= span:
        val = np.minimum(val[:-k], val[k:])
        k *= 2
    if span > k:
        val = np.minimum(val[: k - span], val[span - k :])
    return (val & low).astype(np.int64)


def segments(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """(text number, anchor hash, first window, windows) of the segments of all texts, in order.

    Texts are joined and taken in pieces of PIECE windows, so short ones cost no calls of
    their own; windows across two texts are dropped, and a segment ends with its piece.
    """
    size = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(size)
    data = np.frombuffer(b"".join(texts), np.uint8)
    out = [[np.empty(0, np.int64)] for _ in range(4)]
    for lo in range(0, max(0, len(data) - length + 1), PIECE):
        part = data[lo : lo + PIECE + length - 1]
        h = gram_hashes(part, gram)
        at = anchors(h, length - gram + 1)
        p = np.arange(lo, lo + len(at))
        own = np.searchsorted(end, p, "right")
        new = np.r_[True, (at[1:] != at[:-1]) | (own[1:] != own[:-1])]
        ok = p + length <= end[own]
        first = np.flatnonzero(new & ok)
        # a run's windows that fit in their text come first in it
        n = np.add.reduceat(ok, np.flatnonzero(new))[ok[np.flatnonzero(new)]]
        for o, v in zip(out, (own[first], h[at[first]].view(np.int64), p[first] - (end - size)[own[first]], n), strict=True):
            o.append(v)
    return tuple(np.concatenate(o) for o in out)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes in their full order, by Larsson-Sadakane refinement (Kasai's bound needs no less).

    Ranks start from eight bytes; each round doubles what they stand for and sorts only
    groups of more than one suffix, by the rank of the suffix that far on.
    """
    n = len(data)
    word = _words(data)[:n]
    sa = np.argsort(word)
    s = word[sa]
    new = np.r_[True, s[1:] != s[:-1]]
    spot = np.arange(n)
    group = np.maximum.accumulate(np.where(new, spot, 0))
    rank = np.empty(n, np.int64)
    rank[sa] = group
    h = 8
    while h < n:
        u = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(u):
            break
        idx = sa[u]
        on = idx + h
        key = np.where(on < n, rank[np.minimum(on, n - 1)] + 1, 0)
        both = (group[u] << 32) | key
        o = np.argsort(both)
        sa[u] = idx[o]
        c = both[o]
        nu = np.r_[True, c[1:] != c[:-1]]
        new[u] = nu
        group[u] = np.maximum.accumulate(np.where(nu, u, 0))
        rank[sa[u]] = group[u]
        h *= 2
    return sa


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, zero bytes after the end."""
    padded = np.concatenate((data, np.zeros(LENGTH + 16, np.uint8)))
    out = np.zeros(len(padded) - 8, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : len(padded) - 8 + k]
    return out


def common_prefixes(data: np.ndarray, sa: np.ndarray, start: np.ndarray, size: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """lcp[k]: bytes, up to most, that suffixes sa[k-1] and sa[k] share.

    Kasai: going through a segment in text order the common prefix shrinks by one at most,
    so it is only ever extended; all segments (start, size) go in step, eight bytes a look.
    """
    n = len(data)
    word = _words(data)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    o = np.argsort(-size, kind="stable")
    start, size = start[o], size[o]
    have = np.zeros(len(start), np.int64)
    for t in range(int(size.max(initial=0))):
        live = int(np.searchsorted(-size, -t, "left"))
        i = start[:live] + t
        k = place[i]
        j = sa[np.maximum(k - 1, 0)]
        have = np.maximum(have[:live] - 1, 0)
        more = np.flatnonzero((k > 0) & (have < most))
        while len(more):
            x = word[np.minimum(i[more] + have[more], len(word) - 1)] ^ word[np.minimum(j[more] + have[more], len(word) - 1)]
            full = x == 0
            part = more[~full]
            y = x[~full]
            have[part] += sum((y < np.uint64(1 << b)).astype(np.int64) for b in range(8, 64, 8))
            more = more[full]
            have[more] += 8
            more = more[have[more] < most]
        have[k == 0] = 0
        lcp[k] = np.minimum(have, most)
    return lcp


def repeated_windows(texts: list[bytes], key: np.ndarray, at: np.ndarray, length: int = LENGTH):
    """(repeats, firsts): windows, as (segment, offset), that start elsewhere earlier, and those that do not.

    Segment k is found at place at[k] of text number key[k]; earlier is by (key, place).
    """
    size = np.array([len(t) for t in texts])
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), np.uint8)
    sa = suffix_array(data)
    lcp = common_prefixes(data, sa, start, size, length)
    run = np.cumsum(lcp < length)
    seg = np.repeat(np.arange(len(texts)), size)[sa]
    off = sa - start[seg]
    ok = off + length <= size[seg]
    seg, off, run = seg[ok], off[ok], run[ok]
    o = np.lexsort((at[seg] + off, key[seg], run))
    seg, off, run = seg[o], off[o], run[o]
    first = np.r_[True, run[1:] != run[:-1]]
    # equal windows of one place (the same segment sent twice) are no repeats of each other
    return (seg[~first], off[~first]), (seg[first], off[first])


def _spans(key: np.ndarray, at: np.ndarray, length: int):
    """Windows (key, at) as covered spans: runs of consecutive windows joined."""
    o = np.lexsort((at, key))
    key, at = key[o], at[o]
    new = np.r_[True, (key[1:] != key[:-1]) | (at[1:] > at[:-1] + 1)] if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)] - 1 if len(at) else first
    return key[first], at[first], at[last] + length


_CUT, _FIRST = 0, 1
_SCHEMA = "kind int, key long, lo long, hi long, anchor long, shard int, window binary"


def _cut(key, lo, hi):
    n = len(key)
    none = pa.nulls(n)
    return pa.record_batch([pa.array(np.full(n, _CUT, np.int32)), *(pa.array(np.asarray(v, np.int64)) for v in (key, lo, hi)), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], names=["kind", "key", "lo", "hi", "anchor", "shard", "window"])


def _segment_rows(docs: DataFrame) -> DataFrame:
    """Rows (anchor, key, spot, again), one a segment; again: the same text has the same bytes there before."""

    def batch(b: pa.RecordBatch):
        keys = b.column(0).to_numpy()
        raws = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
        ends = np.cumsum([len(x) for x in raws])
        k = 0
        while k < len(raws):
            to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + TOGETHER, "right")))
            own, a, at, n = segments(raws[k:to])
            again = np.zeros(len(a), bool)
            o = np.lexsort((a, own))
            twice = (a[o][1:] == a[o][:-1]) & (own[o][1:] == own[o][:-1])
            if twice.any():
                seen: set[tuple[int, bytes]] = set()
                for j in np.sort(o[np.r_[twice, False] | np.r_[False, twice]]).tolist():
                    body = own[j], raws[k + own[j]][at[j] : at[j] + n[j] - 1 + LENGTH]
                    again[j] = body in seen
                    seen.add(body)
            if len(a):
                yield pa.record_batch([pa.array(a), pa.array(keys[k + own]), pa.array((at << 8) | n), pa.array(again)], names=["anchor", "key", "spot", "again"])
            k = to

    return batches(docs.select("_key", "_text"), "anchor long, key long, spot long, again boolean", batch)


def _met(segs: DataFrame) -> DataFrame:
    """Rows (_key, segs): of each document the segments whose anchor is met more than once. All segments are shuffled once."""
    met = segs.select("anchor", "key", "spot", F.count("*").over(W.partitionBy("anchor")).alias("n")).where("n > 1")
    shards = F.ceil(F.col("n") / SHARD_SEGMENTS).cast("int")
    met = met.select("anchor", "key", "spot", F.pmod(F.xxhash64("key"), shards).cast("int").alias("shard"), (shards > 1).alias("split"))
    return met.groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("anchor", "shard", "split", "spot")).alias("segs"))


def _bodies(met: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (anchor, shard, split, key, lo, body) of the segments of _met()."""

    def batch(b: pa.RecordBatch):
        key, texts, segs = b.column(0).to_numpy(), b.column(1), b.column(2)
        ends = segs.offsets.to_numpy()
        flat = segs.values.slice(ends[0], ends[-1] - ends[0])
        ends = ends - ends[0]
        spot = flat.field(3).to_numpy()
        lo, n = spot >> 8, (spot & 255) - 1 + LENGTH
        for r in range(0, len(key), 64):
            to = min(len(key), r + 64)
            body = []
            for k in range(r, to):
                raw = texts[k].as_py().encode("utf-8", "surrogatepass")
                i = slice(ends[k], ends[k + 1])
                body += [raw[x : x + m] for x, m in zip(lo[i].tolist(), n[i].tolist(), strict=True)]
            i = slice(ends[r], ends[to])
            size = ends[to] - ends[r]
            part = flat.slice(ends[r], size)
            yield pa.record_batch([part.field(0), part.field(1), part.field(2), pa.array(np.repeat(key[r:to], np.diff(ends[r : to + 1]))), pa.array(lo[i]), pa.array(body, pa.binary())], names=["anchor", "shard", "split", "key", "lo", "body"])

    both = docs.join(met, "_key").select("_key", "_text", "segs")
    return batches(both, "anchor long, shard int, split boolean, key long, lo long, body binary", batch)


def _compare(bodies: DataFrame) -> DataFrame:
    """Spans to cut, shard by shard, and the sorted first windows of anchors with several shards."""
    rows = bodies.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard", "key", "lo")

    def judge(t: pa.Table):
        anchor, shard, split, key, lo = (t.column(i).to_numpy() for i in range(5))
        texts = t.column(5).to_pylist()
        known: dict[tuple[int, bytes], int] = {}  # in a shard the first is the earliest
        own = np.array([known.setdefault(x, k) for k, x in enumerate(zip(shard.tolist(), texts, strict=True))])
        again = np.flatnonzero(own != np.arange(len(own)))
        if len(again):
            yield _cut(key[again], lo[again], lo[again] + np.array([len(texts[k]) for k in again.tolist()]))
        kind = np.flatnonzero(own == np.arange(len(own)))
        a = anchor[kind]
        alone = np.r_[True, a[1:] != a[:-1]] & np.r_[a[1:] != a[:-1], True]  # windows of one segment are never equal
        kind = kind[~alone | split[kind]]
        if not len(kind):
            return
        texts = [texts[k] for k in kind.tolist()]
        anchor, shard, split, key, lo = (x[kind] for x in (anchor, shard, split, key, lo))
        (seg, off), (fs, fo) = repeated_windows(texts, key, lo)
        if len(seg):
            yield _cut(*_spans(key[seg], lo[seg] + off, LENGTH))
        k = split[fs]
        if k.any():
            fs, fo = fs[k], fo[k]
            w = [texts[s][o : o + LENGTH] for s, o in zip(fs.tolist(), fo.tolist(), strict=True)]
            yield pa.record_batch([pa.array(np.full(len(fs), _FIRST, np.int32)), pa.array(key[fs]), pa.array(lo[fs] + fo), pa.nulls(len(fs)).cast(pa.int64()), pa.array(anchor[fs]), pa.array(shard[fs]), pa.array(w, pa.binary())], names=["kind", "key", "lo", "hi", "anchor", "shard", "window"])

    def run(it):
        held: pa.Table | None = None
        for b in it:
            cur = pa.Table.from_batches([b])
            cur = cur if held is None else pa.concat_tables([held, cur])
            if not len(cur):
                continue
            a, s = cur.column(0).to_numpy(), cur.column(1).to_numpy()
            new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (s[1:] != s[:-1])])
            ends = np.cumsum(pc.binary_length(cur.column(5)).to_numpy())
            at = 0
            for g in new[1:]:
                if ends[g - 1] - (ends[at - 1] if at else 0) >= SHARD_BYTES:
                    yield from judge(cur.slice(at, g - at))
                    at = int(g)
            held = cur.slice(at).combine_chunks()
        if held is not None and len(held):
            yield from judge(held)

    return rows.mapInArrow(run, _SCHEMA)


def merge_run(have, w: np.ndarray, key: np.ndarray, lo: np.ndarray):
    """Merge a shard's windows (sorted, each once) into those of earlier shards by binary search.

    Returns what is then there, as (windows, keys, places), and the (keys, places) of the
    windows that an equal one precedes.
    """
    if have is None:
        return (w, key, lo), (key[:0], lo[:0])
    hw, hk, hl = have
    at = np.searchsorted(hw, w)
    met = at < len(hw)
    met[met] = hw[at[met]] == w[met]
    i, j = np.flatnonzero(met), at[met]
    sooner = (key[i] < hk[j]) | ((key[i] == hk[j]) & (lo[i] < hl[j]))
    late = np.where(sooner, hk[j], key[i]), np.where(sooner, hl[j], lo[i])
    hk[j[sooner]], hl[j[sooner]] = key[i[sooner]], lo[i[sooner]]
    new = ~met
    return tuple(np.insert(x, at[new], y[new]) for x, y in ((hw, w), (hk, key), (hl, lo))), late


def _merge(firsts: DataFrame) -> DataFrame:
    """Cuts among first windows of the shards of one anchor; equal windows meet in one task, each shard's in their order."""
    rows = firsts.select("anchor", "shard", "window", "key", "lo").repartition("anchor", F.pmod(F.xxhash64("window"), F.lit(MERGE_PARTS))).sortWithinPartitions("anchor", "shard", "window")

    def run(it):
        have, last = None, None
        for b in it:
            if not b.num_rows:
                continue
            anchor, shard, key, lo = (b.column(i).to_numpy() for i in (0, 1, 3, 4))
            w = np.array(b.column(2).to_pylist(), dtype=f"S{LENGTH}")
            new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (shard[1:] != shard[:-1])])
            for x, z in zip(new.tolist(), [*new[1:].tolist(), len(anchor)], strict=True):
                if anchor[x] != last:
                    have, last = None, anchor[x]
                have, (k, p) = merge_run(have, w[x:z], key[x:z].copy(), lo[x:z].copy())
                if len(k):
                    yield _cut(*_spans(k, p, LENGTH))

    return rows.mapInArrow(run, _SCHEMA)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (_id, _key, _text): _key is the id itself if that is a long that no row lacks or shares, else the row's number in id order."""
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    if dict(d.dtypes)["_id"] in ("bigint", "int", "smallint", "tinyint"):
        seen = d.groupBy("_id").count().where("count > 1 or _id is null")
        if seen.isEmpty():
            return d.select("_id", F.col("_id").cast("long").alias("_key"), "_text")
    n = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    d = d.repartitionByRange(int(n), "_id", F.xxhash64("_text")).sortWithinPartitions("_id", F.xxhash64("_text"))
    return stored(d.withColumn("_key", F.monotonically_increasing_id()), "substring-docs")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_bytes, n_removed, n_spans, spans, kept), one a document.

    Texts are UTF-8 bytes (null: empty). spans are the maximal runs of removed bytes as
    (lo, hi), kept the bytes left. Earlier is by id, then place; rows that share an id or
    have none come in an order of their own, by their text, null ids first. Texts of fewer
    bytes than a window lose nothing. Other columns are not read.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col)
    same = keyed.where(F.octet_length("_text") >= LENGTH).select("_key", F.octet_length("_text").cast("long").alias("n"), F.sha2("_text", 256).alias("h"))
    firsts = same.groupBy("h").agg(F.min("_key").alias("first"), F.count("*").alias("k")).where("k > 1")
    copies = stored(same.join(firsts, "h").where("_key > first").select(F.col("_key").alias("key"), "n"), "substring-copies")
    own = keyed.join(copies.select(F.col("key").alias("_key")), "_key", "left_anti")
    segs = stored(_segment_rows(own), "substring-segments")
    release(spark)
    # kept, so that the shuffle of all segments can go before the texts are shuffled
    met = stored(_met(segs.where("not again")), "substring-met")
    release(spark)
    bodies = _bodies(met, own)
    judged = stored(_compare(bodies), "substring-shards")
    release(spark)
    spot = F.shiftright("spot", 8)
    cuts = segs.where("again").select("key", spot.alias("lo"), (spot + F.col("spot").bitwiseAND(255) - 1 + LENGTH).alias("hi"))
    cuts = cuts.unionByName(copies.select("key", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi")))
    cuts = cuts.unionByName(judged.where(F.col("kind") == _CUT).select("key", "lo", "hi")).unionByName(_merge(judged.where(F.col("kind") == _FIRST)).select("key", "lo", "hi"))
    cuts = cuts.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("cuts"))
    both = keyed.join(cuts.withColumnRenamed("key", "_key"), "_key", "left").select("_id", "_text", "cuts.lo", "cuts.hi")

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        n_bytes, removed, spans, kept = [], [], [], []
        for text, lo, hi in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            runs: list[list[int]] = []
            for a, z in sorted(zip(lo or (), hi or (), strict=True)):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], z)
                else:
                    runs.append([a, z])
            at, left = 0, []
            for a, z in runs:
                left.append(raw[at:a])
                at = z
            left.append(raw[at:])
            n_bytes.append(len(raw)), removed.append(sum(z - a for a, z in runs)), kept.append(b"".join(left))
            spans.append([{"lo": a, "hi": z} for a, z in runs])
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        return pa.record_batch([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return batches(both, f"{id_col} {id_type}, n_bytes long, n_removed long, n_spans long, spans array<struct<lo:long,hi:long>>, kept binary", batch)


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    got = remove_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_substrings": op6_substrings}

ORACLE_SQL = {
    "op6_substrings": r"""with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents), w as (select doc_id, unnest(range(0, length(h) // 2 - 99)) as p from d where length(h) >= 200),
x as (select w.doc_id, p, md5(substring(h, 2 * p + 1, 200)) as s from w join d using (doc_id)), f as (select doc_id, p from (select *, row_number() over (partition by s order by doc_id, p) as k from x) where k > 1),
g as (select *, case when p > lag(p) over (partition by doc_id order by p) + 100 then 1 else 0 end as fresh from f), i as (select *, sum(fresh) over (partition by doc_id order by p rows unbounded preceding) as isl from g),
s as (select doc_id, isl, min(p) as lo, max(p) + 100 as hi from i group by all), q as (select *, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as bef from s),
r as (select doc_id, sum(hi - lo) as n_removed, count(*) as n_spans, string_agg(substring(h, 2 * bef + 1, 2 * (lo - bef)), '' order by lo) as kept, max(hi) as fin from q join d using (doc_id) group by doc_id)
select doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(fin, 0) + 1))) as kept_sha256 from d left join r using (doc_id)"""
}
