"""Embedding near-duplicates by collision counting over sorted one-dimensional projections.

Every vector of a shard is projected on COUNTED fixed random directions and each
projection is sorted. Around every vector, as a query, lies a window of WINDOW on either
side in each sorted order; a pair collides on a projection if one lies in the other's
window there. The windows of the first projection name the pairs, the others count their
collisions, and a pair is let go as soon as it can no longer reach the needed count. That
count is calibrated so that pairs at the threshold pass with RECALL; what passes is
verified by its exact cosine.

A label with few vectors is one shard. Counting pairs of a large one would grow with its
square, as one projection alone tells few pairs apart, so its vectors are dealt to shards
of about SHARD by slots of further projections, several tables of them: plan() gives the
slots a table and the tables by the number of vectors, and the recall it is calibrated to
covers this dealing too. A pair that meets in several tables is counted in the first of
them, and no pair is ever written out: tasks return links per vector and a spanning
forest. Copies of a vector are one vector with a weight, and a shard that is larger than
PART all the same (a tight cluster) is dealt out as pairs of its parts.
"""

from __future__ import annotations

from functools import cache
from math import ceil, comb, erf, exp, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, connected_components, durable, table
from .simhash import _Forest

COSINE = 0.93
COUNTED = 24
WINDOW = 1.1
#: Of pairs just at the threshold; those above it are found with more.
RECALL = 0.99
SLOT = 2.0
#: Vectors that a shard aims at.
SHARD = 1024
#: Vectors of one part of a shard.
PART = 2048
#: Slots a table at most; a label of SHARD times 2 to this power is dealt no finer.
MOST_KEYS = 24
SEED = 20240117
_PAIRS = 1 << 19


def collision_probability(cosine: float, window: float = WINDOW) -> float:
    """That unit vectors at this cosine lie within the window on a random projection."""
    d = sqrt(max(0.0, 2 - 2 * cosine))
    return erf(window / (d * sqrt(2))) if d else 1.0


def slot_probability(cosine: float, slot: float = SLOT) -> float:
    """That unit vectors at this cosine share a randomly shifted slot of a random projection."""
    d = sqrt(max(0.0, 2 - 2 * cosine))
    if not d:
        return 1.0
    return erf(slot / (d * sqrt(2))) - sqrt(2 / pi) * d / slot * (1 - exp(-((slot / d) ** 2) / 2))


def needed_collisions(cosine: float, counted: int = COUNTED, window: float = WINDOW, recall: float = RECALL) -> int:
    """The largest count that pairs at this cosine, the first projection among it, reach with half the loss that recall allows."""
    p = collision_probability(cosine, window)
    most = 1 - (1 - recall) / 2
    tail = 0.0
    for k in range(counted - 1, -1, -1):
        tail += comb(counted - 1, k) * p**k * (1 - p) ** (counted - 1 - k)
        if p * tail >= most:
            return k + 1
    return 1


@cache
def plan(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(slots a table, tables) for a label of n vectors: shards of about SHARD, and half the loss that recall allows."""
    keys = min(MOST_KEYS, max(0, ceil(log2(n / SHARD)))) if n else 0
    if not keys:
        return 0, 1
    met = slot_probability(cosine) ** keys
    return keys, ceil(log((1 - recall) / 2) / log(1 - met))


@cache
def _counting(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, COUNTED))


@cache
def _slots(dim: int, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim, t])
    return rng.standard_normal((dim, MOST_KEYS)), rng.uniform(0, SLOT, MOST_KEYS), rng.integers(1, 1 << 62, MOST_KEYS, dtype=np.int64) | 1


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # very large or small components neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _shards(reps: DataFrame, cosine: float) -> DataFrame:
    """Rows (t, cell, node, weight, keys, vec): each vector once in each table of its label."""
    sizes = reps.groupBy("grp").agg(F.count("*").alias("n"))

    def batch(b: pa.RecordBatch):
        node, weight, group, n = (b.column(i).to_numpy() for i in range(4))
        vecs = b.column(4)
        size, at = np.diff(vecs.offsets.to_numpy()), vecs.offsets.to_numpy()[:-1]
        flat = vecs.values.to_numpy()
        each = np.array([plan(int(m), cosine) for m in n], dtype=np.int64).reshape(-1, 2)
        for dim, keys, tables in np.unique(np.c_[size, each], axis=0).tolist():
            k = np.flatnonzero((size == dim) & (each[:, 0] == keys) & (each[:, 1] == tables))
            x = flat[at[k][:, None] + np.arange(dim)]
            u = _unit(x)
            cells = np.empty((len(k), tables), np.int64)
            for t in range(tables):
                a, shift, mix = _slots(dim, t)
                slots = np.floor((u @ a[:, :keys] + shift[:keys]) / SLOT).astype(np.int64)
                with np.errstate(over="ignore"):
                    cells[:, t] = (slots * mix[:keys]).sum(axis=1) * np.int64(-7046029254386353131) ^ (group[k] + dim)
            bins = [r.tobytes() for r in cells]
            raw = [r.tobytes() for r in x.astype(np.float64)]
            for t in range(tables):
                yield pa.record_batch(
                    [pa.array(np.full(len(k), t, np.int32)), pa.array(cells[:, t]), pa.array(node[k]), pa.array(weight[k]), pa.array(bins, pa.binary()), pa.array(raw, pa.binary())],
                    names=["t", "cell", "node", "weight", "keys", "vec"],
                )

    return batches(reps.join(sizes, "grp").select("node", "weight", "grp", "n", "vec"), "t int, cell long, node long, weight long, keys binary, vec binary", batch)


def _window_pairs(proj: np.ndarray, side: np.ndarray):
    """Pairs (i, j) whose first projections lie within the window, in chunks: all of them once, or those across the two sides."""
    cross = bool(side.any())
    left = np.flatnonzero(side == 0) if cross else np.argsort(proj, kind="stable")
    right = np.flatnonzero(side == 1) if cross else left
    right = right[np.argsort(proj[right], kind="stable")]
    lo = np.searchsorted(proj[right], proj[left] - WINDOW, "left") if cross else np.arange(1, len(left) + 1)
    size = np.maximum(np.searchsorted(proj[right], proj[left] + WINDOW, "right") - lo, 0)
    ends = np.cumsum(size)
    k = 0
    while k < len(left):
        to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + _PAIRS, "right")))
        s = size[k:to]
        off = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s)
        yield np.repeat(left[k:to], s), right[np.repeat(lo[k:to], s) + off]
        k = to


def _join_shard(t: int, weight, keys, x, side, cosine: float, need: int):
    """Links per vector and forest of one shard: all pairs (side all 0), or the pairs across its two sides."""
    n = len(weight)
    u = _unit(x)
    proj = (u @ _counting(x.shape[1])).T
    orders = np.argsort(proj, axis=1, kind="stable")
    ranks = np.empty_like(orders, dtype=np.int32)
    np.put_along_axis(ranks, orders, np.arange(n, dtype=np.int32)[None, :], axis=1)
    ordered = np.take_along_axis(proj, orders, axis=1)
    first = np.array([np.searchsorted(o, p - WINDOW, "left") for o, p in zip(ordered, proj, strict=True)], dtype=np.int32)
    last = np.array([np.searchsorted(o, p + WINDOW, "right") for o, p in zip(ordered, proj, strict=True)], dtype=np.int32)
    got = np.zeros(n, np.int64)
    forest = _Forest(n)
    for i, j in _window_pairs(proj[0], side):
        for k in range(t):  # counted in an earlier table
            new = keys[i, k] != keys[j, k]
            i, j = i[new], j[new]
        missed = np.zeros(len(i), np.int8)
        for c in range(1, COUNTED):
            r = ranks[c][j]
            missed += (r < first[c][i]) | (r >= last[c][i])
            live = missed <= COUNTED - need
            if not live.all():
                i, j, missed = i[live], j[live], missed[live]
            if not len(i):
                break
        for k in range(0, len(i), 1 << 15):
            a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            close = np.einsum("ij,ij->i", u[a], u[b]) >= cosine
            a, b = a[close], b[close]
            forest.join(a, b)
            got += np.bincount(a, weights=weight[b], minlength=n).astype(np.int64) + np.bincount(b, weights=weight[a], minlength=n).astype(np.int64)
    return got, forest.root


def _links(shards: DataFrame, cosine: float) -> DataFrame:
    """Rows (edge, a, b): a forest's edges, or (edge false) b links of vector a."""
    need = needed_collisions(cosine)
    sizes = shards.groupBy("t", "cell").agg(F.count("*").alias("n")).where("n > 1").select("t", "cell", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    sized = shards.join(sizes, ["t", "cell"])
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("t", "cell", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "weight", "keys", "vec")
    cell = ["t", "cell", "p", "q"]
    dealt = dealt.repartition(*cell).sortWithinPartitions(*cell, "side", "node")

    def emit(rows: pa.Table):
        cols = [rows.column(i).to_numpy() for i in range(7)]
        t, side, node, weight = cols[0], cols[4], cols[5], cols[6]
        new = np.ones(len(t), bool)
        new[1:] = False
        for c in cols[:4]:
            new[1:] |= c[1:] != c[:-1]
        begin = np.flatnonzero(new)
        a, b, edge = [], [], []
        for lo, hi in zip(begin, np.r_[begin[1:], len(t)], strict=True):
            if hi - lo < 2 or (cols[2][lo] != cols[3][lo] and (side[lo] == 1 or side[hi - 1] == 0)):
                continue
            keys = np.frombuffer(b"".join(rows.column(7).slice(lo, hi - lo).to_pylist()), np.int64).reshape(hi - lo, -1)
            x = np.frombuffer(b"".join(rows.column(8).slice(lo, hi - lo).to_pylist()), np.float64).reshape(hi - lo, -1)
            got, root = _join_shard(int(t[lo]), weight[lo:hi], keys, x, side[lo:hi], cosine, need)
            k = np.flatnonzero(root != np.arange(hi - lo))
            a.append(node[lo:hi][k]), b.append(node[lo:hi][root[k]]), edge.append(np.ones(len(k), bool))
            k = np.flatnonzero(got)
            a.append(node[lo:hi][k]), b.append(got[k]), edge.append(np.zeros(len(k), bool))
        if a:
            yield pa.record_batch([pa.array(np.concatenate(edge)), pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["edge", "a", "b"])

    def run(it):
        held = None
        for batch in it:
            cur = pa.Table.from_batches([batch])
            cur = cur if held is None else pa.concat_tables([held, cur])
            if not len(cur):
                continue
            end = [cur.column(i)[-1].as_py() for i in range(4)]
            cut = int(np.flatnonzero(np.logical_or.reduce([cur.column(i).to_numpy() != e for i, e in enumerate(end)])).max(initial=-1)) + 1
            if cut:
                yield from emit(cur.slice(0, cut))
            held = cur.slice(cut).combine_chunks()
        if held is not None and len(held):
            yield from emit(held)

    return dealt.mapInArrow(run, "edge boolean, a long, b long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """Rows (id_col, n_links, component_id, kept), one a vector.

    Vectors link if their labels are equal and not null and their cosine, in double
    precision, is at least the threshold; vectors of different lengths never do. A vector
    that is null, empty, zero or has null or non-finite components, and any without a
    label, links with nothing. Repeated rows count each for itself, and copies link with
    each other. No pair below the threshold is linked; of those at it, RECALL are found by
    calibration and more above it (tests measure it over the whole path). A null id gives
    a null component. Other columns are not read.
    """
    v = vectors.select(F.col(id_col), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).cast("string").alias("_label"))
    sound = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    sound = F.coalesce(F.col("_label").isNotNull() & F.col("vec").isNotNull() & sound, F.lit(False))
    whole = v.where(sound)
    reps = durable(whole.groupBy("_label", "vec").agg(F.count("*").alias("weight"), F.min(id_col).alias("m")))
    reps = durable(reps.withColumn("node", F.monotonically_increasing_id()).withColumn("grp", F.xxhash64("_label")))
    ids = durable(whole.join(reps.select("_label", "vec", "node"), ["_label", "vec"]).select(id_col, "node").unionByName(v.where(~sound).select(id_col, F.lit(None).cast("long").alias("node"))))
    found = durable(_links(_shards(reps, cosine), cosine))
    comps = connected_components(found.where("edge"))
    n = found.where("not edge").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("linked"))
    per = reps.select("node", "weight", "m").join(n, "node", "left").join(comps, "node", "left")
    per = durable(per.select("node", "m", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("c")))
    least = per.groupBy("c").agg(F.min("m").alias("component_id"))
    named = per.join(least, "c").select("node", "n_links", "component_id")
    out = ids.join(named, "node", "left")
    comp = F.coalesce(F.col("component_id"), F.col(id_col))
    return out.select(id_col, F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), comp.alias("component_id"), (F.col(id_col) == comp).alias("kept"))


def op9_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_embeddings": op9_embeddings}

ORACLE_SQL = {
    "op9_embeddings": r"""with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.93),
r as (select vec_id as n, vec_id as m from embeddings union select p.b, r.m from r join p on p.a = r.n),
c as (select n, min(m) as component_id from r group by n), k as (select a, count(*) as n_links from p group by a)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept from embeddings join c on c.n = vec_id left join k on k.a = vec_id"""
}
