"""Centroid clustering on bit planes: exact integer k-means by AND and popcount.

A vector of 64 integers is kept as one uint64 a bit plane: bit c of plane b is bit b of
component c in two's complement, so plane b weighs 2^b and the last one minus that. The
dot product of two vectors is the sum of popcount(P_i & C_j), weighted by both planes'
weights, and distances and sums of clusters follow from popcounts too, all in integers.

Vectors are packed once into the shared folder (some 100 bytes each); a round reads them
there, and what a task returns are the sums of its clusters, which are added up before
they reach the driver: clusters x components numbers a round, whatever the input.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, stored, table

SIZE = 64
SCALE = 1024
LONGEST = (1 << 63) - 1
#: Sums of a task go on as limbs of so many bits, so that adding up tasks stays within a long.
LIMB = 40


def integers(x: np.ndarray) -> np.ndarray:
    """floor(1024 x), exact: int64, or Python integers where a component is beyond 2^52."""
    if not x.size or np.abs(x).max() < 2.0**52:
        return np.floor(x * SCALE).astype(np.int64)
    flat = [int(v) * SCALE if abs(v) >= 2.0**52 else math.floor(v * SCALE) for v in x.ravel().tolist()]
    return np.array(flat, dtype=object).reshape(x.shape)


def planes(q: np.ndarray) -> np.ndarray:
    """Rows of as many uint64 planes as the widest integer of q (rows of 64) needs."""
    if not len(q):
        return np.zeros((0, 1), np.uint64)
    width = max(int(q.max()), -int(q.min()) - 1).bit_length() + 1
    bits = [((q >> b) & 1).astype(np.uint8) for b in range(width)]
    return np.stack([np.packbits(b, axis=1, bitorder="little").view("<u8")[:, 0] for b in bits], axis=1)


def weights(width: int) -> list[int]:
    return [1 << b for b in range(width - 1)] + [-(1 << (width - 1))]


def dots(p: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact dot products of the vectors p (n x planes) with other: one vector's planes, or n x planes to go row by row."""
    a, b = weights(p.shape[1]), weights(other.shape[-1])
    wide = len(a) + len(b) + 5 > 62
    out = np.zeros(len(p), object if wide else np.int64)
    for j, wj in enumerate(b):
        plane = other[..., j]
        for i, wi in enumerate(a):
            ones = np.bitwise_count(p[:, i] & plane)
            out += ones.astype(out.dtype) * (wi * wj)
    return out


def nearest(p: np.ndarray, centroids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance less the vector's own square) of each row; ties go to the smaller number."""
    cost = [dots(c[None, :], c)[0] - 2 * dots(p, c) for c in centroids]
    best, at = cost[0].copy(), np.zeros(len(p), np.int32)
    for k, c in enumerate(cost[1:], 1):
        less = (c < best).astype(bool)
        best = np.where(less, c, best)
        at[less] = k
    return at, best


def by_width(column: pa.Array):
    """(rows, their planes) for each number of planes among the binaries of a column."""
    sizes = np.array([len(x) for x in column.to_pylist()])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        raw = b"".join(column.take(pa.array(rows)).to_pylist())
        yield rows, np.frombuffer(raw, "<u8").reshape(len(rows), size // 8)


def limbs(value: int) -> list[int]:
    """value in base 2^LIMB; only the last limb has a sign."""
    out = []
    while not -(1 << LIMB) <= value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def packed(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (id_col, planes) of kept vectors."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
        p = planes(integers(x))
        return pa.record_batch([b.column(0), pa.array([r.tobytes() for r in p.astype("<u8")], pa.binary())], names=[id_col, "planes"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return batches(vectors.select(id_col, vec_col), f"{id_col} {kind}, planes binary", batch)


def cluster_sums(bits: DataFrame, centroids: list[np.ndarray]) -> dict[tuple[int, int], int]:
    """(cluster, component) to the exact sum of its vectors; component -1 has their number."""

    def task(it):
        counts: dict[int, np.ndarray] = {}
        number = np.zeros(len(centroids), np.int64)
        for b in it:
            for _, p in by_width(b.column(0)):
                at, _ = nearest(p, centroids)
                ones = np.unpackbits(p.view(np.uint8), axis=1, bitorder="little")
                have = counts.setdefault(p.shape[1], np.zeros((len(centroids), ones.shape[1]), np.int64))
                for k in range(len(centroids)):
                    mine = at == k
                    have[k] += ones[mine].sum(axis=0, dtype=np.int64)
                    number[k] += int(mine.sum())
        rows = [(k, -1, 0, int(n)) for k, n in enumerate(number) if n]
        for k in np.flatnonzero(number).tolist():
            for c in range(SIZE):
                total = sum(w * int(have[k, i * SIZE + c]) for width, have in counts.items() for i, w in enumerate(weights(width)))
                rows += [(k, c, i, v) for i, v in enumerate(limbs(total))]
        if rows:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["k", "c", "i", "s"])

    parts = bits.select("planes").mapInArrow(task, "k int, c int, i int, s long")
    out: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("k", "c", "i").agg(F.sum("s").alias("s")).collect():
        out[r.k, r.c] = out.get((r.k, r.c), 0) + (r.s << (LIMB * r.i))
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8, rounds: int = 10, seed: str = "3:") -> DataFrame:
    """Rows (id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256), one a kept vector.

    Kept are vectors of exactly 64 components, none null, NaN or infinite; others have no
    row. Repeated ids and vectors are rows of their own; among equal ids the smaller vector
    is the earlier seed, and rows without an id are clustered but seed last. Fewer than k
    vectors make fewer centroids; an empty table gives no rows. Other columns are not read.
    Components of any size are clustered exactly; where a squared distance or an inertia
    passes a long's range (components from about 2^17 on), the column holds 2^63 - 1.
    """
    x = vectors.select(F.col(id_col), F.col(vec_col).cast("array<double>").alias("_x"))
    fine = F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    kept = x.where((F.size("_x") == SIZE) & fine)
    bits = stored(packed(kept, id_col, "_x"), "planes")
    first = kept.orderBy(F.sha2(F.concat(F.lit(seed), F.col(id_col).cast("string")), 256).asc_nulls_last(), "_x").limit(k).collect()
    values = [[int(v) for v in integers(np.array([r["_x"]]))[0]] for r in first]

    def as_planes() -> list[np.ndarray]:
        return [planes(np.array([v], dtype=object if max(map(abs, v)) >= 1 << 62 else np.int64))[0] for v in values]

    for _ in range(rounds if values else 0):
        sums = cluster_sums(bits, as_planes())
        for c in range(len(values)):
            if n := sums.get((c, -1)):
                values[c] = [sums[c, i] // n for i in range(SIZE)]
    final = as_planes()

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        at, far = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int64)
        for rows, p in by_width(b.column(1)):
            at[rows], rest = nearest(p, final)
            far[rows] = np.minimum(rest + dots(p, p), LONGEST).astype(np.int64)
        return pa.record_batch([b.column(0), pa.array(at), pa.array(far)], names=[id_col, "cluster", "distance"])

    kind = x.schema[id_col].dataType.simpleString()
    out = stored(batches(bits, f"{id_col} {kind}, cluster int, distance long", batch), "clusters")
    each = {r[0]: int(r[1]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    total = min(sum(each.values()), LONGEST)
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in values]
    facts = [(c, min(n, LONGEST), total, sha[c]) for c, n in sorted(each.items())]
    named = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(named), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 8, rounds: int = 10, seed: str = "3:") -> str:
    """The same rounds one after the other, over rows of (vector, component)."""
    out = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}' || vec_id), r) - 1 AS c, q FROM v QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        out.append(
            f"""d{i} AS (SELECT v.r, c.c, CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{i} c)"""
        )
        out.append(f"a{i} AS MATERIALIZED (SELECT r, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if i < rounds:
            out.append(f"u{i} AS (SELECT a.c, unnest(range(1, {SIZE + 1})) AS j, unnest(v.q) AS x FROM a{i} a JOIN v USING (r))")
            out.append(f"s{i} AS (SELECT c, j, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM u{i} GROUP BY c, j)")
            out.append(f"m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS q FROM s{i} GROUP BY c)")
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m USING (c))")
    last = rounds
    return "WITH " + ",\n".join(out) + f"""
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{last} a JOIN v USING (r) JOIN c{last} c ON c.c = a.c"""


QUERIES = {"op11_centroids": op11_centroids}
ORACLE_SQL = {"op11_centroids": _sql()}
