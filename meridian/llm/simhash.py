"""SimHash near-duplicates: 64-bit fingerprints of word shingles and a binary-trie self-join.

Fingerprints are made once per document in Arrow batches; everything after works on
distinct fingerprints, so copies cost nothing. Two fingerprints within three bits
agree on at least one of four 16-bit blocks: each block in turn is rotated to the top
and the fingerprints that share it form one subtree of that trie, which one task walks.
The walk goes over pairs of nodes, adds a bit of error where two nodes part, drops pairs
over the budget, and drops pairs whose leaves already lie in one component (only the
components are wanted, so a tight cluster of m fingerprints gives m - 1 links, not m²).
A subtree with many fingerprints is dealt out further: its next bits name cells, and each
pair of cells within the budget is a task of its own.

Near copies in the sense of word shingles (one_of_each) are found by fingerprints under
several seeds and a larger budget; a link stands only if the exact Jaccard similarity of
the two texts' sets of shingles is SIMILARITY or more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, connected_components, durable, release, stored, table

BLOCKS = 4
#: Seeds under which one_of_each() looks for near copies.
SEEDS = (42, 43, 44, 45, 46, 47)
#: Exact Jaccard similarity that a link of one_of_each() has.
SIMILARITY = 0.8
#: Seeds under which all pairs between components are sought in one shuffle.
SEEDS_AT_ONCE = 3
#: Pairs of one text that are verified in one task.
STAR = 256
BLOCK_BITS = 16
#: Distinct fingerprints of one block value beyond which its subtree is dealt out as pairs of cells.
HOT_SUBTREE = 1024
#: The same within a budget of four to seven: pairs of subtrees one bit apart of which either is larger are dealt out.
HOT_PAIR = 1 << 16
CELL_BITS = 6
#: Pairs of nodes with so few pairs of leaves are compared leaf by leaf.
LEAF_PAIRS = 64


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash; null or wordless text: 0. Fewer words than a shingle: the whole sequence is one."""
    return seeded(text, words, (seed,))[0]


def seeded(text: str | None, words: int, seeds: tuple[int, ...]) -> list[int]:
    """fingerprint() under each seed; the shingles are made once."""
    toks = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not toks:
        return [0] * len(seeds)
    n = max(1, len(toks) - words + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    bits = np.zeros((len(seeds), 64), np.int64)
    for at in range(0, n, 1 << 16):  # a very long text in pieces
        shingles = [join(toks[i : i + words]) for i in range(at, min(n, at + (1 << 16)))]
        for k, seed in enumerate(seeds):
            h = np.array([digest(s, seed) for s in shingles], dtype="<u8")
            bits[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(bits * 2 > n, axis=1, bitorder="little").view("<u8").ravel().tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """Rows (id_col, fp, fp1, ...): the fingerprint's bits as a signed long, one for each seed. One row in, one row out."""
    names = ["fp", *(f"fp{k}" for k in range(1, len(seeds)))]

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([seeded(t, words, seeds) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        return pa.record_batch([b.column(0), *(pa.array(fps[:, k]) for k in range(len(seeds)))], names=[id_col, *names])

    return batches(docs.select(id_col, text_col), f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {', '.join(f'{n} long' for n in names)}", batch)


def _fingerprints_of(keyed: DataFrame, seeds: tuple[int, ...], words: int) -> DataFrame:
    """Rows (_id, _md5, fp, fp1, ...) of rows (_id, _text, _md5)."""
    names = ["fp", *(f"fp{k}" for k in range(1, len(seeds)))]

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([seeded(t, words, seeds) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        return pa.record_batch([b.column(0), b.column(2), *(pa.array(fps[:, k]) for k in range(len(seeds)))], names=["_id", "_md5", *names])

    return batches(keyed.select("_id", "_text", "_md5"), f"_id {keyed.schema['_id'].dataType.simpleString()}, _md5 string, {', '.join(f'{n} long' for n in names)}", batch)


class _Forest:
    """Union by smallest index over numpy arrays of pairs; edges are the pairs that joined something."""

    def __init__(self, n: int):
        self.root = np.arange(n, dtype=np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self._pick = np.empty(n, np.int64)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        r = self.root
        while len(i):
            a, b = r[i], r[j]
            keep = a != b
            if not keep.any():
                return
            i, j, a, b = i[keep], j[keep], a[keep], b[keep]
            hi, lo = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(r, hi, lo)
            k = np.flatnonzero(r[hi] == lo)
            self._pick[hi[k]] = k  # one of the pairs that hang a root where it goes
            k = k[self._pick[hi[k]] == k]
            self.edges.append((i[k], j[k]))
            while True:
                s = r[r]
                if np.array_equal(s, r):
                    break
                r[:] = s


def trie_join(keys: np.ndarray, lo1, hi1, lo2, hi2, err, depth: int, budget: int, chunk: int = 1 << 16) -> _Forest:
    """A forest of the keys linked within the budget, by walking pairs of trie nodes as trie_pairs() does. Nearer pairs are joined first."""
    forest = _Forest(len(keys))
    for i, j, off in trie_pairs(keys, lo1, hi1, lo2, hi2, err, depth, budget, forest.root, chunk):
        for bits in range(budget + 1):
            k = off == bits
            forest.join(i[k], j[k])
    return forest


def trie_pairs(keys: np.ndarray, lo1, hi1, lo2, hi2, err, depth: int, budget: int, root: np.ndarray, chunk: int = 1 << 16):
    """Arrays (i, j, bits apart) of the pairs of keys within the budget, by walking pairs of trie nodes.

    keys: uint64, sorted inside each node. A node is a range of keys that agree on
    their first depth bits; pair k is nodes [lo1, hi1) and [lo2, hi2) with err[k] bits
    apart so far (the same range twice: a node with itself). Pairs of nodes all of whose keys
    have one root are passed over; the caller may join roots as it goes. Frontiers are walked
    depth first in chunks, so memory follows the chunk, not the number of pairs.
    """
    start = [np.asarray(x, dtype=np.int64) for x in (lo1, hi1, lo2, hi2, err)]
    stack = [(depth, [x[k : k + chunk] for x in start]) for k in range(0, len(start[0]), chunk)][::-1]
    while stack:
        d, (a0, a1, b0, b1, e) = stack.pop()
        # a pair of nodes that already hang together wholly has nothing to add
        change = np.concatenate(([0], np.cumsum(root[1:] != root[:-1]))) if len(root) else root
        one = (change[a0] == change[a1 - 1]) & (change[b0] == change[b1 - 1]) & (root[a0] == root[b0])
        same = (a0 == b0) & (a1 == b1)
        live = (~one) & ((~same) | (a1 - a0 > 1))
        a0, a1, b0, b1, e, same = (x[live] for x in (a0, a1, b0, b1, e, same))
        if not len(a0):
            continue
        leaf = ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS) | (d >= 64)
        if leaf.any():
            n1, n2 = (a1 - a0)[leaf], (b1 - b0)[leaf]
            sizes = n1 * n2
            ends = np.cumsum(sizes)
            for k in _cuts(ends, 1 << 20):
                s = sizes[k]
                off = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s)
                w = np.repeat(n2[k], s)
                i, j = np.repeat(a0[leaf][k], s) + off // w, np.repeat(b0[leaf][k], s) + off % w
                off = np.bitwise_count(keys[i] ^ keys[j])
                near = np.flatnonzero((off <= budget) & (i != j))
                yield i[near], j[near], off[near]
        a0, a1, b0, b1, e, same = (x[~leaf] for x in (a0, a1, b0, b1, e, same))
        if not len(a0):
            continue
        am, bm = _split(keys, a0, a1, d), _split(keys, b0, b1, d)
        kids = [(a0, am, b0, bm, e), (am, a1, bm, b1, e), (a0, am, bm, b1, e + 1), (am[~same], a1[~same], b0[~same], bm[~same], e[~same] + 1)]
        nxt = []
        for k in kids[::-1]:  # nearer children last, so they are walked first
            ok = (k[0] < k[1]) & (k[2] < k[3]) & (k[4] <= budget)
            nxt.append([x[ok] for x in k])
        for k in nxt:
            for c in range(0, len(k[0]), chunk):
                stack.append((d + 1, [x[c : c + chunk] for x in k]))


def _cuts(ends: np.ndarray, most: int):
    """Slices of a cumulated size, each of about most in total."""
    at, n = 0, len(ends)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield slice(at, to)
        at = to


def _split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: int) -> np.ndarray:
    """The first index in each sorted range whose bit d (from the top) is set: all ranges bisect together."""
    lo, hi, bit = lo.copy(), hi.copy(), np.uint64(63 - d)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        one = ((keys[np.minimum(mid, len(keys) - 1)] >> bit) & np.uint64(1)).astype(bool)
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


def _rotate(fp, block: int):
    k = BLOCK_BITS * block
    return fp if k == 0 else F.shiftleft(fp, k).bitwiseOR(F.shiftrightunsigned(fp, 64 - k))


def _dealt(fps: DataFrame, budget: int, fp_col: str, seed_col: str | None, *also: str) -> DataFrame:
    """Rows (cell, r, also...): rotated fingerprints, dealt to cells that hold every pair within the budget.

    A cell is the seed and block, the values c <= d of that block on its two sides, and, for
    a subtree that is dealt out further, one plus the pair of its next bits' values (else 0),
    packed into a long whose last bit is the side.
    """
    if not 0 <= budget < 2 * BLOCKS:
        raise ValueError("budget must be 0 to 7")
    fp = F.col(fp_col)
    seed = F.col(seed_col) if seed_col else F.lit(0)
    rot = F.explode(F.array(*[F.struct((seed * BLOCKS + b).alias("b"), _rotate(fp, b).alias("r")) for b in range(BLOCKS)])).alias("x")
    label = [f"_{k}" for k in range(len(also))]
    rows = fps.select(rot, *[F.col(c).alias(n) for c, n in zip(also, label, strict=True)]).select("x.b", "x.r", F.shiftrightunsigned("x.r", 64 - BLOCK_BITS).cast("int").alias("top"), *label)
    # at most BLOCKS << BLOCK_BITS rows a seed
    sizes = rows.groupBy("b", "top").agg(F.count("*").alias("n"))
    one = F.col("top") == F.col("t")
    if budget < BLOCKS:  # some block is the same
        sized = durable(rows.join(sizes.where("n > 1"), ["b", "top"])).withColumn("t", F.col("top"))
        hot = F.col("n") > HOT_SUBTREE
    else:  # some block is one bit off at most
        flips = F.explode(F.array(*[F.col("top").bitwiseXOR(m) for m in (0, *(1 << k for k in range(BLOCK_BITS)))])).alias("t")
        # at most BLOCKS subtrees this large for every HOT_PAIR fingerprints, and BLOCKS << BLOCK_BITS in all, a seed
        big = durable(sizes.where(F.col("n") > HOT_PAIR).select("b", "top"))
        own = F.broadcast(big.withColumn("big", F.lit(True)))
        other = F.broadcast(big.select("b", F.col("top").alias("t"), F.lit(True).alias("big_t")))
        sized = rows.select("b", "r", "top", flips, *label).join(own, ["b", "top"], "left").join(other, ["b", "t"], "left")
        hot = F.coalesce("big", "big_t", F.lit(False))
    s = F.shiftrightunsigned("r", 64 - BLOCK_BITS - CELL_BITS).bitwiseAND((1 << CELL_BITS) - 1).cast("int")
    near = F.array(*[s.bitwiseXOR(m) for m in range(1 << CELL_BITS) if m.bit_count() <= budget])
    u = F.explode(F.when(hot, near).otherwise(F.array(F.lit(-1)))).alias("u")
    rows = sized.select("b", "r", "top", "t", s.alias("s"), u, *label)
    split = F.col("u") >= 0
    # inside a subtree the cell with the smaller number is the first side, across two subtrees the smaller subtree
    first = F.when(one, F.least("s", "u")).when(F.col("top") < F.col("t"), F.col("s")).otherwise(F.col("u"))
    pair = F.when(split, first * (1 << CELL_BITS) + F.col("s") + F.col("u") - first + 1).otherwise(0)
    side = F.when(one, split & (F.col("s") > F.col("u"))).otherwise(F.col("top") > F.col("t")).cast("long")
    packed = ((F.col("b").cast("long") * (1 << BLOCK_BITS) + F.least("top", "t")) * (1 << BLOCK_BITS) + F.greatest("top", "t")) * (1 << _PAIR_BITS) + pair
    return rows.select((packed * 2 + side).alias("cell"), "r", *label)


_PAIR_BITS = 2 * CELL_BITS + 1


def links(fps: DataFrame, budget: int = 3, fp_col: str = "fp", seed_col: str | None = None, label_col: str | None = None) -> DataFrame:
    """A spanning forest, task by task, of distinct fingerprints within budget bits: rows (a, b), each such a pair.

    With a column of small seed numbers, fingerprints meet those of their own seed: rows (seed, a, b).
    Every pair within the budget is joined by a path of rows. With a column of labels (longs
    from 0, or null), rows between equal labels are left out, so a path may go through a label. Up to three bits, one of
    four blocks agrees; up to seven, one is a single bit off at most. A larger budget
    raises ValueError.
    """

    def emit(cell, r, label=None):
        keys = r.view(np.uint64)
        for b, start in _met(cell, budget):
            for i, j in trie_join(keys, *start, budget).edges:
                if label is not None:
                    new = (label[i] != label[j]) | (label[i] < 0)
                    i, j = i[new], j[new]
                turn = (b[i] % BLOCKS * BLOCK_BITS).astype(np.uint64)
                back = (np.uint64(64) - turn) % np.uint64(64)
                x, y = (np.where(turn == 0, v, (v >> turn) | (v << back)).view(np.int64) for v in (keys[i], keys[j]))
                yield pa.record_batch([pa.array(b[i] // BLOCKS), pa.array(x), pa.array(y)], names=["seed", "a", "b"])

    out = _by_cells(_dealt(fps, budget, fp_col, seed_col, *([label_col] if label_col else [])), emit, "seed long, a long, b long")
    return out if seed_col else out.select("a", "b")


def pairs_apart(nodes: DataFrame, budget: int, fp_col: str, seed_col: str, node_col: str, label_col: str) -> DataFrame:
    """Every pair (a, b), a < b, of nodes with unequal labels whose fingerprints under a seed are within budget bits; once for each such seed.

    nodes: rows with a fingerprint, a small seed number, and longs from 0 that name node and label.
    A pair meets in as many cells as it has blocks that are near enough, and is told in the first of them.
    """

    def emit(cell, r, node, label):
        keys = r.view(np.uint64)
        root = np.unique(label, return_inverse=True)[1]
        for b, start in _met(cell, budget):
            for i, j, _ in trie_pairs(keys, *start, budget, root):
                k = (i < j) & (root[i] != root[j])  # a node met with itself has each pair twice
                i, j = i[k], j[k]
                off, own, first = keys[i] ^ keys[j], b[i] % BLOCKS, np.ones(len(i), bool)
                for n in range(1, BLOCKS):  # a block before the cell's own lies to the right of it, the nearest last
                    ahead = np.bitwise_count((off >> np.uint64(BLOCK_BITS * (n - 1))) & np.uint64((1 << BLOCK_BITS) - 1))
                    first &= (n > own) | (ahead > (0 if budget < BLOCKS else 1))
                if first.any():
                    x, y = node[i[first]], node[j[first]]
                    yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return _by_cells(_dealt(nodes, budget, fp_col, seed_col, node_col, label_col), emit, "a long, b long")


def _met(cell: np.ndarray, budget: int):
    """(seed and block of each row, pairs of trie nodes to walk: lo1, hi1, lo2, hi2, err, depth) for the cells of sorted rows."""
    mask = (1 << CELL_BITS) - 1
    group, side = cell >> 1, cell & 1
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    end = np.r_[first[1:], len(cell)]
    mid = first + np.add.reduceat(1 - side, first)
    g = group[first]
    pair, d, c = g & ((1 << _PAIR_BITS) - 1), (g >> _PAIR_BITS) & 0xFFFF, (g >> (_PAIR_BITS + BLOCK_BITS)) & 0xFFFF
    b = group >> (_PAIR_BITS + 2 * BLOCK_BITS)
    s, t = (pair - 1) >> CELL_BITS & mask, (pair - 1) & mask
    twin = (c != d) | ((pair > 0) & (s != t))
    err = np.bitwise_count(c ^ d).astype(np.int64) + np.where(pair > 0, np.bitwise_count(s ^ t), 0)
    ok = np.where(twin, (mid > first) & (mid < end), end - first > 1) & (err <= budget)
    for deep, depth in ((pair == 0, BLOCK_BITS), (pair > 0, BLOCK_BITS + CELL_BITS)):
        k = np.flatnonzero(ok & deep)
        if len(k):
            f, n, m, w = first[k], end[k], mid[k], twin[k]
            yield b, (f, np.where(w, m, n), np.where(w, m, f), n, err[k], depth)


def _by_cells(dealt: DataFrame, emit, schema: str) -> DataFrame:
    """What emit makes of the rows of _dealt(): it gets their columns as arrays, whole cells in order."""
    dealt = dealt.repartition(F.shiftright("cell", 1)).sortWithinPartitions("cell", F.expr("r < 0"), "r")

    def run(it):
        held: list[np.ndarray] | None = None
        for batch in it:
            new = [batch.column(i).fill_null(-1).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            cur = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if not len(cur[0]):
                continue
            # the last group may go on in the next batch
            cut = int(np.searchsorted(cur[0], (cur[0][-1] >> 1) << 1))
            if cut >= 1 << 16:
                yield from emit(*[x[:cut] for x in cur])
                held = [x[cut:] for x in cur]
            else:
                held = cur
        if held is not None and len(held[0]):
            yield from emit(*held)

    return dealt.mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 3) -> DataFrame:
    """Rows (id_col, fingerprint, component_id) for every document.

    Null, empty or wordless texts have fingerprint zero and link as any other does.
    component_id is the smallest id reachable by links, the document's own included.
    Repeated rows share a fingerprint and so a component; a null id takes no part in a
    component's minimum and its row carries the component of its fingerprint. Columns
    other than the two named are not read.
    """
    fps = durable(fingerprints(docs, id_col, text_col, words))
    least = durable(fps.groupBy("fp").agg(F.min(id_col).alias("least")))
    comps = connected_components(links(least.select("fp"), budget))
    at = least.join(comps.select(F.col("node").alias("fp"), F.col("component").alias("c")), "fp", "left")
    at = durable(at.select("fp", "least", F.coalesce("c", "fp").alias("c")))
    ids = at.groupBy("c").agg(F.min("least").alias("component_id"))
    named = at.join(ids, "c").select("fp", "component_id")
    out = fps.join(named, "fp")
    return out.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles(text: str | None, words: int = 5) -> set[bytes]:
    """The set of word shingles of a text, ASCII case folded; of fewer words: the whole sequence; of none: empty."""
    toks = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(toks[i : i + words]) for i in range(max(1, len(toks) - words + 1))} if toks else set()


def similar(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts' sets of shingles have at least this Jaccard similarity; two without words have 1.

    texts: rows (node, text), one a node. A node with many partners is met in parts of STAR.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    own = parts.join(texts, F.col("a") == F.col("node")).select("a", "text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    both = both.join(texts.withColumnsRenamed({"node": "b", "text": "other"}), "b").join(own, ["a", "part"]).select("a", "b", "text", "other")

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        last, mine, keep = None, set(), []
        for a, text, other in zip(*(rows.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            if a != last:
                last, mine = a, shingles(text, words)
            theirs = shingles(other, words)
            met = len(mine & theirs)
            all_ = len(mine) + len(theirs) - met
            keep.append(met >= similarity * all_)
        return pa.record_batch([rows.column(0), rows.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return batches(both, "a long, b long", batch)


def near_under_any(docs: DataFrame, seeds: tuple[int, ...], id_col: str = "doc_id", text_col: str = "text", words: int = 5, budget: int = 7, similarity: float | None = None) -> DataFrame:
    """Rows (id_col, component_id) where documents link if their fingerprints under any of the seeds do.

    A pair whose bits happen to fall apart under one seed is found under another, which
    costs a pass of hashing and a join each, where a larger budget would cost the square
    of the corpus. With a similarity, only links between texts that have it stand: the
    links of the first seed's forest, nearest fingerprints first, are verified on the texts,
    then those of the other seeds between texts that are not joined yet, and last every pair
    under any seed whose texts are still apart, so a link that does not stand hides no other.
    component_id is the smallest id of a component. Rows with a null id have a component
    like any other and take no part in its minimum.
    """
    names = ["fp", *(f"fp{k}" for k in range(1, len(seeds)))]
    keyed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("_md5"))
    fps = durable(_fingerprints_of(keyed, seeds, words))
    nodes = durable(fps.groupBy("_md5").agg(F.min("_id").alias("least"), *[F.first(n).alias(n) for n in names]).withColumn("node", F.monotonically_increasing_id()))

    def met_under(these: list[str], done: DataFrame | None = None) -> DataFrame:
        """Pairs (a, b), each once; of those that done (node, component) has in one component none."""
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("seed"), F.col(n).alias("fp")) for k, n in enumerate(these)])).alias("s")
        long = nodes.select("node", each).select("node", "s.*")
        rep = durable(long.groupBy("seed", "fp").agg(F.min("node").alias("rep")))
        same = long.join(rep, ["seed", "fp"]).where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct()
        if done is None:
            met = links(rep.select("seed", "fp"), budget, seed_col="seed")
        else:
            x, y = (done.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in")) for c in ("a", "b"))
            same = same.join(x, "a", "left").join(y, "b", "left").where(F.coalesce("a_in", "a") != F.coalesce("b_in", "b")).select("a", "b")
            labelled = rep.join(done.select(F.col("node").alias("rep"), "component"), "rep", "left")
            met = links(labelled.select("seed", "fp", "component"), budget, seed_col="seed", label_col="component")
        # a pair is found in several cells, its fingerprints in either order
        met = met.select("seed", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        side = lambda c, to: rep.select("seed", F.col("fp").alias(c), F.col("rep").alias(to))
        met = met.join(side("a", "x"), ["seed", "a"]).join(side("b", "y"), ["seed", "b"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        return durable(same.unionByName(met).distinct())

    def verified(pairs: DataFrame) -> DataFrame:
        met = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "_md5"), "node")
        texts = stored(keyed.join(met, "_md5").groupBy("node").agg(F.first("_text").alias("text")), "simhash-texts")
        return durable(similar(pairs, texts, words, similarity))

    def apart(done: DataFrame, tested: DataFrame) -> DataFrame:
        """Pairs (a, b) of any seed between nodes that done does not have in one component, without those tested, each once."""
        at = durable(nodes.join(done, "node", "left").select("node", F.coalesce("component", "node").alias("label"), *names))
        out = tested.limit(0)
        for k in range(0, len(names), SEEDS_AT_ONCE):
            each = F.explode(F.array(*[F.struct(F.lit(i).alias("seed"), F.col(n).alias("fp")) for i, n in enumerate(names[k : k + SEEDS_AT_ONCE])])).alias("s")
            long = at.select("node", "label", each).select("node", "label", "s.*")
            out = durable(out.unionByName(pairs_apart(long, budget, "fp", "seed", "node", "label")).distinct())
            release(docs.sparkSession)
        return durable(out.join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))

    if similarity is None:
        edges = met_under(names)
    else:
        tested = met_under(names[:1])
        edges = verified(tested)
        # what is joined already needs no look under the other seeds
        done = connected_components(edges)
        release(docs.sparkSession)
        if len(names) > 1:
            more = met_under(names[1:], done)
            tested, edges = tested.unionByName(more), edges.unionByName(verified(more))
            done = connected_components(edges)
            release(docs.sparkSession)
        # a forest leaves out pairs that its other links join; where such a link has not stood, they are looked at one by one
        edges = edges.unionByName(verified(apart(done, tested)))
    release(docs.sparkSession)
    comps = connected_components(edges)
    named = nodes.join(comps, "node", "left").select("_md5", "least", F.coalesce("component", "node").alias("c"))
    named = durable(named)
    ids = named.groupBy("c").agg(F.min("least").alias("component_id"))
    return fps.select("_id", "_md5").join(named.join(ids, "c").select("_md5", "component_id"), "_md5").select(F.col("_id").alias(id_col), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, budget: int = 7, seeds: tuple[int, ...] = SEEDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs, with all columns, without those whose component has a smaller id; rows without an id stay.

    Documents are in a component if a chain of found pairs of at least this similarity
    joins them. Rows that repeat an id stay or go together. Empty and wordless texts are
    copies of each other.
    """
    comp = near_under_any(docs.where(F.col(id_col).isNotNull()), seeds, id_col, text_col, words, budget, similarity)
    gone = comp.where(F.col(id_col) != F.col("component_id")).select(id_col)
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash": op8_simhash}
