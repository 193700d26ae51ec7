"""Centroid clustering, the divergence audit and packing with cuts against plain versions, and their edges."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from meridian.llm import centroids, cut_packing, divergence, packing

BIG = float(np.float32(3.0e38))


def plain_clusters(rows, k=8, rounds=10, seed="3:"):
    """k-means in Python integers over (vec_id, embedding)."""
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    cents = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}{r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        mine = defaultdict(list)
        for _, v in kept:
            mine[near(v)[1]].append(v)
        for j, vs in mine.items():
            cents[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    return sorted(((i, near(v)[1], min(near(v)[0], centroids.LONGEST), hashlib.sha256(",".join(map(str, cents[near(v)[1]])).encode()).hexdigest()) for i, v in kept), key=repr)


def vectors(rng, n, scale=1.0):
    middles = [[rng.gauss(0, scale) for _ in range(64)] for _ in range(5)]
    return [[float(np.float32(m + rng.gauss(0, scale / 4))) for m in rng.choice(middles)] for _ in range(n)]


VEC = "vec_id long, embedding array<float>, label int, planes string, cluster int, _x int"


def made(spark, rows):
    return spark.createDataFrame([(i, v, 1, "p", 9, 0) for i, v in rows], VEC).repartition(3)


@pytest.mark.parametrize("case", ["plain", "ties", "edges", "few", "wide"])
def test_clusters(spark, case):
    rng = random.Random(5)
    rows = list(enumerate(vectors(rng, 60)))
    if case == "ties":
        rows = [(i, [float(i % 2), 1.0] * 32) for i in range(40)]
    if case == "edges":
        bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [float("nan")] * 64, [float("inf")] + [0.0] * 63]
        rows += [(100 + i, v) for i, v in enumerate(bad)] + [rows[0], (None, rows[1][1]), (3, rows[7][1]), (200, [-0.0] * 64)]
    if case == "few":
        rows = rows[:3]
    if case == "wide":
        rows = rows[:30] + [(50, [BIG] * 64), (51, [-BIG] * 64), (52, [BIG, -BIG] * 32), (53, [float(2**40)] * 64)]
    got = centroids.cluster(made(spark, rows)).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got), key=repr) == plain_clusters(rows)
    per = Counter()
    for r in got:
        per[r.cluster] += r.distance
    assert all(r.cluster_inertia == min(per[r.cluster], centroids.LONGEST) and r.inertia == min(sum(min(v, centroids.LONGEST) for v in per.values()), centroids.LONGEST) for r in got)


def test_no_vectors(spark):
    assert centroids.cluster(made(spark, []).limit(0)).count() == 0
    assert centroids.cluster(made(spark, [(1, None), (2, [1.0])])).count() == 0


def test_plane_products():
    rng = np.random.default_rng(2)
    a, b = rng.integers(-900, 900, (50, 64)), rng.integers(-5000, 5000, 64)
    assert (centroids.dots(centroids.planes(a), centroids.planes(b[None])[0]) == a @ b).all()
    p = centroids.planes(a)
    assert (centroids.dots(p, p) == (a * a).sum(axis=1)).all()
    assert all(sum(v << (centroids.LIMB * i) for i, v in enumerate(centroids.limbs(x))) == x for x in (0, -1, 1 << 40, -(1 << 90) + 7, (1 << 200) - 1))


def plain_audit(docs, least=30, top=50):
    """The audit with dense loops over exact integers."""
    docs = [(t or "", a or "", b or "") for t, a, b in docs]
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(fold)) for t, _, _ in docs]
    out = []
    for lang in {a for _, a, _ in docs}:
        df, count, sources = Counter(), defaultdict(Counter), set()
        for (_, a, b), w in zip(docs, words, strict=True):
            if a == lang:
                df.update(set(w))
                count[b].update(w)
                sources.add(b)
        kept = [t for t, n in df.items() if n >= least]

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        of = {s: shares(count[s]) for s in sources}
        whole = shares(sum(count.values(), Counter()))
        for s in sources:
            pair = [(-sum(abs(of[s][t] - of[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(whole[t] - of[s][t], t.encode()) for t in kept if count[s][t] and of[s][t] > whole[t]]
            for part, rows, most in (("pair", pair, len(pair)), ("term", term, top)):
                out += [(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(sorted(rows)[:most], 1)]
    return sorted(out)


DOCS = "doc_id long, text string, lang string, source string, terms string, i int, n int, block int, p double, code int"


def documents(spark, rows):
    return spark.createDataFrame([(k, *r, "t", 1, 2, 3, 0.5, 4) for k, r in enumerate(rows)], DOCS)


def spoken(rng, n):
    words = ["The", "the", "Äpfel", "ÄPFEL", "naïve", "東京", "a1b", "x_y", "don't", "zz top", "Straße", "I", "é", "und", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "de", "", None, "x\0y"]), rng.choice(["a", "b", "B", "ä", None, "hot", "hot"])
        rows.append((" ".join(rng.choices(words, weights=[1 + 3 * (hash((w[0] * 3, source is None)) % 2) for w in words], k=rng.randrange(0, 40))), lang, source))
    return rows + [(None, "en", "a"), ("", "en", "empty"), (" 123 ", "rare", "s"), ("one two", "rare", "t"), ("same same", "en", "a"), ("same same", "en", "a"), ("long text " * 40_000, "en", "hot")]


@pytest.mark.parametrize("shards,block,tile", [(1 << 19, 1 << 20, 64), (7, 16, 2)])
def test_audit(spark, shards, block, tile, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", tile)
    rows = spoken(random.Random(3), 900)
    got = divergence.audit(documents(spark, rows).repartition(5), shard_terms=shards, block=block).collect()
    want = plain_audit(rows)
    assert len(want) > 200 and any(r[2] == "pair" and r[4] == 0 for r in want)
    assert sorted(map(tuple, got)) == want


def test_audit_without_terms(spark):
    assert divergence.audit(documents(spark, []).limit(0)).count() == 0
    got = divergence.audit(documents(spark, [("a b", "en", "s"), (None, "en", "t"), (None, None, None)])).collect()
    assert sorted(map(tuple, got)) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def checked(rows, ids_of, capacity):
    """rows hold every id of every document once, gapless, in sequences that are full or have a power of two of tokens; gives the number of pieces."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == ids_of.keys()
    for doc, mine in by_doc.items():
        at = 0
        for r in sorted(mine, key=lambda r: r.start):
            raw = np.array(ids_of[doc][at : at + r.length], dtype="<u4").tobytes()
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(raw), len(ids_of[doc])) and r.length > 0
            at += r.length
        assert at == len(ids_of[doc])
    for mine in by_seq.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and at & (at - 1) == 0
    return len(rows)


def ids_by_file(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    return {i: [*(t.encode(x, add_special_tokens=False).ids if x else ()), 0] for i, x in rows}


@pytest.mark.parametrize("shard", [1 << 22, 3000])
def test_cut_packing(spark, sf_dir, shard):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = ids_by_file([(r.doc_id, r.text) for r in docs.collect()])
    got = cut_packing.pack(docs.repartition(3), packing.tokenizer_path(), shard_tokens=shard).collect()
    n = checked(got, ids, 1024)
    short = {d: len(x) % 1024 for d, x in ids.items()}
    needed = sum(len(x) // 1024 + (len(x) % 1024 > 0) for x in ids.values())
    whole = sum(r.length == short[r.doc_id] for r in got)
    assert shard < 1 << 22 or n - needed <= 0.2 * needed and whole > 0.7 * sum(v > 0 for v in short.values())  # most short pieces stay whole


def test_cut_packing_edges(spark):
    rows = [(1, None), (2, ""), (3, "<|endoftext|> a"), (4, "lorem ipsum " * 30_000), (5, "same"), (6, "same"), (7, "Ä東\U0001f600")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, start int, length int, offset int").coalesce(1)
    checked(cut_packing.pack(docs, packing.tokenizer_path()).collect(), ids_by_file(rows), 1024)
    assert cut_packing.pack(docs.limit(0), packing.tokenizer_path()).count() == 0
    twice = cut_packing.pack(spark.createDataFrame([(None, "a b"), (None, "a b"), (8, "c"), (8, "c")], "doc_id long, text string"), packing.tokenizer_path()).collect()
    assert Counter(r.doc_id for r in twice) == {None: 2, 8: 2} or sum(r.length for r in twice) == 10


def test_patterns_fill_windows():
    pool = cut_packing.Pool()
    rng = random.Random(1)
    for d in range(3000):
        pool.put(rng.randrange(1, 1024), (d, 0))
    full = cut_packing.by_patterns(pool, 1024)
    assert all(sum(n for *_, n in seq) == 1024 for seq in full) and sum(map(len, full)) > 1200
    left = sum(n * pool.count(n) for n in pool.lengths)
    rest = list(cut_packing.sequences(pool, 1024, last=True))
    assert sum(n for seq in rest for *_, n in seq) == left and not pool.lengths
