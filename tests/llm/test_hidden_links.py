"""Links that a forest of candidates leaves out, where one of its own does not stand."""

from __future__ import annotations

import random

import pytest

from meridian.llm import simhash

from test_brute import least_reachable


@pytest.mark.parametrize("hot", [8, 1 << 17])
def test_pairs_apart(spark, monkeypatch, hot):
    """Every pair of unequal labels is told, equal fingerprints' too, and once."""
    monkeypatch.setattr(simhash, "HOT_PAIR", hot)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 6))) for b in base for _ in range(60)]
    label = [rng.randrange(5) if i % 3 else 5 for i in range(len(near))]
    df = spark.createDataFrame([(1, x - (1 << 64) if x >> 63 else x, i, v) for i, (x, v) in enumerate(zip(near, label))], "seed int, fp long, node long, label long")
    for budget in (3, 7):
        got = [(r.a, r.b) for r in simhash.pairs_apart(df, budget, "fp", "seed", "node", "label").collect()]
        want = {(i, j) for j in range(len(near)) for i in range(j) if label[i] != label[j] and (near[i] ^ near[j]).bit_count() <= budget}
        assert len(got) == len(set(got)) and set(got) == want


def test_no_link_is_hidden(spark):
    """Texts that one phrase rules have one fingerprint, whatever else they say: those that say the same link, though the first of them says something else."""
    rng = random.Random(4)
    t = {}
    for f in range(8):
        tail = [f"w{rng.randrange(3000)}" for _ in range(90)]
        for k in range(3):
            t[10 * f + k] = " ".join(["over and over and again"] * 400 + tail + [f"end{k}"])
    ids = sorted(t)
    sets = {k: simhash.shingles(x) for k, x in t.items()}
    assert len({tuple(simhash.seeded(x, 5, simhash.SEEDS)) for x in t.values()}) == 1
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = least_reachable(ids, pairs)
    d = spark.createDataFrame(list(t.items()), "doc_id long, text string")
    assert len(set(want.values())) == 8
    assert {r.doc_id: r.component_id for r in simhash.near_under_any(d, (42, 43), similarity=0.8).collect()} == want
