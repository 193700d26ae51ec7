"""Links of fingerprints that labels already join."""

from __future__ import annotations

import random

from meridian.llm import simhash

from test_brute import least_reachable


def test_links_leave_out_equal_labels(spark):
    """A large group of near copies that one label holds costs no links, and what labels and links join stays the same."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    near = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 6))) for b in base for _ in range(60)})
    signed = [x - (1 << 64) if x >> 63 else x for x in near]
    at = {x: i for i, x in enumerate(signed)}
    home = [min(range(6), key=lambda k: (x ^ base[k]).bit_count()) for x in near]
    # groups 0 to 3 are joined whole, 4 in halves, 5 not at all
    label = [h if h < 4 else 10 + i % 2 if h == 4 else None for i, h in enumerate(home)]
    df = spark.createDataFrame([(0, x, v) for x, v in zip(signed, label)], "seed int, fp long, label long")
    got = [(at[r.a], at[r.b]) for r in simhash.links(df, 7, seed_col="seed", label_col="label").collect()]
    assert got and not any(label[a] is not None and label[a] == label[b] for a, b in got)
    same = [(i, j) for i in range(len(near)) for j in range(i) if label[i] is not None and label[i] == label[j]]
    plain = [(i, j) for i in range(len(near)) for j in range(i) if (near[i] ^ near[j]).bit_count() <= 7]
    assert least_reachable(range(len(near)), got + same) == least_reachable(range(len(near)), plain + same)
