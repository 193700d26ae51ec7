"""Lines are thinned out as they come in order, not as one frame a tile."""

from __future__ import annotations

import random

from meridian.operators import labels


def test_thin_out_streams_tiles(spark):
    rng = random.Random(5)
    rows = [(t, k, rng.randrange(4), [(rng.randrange(-40, 40), rng.randrange(-40, 40)) for _ in range(rng.randrange(0, 4))]) for t in (0, 1, -7) for k in range(120)]
    got = labels.thin_out(spark.createDataFrame(rows, "tile long, id long, ord int, points array<struct<x:long,y:long>>"), 2, 10)
    want, count, last = {}, {}, {}
    for t, k, rank, points in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        cells = {(t, x // 10, y // 10) for x, y in points}
        want[t, k] = any(count.get(c, 0) < 2 or last.get(c) == rank for c in cells)
        for c in cells if want[t, k] else ():
            count[c], last[c] = count.get(c, 0) + 1, rank
    assert {(r.tile, r.id): r.drawn for r in got.collect()} == want and len(set(want.values())) == 2
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().sparkPlan().toString()
