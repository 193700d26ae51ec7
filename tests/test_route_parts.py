"""Routes planted in overlapping pieces over several sources are whole again."""

from __future__ import annotations

import random

from meridian.operators import route_parts

KIND = "route long, part int, stops array<struct<id:long,x:long,y:long>>"


def test_planted_splits(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for route in range(25):
        n = rng.randrange(2, 40)
        whole = [(route * 100 + k + 1, k * 100, route) for k in range(n)]
        cuts = sorted({0, n, *rng.sample(range(1, n), min(n - 1, rng.randrange(0, 12)))})
        # each piece runs on into the next by a stop or more, so that neighbours share one
        pieces = [whole[a : min(n, b + rng.randrange(1, 4))] for a, b in zip(cuts, cuts[1:], strict=False)]
        pieces += rng.choices(pieces, k=2) + [whole[:1]]
        rng.shuffle(pieces)
        rows += [(route, k, p) for k, p in enumerate(pieces)]
        want[route] = [s[0] for s in whole]
    # all parts of one route share a stop
    rows += [(99, k, [(5000 + k, 0, 0), (1, 1, 1), (6000 + k, 2, 2)]) for k in range(30)]
    got = route_parts.join_parts(spark.createDataFrame(rows, KIND).repartition(3), 50).collect()
    assert {r.route: [s.id for s in r.stops] for r in got if r.route != 99} == want and sum(r.route == 99 for r in got) == 1
    assert len(got) == 26


def test_missing_ends(spark):
    a, b, c = [(1, 0, 0), (2, 10, 0), (-1, 20, 0)], [(-1, 22, 0), (3, 30, 0), (-1, 40, 0)], [(-1, 41, 1), (4, 50, 0)]
    rows = [(1, 0, c), (1, 1, a), (1, 2, b), (2, 0, a), (2, 1, [(-1, 200, 0), (9, 210, 0)]), (3, 0, [*a, *b[0:], *c]), (4, 0, None), (4, 1, [])]
    got = route_parts.join_parts(spark.createDataFrame(rows, KIND), 5).collect()
    ids = sorted((r.route, [s.id for s in r.stops]) for r in got)
    assert ids == [(1, [1, 2, 3, 4]), (2, [-1, 9]), (2, [1, 2, -1]), (3, [1, 2, 3, 4])]
    assert route_parts.join_parts(spark.createDataFrame([], KIND), 5).count() == 0


def test_longer_side_wins(spark):
    df = spark.createDataFrame([([(1, 0, 0), (2, 0, 0), (3, 0, 0)], [(7, 0, 0), (8, 0, 0), (2, 0, 0)])], "a array<struct<id:long,x:long,y:long>>, b array<struct<id:long,x:long,y:long>>")
    assert [s.id for s in df.select(route_parts.merged_at_stop(df.a, df.b).alias("m")).first().m] == [7, 8, 2, 3]
    assert [s.id for s in df.select(route_parts.merged_at_stop(df.b, df.a).alias("m")).first().m] == [7, 8, 2, 3]


def test_rounds_do_not_grow_with_routes(spark, monkeypatch):
    """three parts of a route are two matches, of however many routes; parts that meet no other are not matched again."""
    seen = []
    one = route_parts._round
    monkeypatch.setattr(route_parts, "_round", lambda pieces, *rest: seen.append(pieces.count()) or one(pieces, *rest))
    parts = [(r, k, [(r * 10 + s, s, s) for s in (1, 2, 3, 4, 5, 6, 7)[2 * k : 2 * k + 3]]) for r in range(200) for k in range(3)]
    got = route_parts.join_parts(spark.createDataFrame(parts + [(r, 0, [(1, 0, 0), (2, 0, 0)]) for r in range(200, 500)], KIND), 50).collect()
    assert len(got) == 500 and all([s.id for s in r.stops] == [r.route * 10 + s for s in range(1, 8)] for r in got if r.route < 200)
    assert seen == [900, 400]
