"""Circles against numpy's least squares, exits against walking round a ring, turns against plain loops."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from meridian.operators import roundabouts as rb
from meridian.plans.q_rings import ORACLE_SQL, QUERIES

ROUTE = "route int, seq int, bearing_begin double, bearing_end double, roundabout boolean, n_attached int, attached array<double>, mini_begin boolean, mini_end boolean, clockwise boolean"
PIECE = "ring int, points array<struct<x:bigint,y:bigint>>"


def ring(r, cx, cy, radius, n, clockwise, noise):
    step = -1 if clockwise else 1
    a = [step * 2 * math.pi * i / n + r for i in range(n + 1)]
    return [(round(cx + (radius + random.uniform(-noise, noise)) * math.cos(t)), round(cy - (radius + random.uniform(-noise, noise)) * math.sin(t))) for t in a]


def test_circles_of_planted_rings(spark):
    random.seed(3)
    want, rows = {}, []
    for r in range(40):
        cx, cy, radius = random.randrange(2**31), random.randrange(2**31), random.randrange(200, 5000)
        pts = ring(r, cx, cy, radius, random.randrange(6, 40), r % 2 == 0, radius * 0.01)
        want[r] = (pts, cx, cy, radius)
        cut = len(pts) // 2
        # a ring in two pieces, the second before the first
        rows += [(r, pts[cut:]), (r, pts[: cut + 1])]
    got = {g["ring"]: g for g in rb.circles(spark.createDataFrame(rows, PIECE)).collect()}
    assert set(got) == set(want)
    for r, (pts, cx, cy, radius) in want.items():
        cut = len(pts) // 2
        p = np.array(pts + [pts[cut]], dtype=float) - [cx, cy]
        sol = np.linalg.lstsq(np.c_[2 * p, np.ones(len(p))], (p**2).sum(1), rcond=None)[0]
        g = got[r]
        rad = math.sqrt(sol[2] + sol[0] ** 2 + sol[1] ** 2)
        assert np.allclose([g["x"] - cx, g["y"] - cy, g["radius"]], [sol[0], sol[1], rad], atol=1e-2), r
        assert abs(g["radius"] - radius) < radius * 0.05
        assert g["clockwise"] == (r % 2 == 0) and g["n"] == len(p)
        d = np.hypot(p[:, 0] - sol[0], p[:, 1] - sol[1]) - rad
        assert math.isclose(g["spread"], math.sqrt((d**2).mean()), rel_tol=0.05, abs_tol=0.05)


def test_rings_without_a_circle(spark):
    rows = [(1, [(0, 0), (5, 5), (9, 9)]), (2, [(1, 1), (2, 3)]), (3, []), (4, None), (None, [(0, 10), (10, 0), (0, -10), (-10, 0), (None, 1)])]
    got = {g["ring"]: g for g in rb.circles(spark.createDataFrame(rows, PIECE)).collect()}
    assert set(got) == {1, 2, None}
    assert got[1]["radius"] is None and got[2]["x"] is None and got[2]["spread"] is None
    assert got[None]["n"] == 4 and abs(got[None]["radius"] - 10) < 1e-9 and abs(got[None]["x"]) < 1e-9 and got[None]["spread"] < 1e-6
    assert rb.circles(spark.createDataFrame([], PIECE)).collect() == []


def test_exits_are_those_a_driver_counts(spark):
    random.seed(5)
    rings, attached, passes, want = [], [], [], []
    for r in range(30):
        clockwise = [True, False, None][r % 3]
        rings.append((r, 0.0, 0.0, 100.0, clockwise))
        roads = {}
        for k in range(random.randrange(2, 9)):
            for _ in range(random.choice((1, 1, 1, 2))):
                t = random.randrange(3600) / 10
                roads.setdefault(k, []).append(t)
                attached += [(r, k, 100 * math.cos(math.radians(t)), -100 * math.sin(math.radians(t)))] * random.choice((1, 2))
        turn = lambda t, cw=clockwise: (-t) % 360 if cw else t % 360
        spots = sorted((turn(t), k) for k, ts in roads.items() for t in ts)
        for f in roads:
            for g in [*roads, 99]:
                at = next(i for i, s in enumerate(spots) if s[1] == f)
                n = next((j for j in range(1, len(spots) + 1) if spots[(at + j) % len(spots)][1] == g), None)
                passes.append((r, f, g, r * 1000 + f * 100 + g))
                want.append((r, f, g, r * 1000 + f * 100 + g, n))
    c = spark.createDataFrame(rings, "ring int, x double, y double, radius double, clockwise boolean")
    o = rb.in_driving_order(c, spark.createDataFrame(attached, "ring int, road_id int, x double, y double"))
    got = rb.exits(o, spark.createDataFrame(passes, "ring int, from_road int, to_road int, n_roads int"))
    assert got.columns == ["ring", "from_road", "to_road", "n_roads", "exit"]
    assert sorted(map(tuple, got.collect()), key=lambda t: t[:4]) == sorted(want, key=lambda t: t[:4])
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()


def diff(a, b):
    d = a - b
    while d > 180:
        d -= 360
    while d <= -180:
        d += 360
    return d


def plain(segs, left):
    out = []
    for i, s in enumerate(segs):
        p = segs[i - 1] if i else None
        turn = (None, None)
        if s[4] and not (p and p[4]):
            j, exits = i, 1
            while j < len(segs) and segs[j][4]:
                exits += segs[j][5] or 0
                j += 1
            last = segs[min(j, len(segs) - 1)]
            a = p and diff(last[2], p[3])
            turn = (exits, (-diff(s[2], last[3] + 180) if abs(a) > 120 else a) if p else None)
        elif p and not p[4] and not s[4] and p[8] and s[7] and s[6]:
            back, on, lefts = (p[2] - 180) % 360, s[2] % 360, 0
            for b in s[6]:
                b %= 360
                right = on < b < back if back > on else not back < b < on
                lefts += not right
            a = diff(s[2], p[3])
            cw = left if s[9] is None else s[9]
            turn = (1 + (lefts if cw else len(s[6]) - lefts), diff(s[2], p[3] + 180) if abs(a) > 120 else a)
        out.append((s[0], s[1], *turn))
    return out


def test_ring_turns_against_plain_loops(spark):
    random.seed(7)
    b = lambda: random.choice((True, False, None))
    deg = lambda: float(random.randrange(-180, 181, 5))
    rows = [(r, i, deg(), deg(), random.random() < 0.4 if random.random() < 0.9 else None, random.choice((None, 0, 1, 2)), random.choice((None, [], [deg() for _ in range(random.randrange(1, 4))])), random.random() < 0.8, random.random() < 0.8, b()) for r in range(120) for i in range(random.randrange(1, 9))]
    for left in (False, True):
        want = [w for r in range(120) for w in plain([x for x in rows if x[0] == r], left)]
        got = rb.ring_turns(spark.createDataFrame(rows, ROUTE), left_side=left).select("route", "seq", "exit", "ring_angle").collect()
        assert sorted(map(tuple, got), key=lambda t: t[:2]) == want
        assert sum(w[2] is not None for w in want) > 100
    assert rb.ring_turns(spark.createDataFrame([], ROUTE)).collect() == []


def test_sides_tell_left_from_right(spark):
    # driving north, roads to the east and west; going on to the north
    d = spark.createDataFrame([([90.0, 45.0, -90.0, None], 0.0, 0.0), (None, 0.0, 0.0), ([90.0], 0.0, -90.0)], "a array<double>, p double, c double")
    got = [tuple(r[0]) for r in d.select(rb.sides(F.col("a"), F.col("p"), F.col("c"))).collect()]
    assert got == [(1, 2), (0, 0), (0, 1)]


def test_ring_queries_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL) == {"ring_circles", "ring_exits", "ring_turns"}
