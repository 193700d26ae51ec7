"""Lanes against a plain reading of the same rules, one turn after the other from a route's end."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from meridian.functions.lanes import CODES, WORDS
from meridian.operators import lane_guidance as lg

C = CODES
WORD = [w for w in WORDS if w]


def code(names):
    return {C[n] for n in names}


def parse(text, main):
    out = []
    for part in text.split("|") if text else []:
        turns = []
        for w in part.split(";"):
            t = C[WORDS.get(w.strip(), "C")]
            side = t == main or any(main in code(g) and t in code(g) for g in (lg.LEFT, lg.RIGHT))
            if not turns:
                turns = [t]
            elif side:
                turns = [t, *turns][:3]
            elif len(turns) < 3:
                turns.append(t)
        out.append([turns, False])
    return out


def uniq(lanes):
    return list(dict.fromkeys(t for turns, _ in lanes for t in turns))


def span(lanes, left, right, before, now, leaving):
    d = uniq(lanes)
    if not lanes or left + right >= len(d):
        return None
    if 0 < now < before == now + leaving:
        if left == 0 and right > 0:
            return 0, now - 1, d[0]
        if left > 0 and right == 0:
            return len(lanes) - now, len(lanes) - 1, d[left] if left < len(d) else None
    a, b = d[left], d[len(d) - right - 1]
    return min(i for i, v in enumerate(lanes) if a in v[0]), max(i for i, v in enumerate(lanes) if b in v[0]), a


def allows(main, t, lo=True, hi=True):
    both = lambda names: main in code(names) and t in code(names)
    return t == main or both(set(lg.LEFT) - {"TU"}) or both(set(lg.RIGHT) - {"TRU"}) or (main == C["C"] and t in code(lg.SLIGHT)) or (lo and both(lg.SHARP_LEFT)) or (hi and both(lg.SHARP_RIGHT))


def lanes_for(lanes, s, main):
    ok = s and 0 <= s[0] <= s[1] < len(lanes) and any(allows(main, v[0][0], s[0] == 0, s[1] == len(lanes) - 1) for v in lanes[s[0] : s[1] + 1])
    return [[t, s[0] <= i <= s[1] and allows(main, t[0]) if ok else t[0] == main] for i, (t, _) in enumerate(lanes)]


def active_turn(lanes, old):
    tp = old
    for turns, on in lanes:
        if on:
            if allows(old, turns[0]):
                tp = turns[0]
            if old in code(lg.SHARP) and tp in code(lg.SHARP):
                break
    return tp


def swap(turns, t):
    k = turns.index(t)
    out = list(turns)
    out[0], out[k] = out[k], out[0]
    return out


def from_turn(lanes, turn):
    if not any(turn in t for t, _ in lanes):
        return lanes
    return [[t, True] if t[0] == turn else [swap(t, turn), on] if turn in t else [t, False] for t, on in lanes]


def merge(lanes, nxt):
    act = [i for i, v in enumerate(lanes) if v[1]]
    tgt = [i for i, v in enumerate(nxt) if v[1]]
    if len(act) < 2 or not tgt or len(tgt) >= len(act):
        return lanes
    a, b, n, m = act[0], act[-1], len(act), len(tgt)
    if tgt[0] == 0:
        b -= n - m
    elif tgt[-1] == len(nxt) - 1:
        a += n - m
    elif len(nxt) == n:
        a, b = a + tgt[0], a + tgt[-1]
    else:
        straight = [i for i in range(a, b + 1) if C["C"] in lanes[i][0]]
        if straight and len(straight) <= m:
            a, b = straight[0], straight[0] + len(straight) - 1
        else:
            if a == 0:
                a, n = a + 1, n - 1
            if b == len(lanes) - 1:
                b, n = b - 1, n - 1
            r = (n - m) / 2
            if r > 0:
                a, b = math.floor(a + r), math.ceil(b - r)
    return [[t, on and a <= i <= b] for i, (t, on) in enumerate(lanes)]


def common(lanes, turn, nturn, nlanes, left, right):
    have = list(dict.fromkeys(t for turns, on in lanes if on for t in turns))
    ahead = next((t[0] for t, on in nlanes if on), -1)
    one = None
    if len(have) == 1:
        one = have[0]
    elif turn in code(lg.KEEP) and nturn in have:
        for ok, t in ((left and nturn in code(lg.LEFT), nturn), (left and ahead in code(lg.LEFT), ahead), (right and nturn in code(lg.RIGHT), nturn), (right and ahead in code(lg.RIGHT), ahead), (ahead in code(lg.KEEP), ahead)):
            if ok:
                one = t
                break
    if one is None:
        if turn in code(("KL", "KR")):
            return lanes
        one = turn
    return [[t, on] if not on or t[0] == one else [swap(t, one), on] if one in t else [t, len(lanes) == 1] for t, on in lanes]


def texts(rng, n):
    return ["|".join(";".join(rng.sample(WORD, rng.choice((1, 1, 1, 2, 3)))) for _ in range(rng.randrange(1, 6))) for _ in range(n)]


def plain(lanes):
    return [[list(v["turns"]), v["on"]] for v in lanes]


def test_columns(spark):
    rng = random.Random(6)
    rows = [(k, t, rng.choice(list(C.values())[:11]), rng.randrange(3), rng.randrange(3), rng.randrange(6), rng.randrange(5), rng.randrange(3)) for k, t in enumerate([*texts(rng, 300), ""])]
    df = spark.createDataFrame(rows, "k int, text string, main int, l int, r int, before int, now int, leaving int")
    df = df.withColumn("raw", lg.parse(F.col("text"), F.col("main"))).withColumn("span", lg.active_range(F.col("raw"), *(F.col(c) for c in ("l", "r", "before", "now", "leaving"))))
    df = df.withColumn("info", lg.lanes_for(F.col("raw"), F.col("span"), F.col("main")))
    got = df.select("k", "raw", "span", "info", lg.activated(F.col("raw"), F.col("span")).alias("act"), lg.active_turn(F.col("info"), F.col("main")).alias("turn"), lg.from_turn(F.col("info"), F.col("main")).alias("final")).collect()
    spans = 0
    for r in got:
        _, text, main, *nums = rows[r.k]
        raw = parse(text, main)
        assert plain(r.raw) == raw
        s = span(raw, *nums)
        spans += s is not None
        assert (tuple(r.span) if r.span else None) == s, (text, nums)
        info = lanes_for(raw, s, main)
        assert plain(r.info) == info and r.turn == active_turn(info, main) and plain(r.final) == from_turn(info, main)
        if s:
            assert plain(r.act) == [[swap(t, s[2]) if s[0] <= i <= s[1] and s[2] in t else t, s[0] <= i <= s[1]] for i, (t, _) in enumerate(raw)]
    assert spans > 60


def test_backward_pass(spark):
    rng = random.Random(9)
    kind = "route int, seq int, turn int, lanes array<struct<turns:array<int>,on:boolean>>, gap int, highway string, may_left boolean, may_right boolean"
    rows = []
    for route in range(40):
        for seq in range(rng.randrange(1, 9)):
            lanes = [(t, rng.random() < 0.6) for t, _ in parse(texts(rng, 1)[0], 0)]
            turn = rng.choice((*(t for ts, _ in lanes for t in ts), C["C"], C["C"], C["KL"], C["KR"]))
            rows.append((route, seq, turn, lanes, rng.choice((50, 150, 250, 500)), rng.choice(("motorway", "primary", None)), rng.random() < 0.5, rng.random() < 0.5))
    got = {(r.route, r.seq): plain(r.lanes) for r in lg.narrowed(spark.createDataFrame(rows, kind)).collect()}
    want, changed = {}, 0
    for route in range(40):
        nxt = None
        for r in sorted((r for r in rows if r[0] == route), key=lambda r: -r[1]):
            lanes = [[list(t), on] for t, on in r[3]]
            if nxt and r[4] < (400 if r[5] == "motorway" else 200):
                new = common(merge(lanes, nxt[1]), r[2], nxt[0], nxt[1], r[6], r[7])
            else:
                new = from_turn(lanes, r[2])
            changed += new != lanes
            want[route, r[1]] = new
            nxt = r[2], new
    assert got == want and changed > 30


def test_split_structure(spark):
    route = spark.createDataFrame([(1, 0, "primary", 0.0, 0.0, "left|through|through;right"), (1, 1, "primary", 0.0, 10.0, "through|through"), (2, 0, "service", 90.0, 90.0, None), (2, 1, "service", 180.0, 180.0, None)], "route int, seq int, highway string, bearing_begin double, bearing_end double, turn_lanes string")
    off = [(1, 1, -80.0, 1, None, "residential", False), (1, 1, 30.0, 2, "right|right", "secondary", None), (1, 1, 75.0, 1, None, "service", True), (2, 1, 90.0, 1, None, "track", False), (1, 0, 5.0, 1, None, "primary", False)]
    got = {(r.route, r.seq): r for r in lg.split_structure(route, spark.createDataFrame(off, "route int, seq int, bearing double, lanes int, turn_lanes string, highway string, restricted boolean")).collect()}
    a = got[1, 1]
    assert (a.roads_left, a.roads_right, a.keep_left, a.keep_right, a.lanes_right, a.prio_right, a.turns_right, a.speak) == (1, 1, True, False, 2, 1, [C["TR"]], False)
    b = got[2, 1]
    assert (b.roads_left, b.roads_right, b.keep_right, b.prio_left) == (1, 0, True, 5) and (1, 0) not in got


def test_guidance(spark):
    route = spark.createDataFrame([(1, 0, 300, "primary", 0.0, 0.0, "left|through|through;right", 3, None), (1, 1, 120, "primary", 0.0, 0.0, "through|right", 2, C["C"]), (1, 2, 900, "primary", 90.0, 90.0, None, 1, C["TR"])], "route int, seq int, length int, highway string, bearing_begin double, bearing_end double, turn_lanes string, n_lanes int, turn int")
    off = spark.createDataFrame([(1, 1, -90.0, 1, None, "residential", False), (1, 1, 90.0, 1, None, "residential", False), (1, 2, 0.0, 1, None, "primary", False)], "route int, seq int, bearing double, lanes int, turn_lanes string, highway string, restricted boolean")
    got = {r.seq: r.s for r in lg.guidance(route, off).select("seq", lg.shown(F.col("lanes")).alias("s")).collect()}
    # the right turn that follows leaves one of the two lanes that go on
    assert got == {1: "TL|C|+C,TR", 2: "C|+TR"}


def test_only_rows_with_near_turns_go_through_rounds(spark, monkeypatch):
    """a row whose next turn is far is done at once; a round holds the rows that the last one may still change."""
    seen, keep = [], lg.checkpointed

    def count(df):
        out = keep(df)
        seen.append(out.count())
        return out

    monkeypatch.setattr(lg, "checkpointed", count)
    left, through = CODES["TL"], CODES["C"]
    lanes = [([left], True), ([through], True), ([through], True)]
    rows = [(r, k, through if k < 3 else left, lanes, 50 if k == 2 else 5000, "primary", True, True) for r in range(40) for k in range(4)]
    kind = f"route long, seq long, turn int, lanes {lg.LANES}, gap int, highway string, may_left boolean, may_right boolean"
    assert lg.narrowed(spark.createDataFrame(rows, kind)).count() == 160
    assert seen[0] == 160 and max(seen[1:]) == 40
