"""Lane guidance: which lanes lead on at each turn of a route, as columns.

A lane is a struct (turns, on): its turn numbers, the main one first, and whether it is to be
taken. All is built-in functions on arrays; roads that leave at a turn are joined and
counted, and a backward pass narrows the lanes to those that suit the next turn too, in
rounds over all routes until nothing changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import angle
from ..functions.lanes import CODES, NAMES, WORDS
from .graph import checkpointed

LANES = "array<struct<turns:array<int>,on:boolean>>"
# fixed values: groups of turns, the angle of a turn, the priority that is not spoken, merging distances
LEFT, RIGHT = ("TL", "TSHL", "TSLL", "TU", "KL"), ("TR", "TSHR", "TSLR", "TRU", "KR")
SLIGHT, KEEP = ("TSLL", "TSLR", "C", "KL", "KR"), ("C", "KL", "KR")
SHARP_LEFT, SHARP_RIGHT, SHARP = ("TSHL", "TU"), ("TSHR", "TRU", "TU"), ("TSHL", "TSHR", "TU", "TRU")
TURN_ANGLE, SILENT = 45, 5
NEAR, NEAR_FAST = 200, 400


def _in(turn: Column, names: tuple[str, ...]) -> Column:
    return turn.isin([CODES[n] for n in names])


def _code(n: str) -> Column:
    return F.lit(CODES[n])


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def speak_priority(highway: Column) -> Column:
    """0 for main roads to 5 for roads that turns need not name."""
    h = F.coalesce(highway, F.lit(""))
    ends = lambda *w: h.rlike("(" + "|".join(w) + ")$")
    out = F.when((h == "") | ends("track", "services", "service", "path"), SILENT)
    return out.when(ends("_link", "unclassified", "road", "living_street", "residential"), 3).when(ends("tertiary"), 2).when(ends("secondary"), 1).otherwise(0)


def parse(text: Column, main: Column | int = 0) -> Column:
    """Lanes of 'left;through|right', left to right; a turn to the side of the main one, or itself, comes first in its lane. Null or empty text: no lanes; unknown words: straight on."""
    main = F.lit(main) if isinstance(main, int) else main
    words = F.create_map(*[F.lit(x) for w, n in WORDS.items() for x in (w, CODES[n])])

    def lane(part: Column) -> Column:
        turns = F.transform(F.split(part, ";"), lambda w: F.coalesce(words[F.trim(w)], _code("C")))
        first = lambda t: (t == main) | (_in(main, RIGHT) & _in(t, RIGHT)) | (_in(main, LEFT) & _in(t, LEFT))

        def put(acc: Column, t: Column) -> Column:
            front = F.slice(F.concat(F.array(t), acc), 1, 3)
            return F.when(F.size(acc) == 0, F.array(t)).when(first(t), front).when(F.size(acc) < 3, F.concat(acc, F.array(t))).otherwise(acc)

        return F.struct(F.aggregate(turns, F.array().cast("array<int>"), put).alias("turns"), F.lit(False).alias("on"))

    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast(LANES)).otherwise(F.transform(F.split(text, "\\|"), lane))


def directions(lanes: Column) -> Column:
    """All turns of all lanes, each once, in order of first place."""
    return F.array_distinct(F.flatten(F.transform(lanes, lambda v: v["turns"])))


def shown(lanes: Column) -> Column:
    """'+TL,C|TR': lanes to be taken with a plus."""
    name = F.create_map(*[F.lit(x) for kv in sorted(NAMES.items()) for x in kv])
    return F.array_join(F.transform(lanes, lambda v: F.concat(F.when(v["on"], "+").otherwise(""), F.array_join(F.transform(v["turns"], lambda t: name[t]), ","))), "|")


def swapped(turns: Column, turn: Column) -> Column:
    """The first place of a turn and the main turn change places."""
    return F.transform(turns, lambda t, i: F.when(i == 0, turn).when(i + 1 == F.array_position(turns, turn), turns[0]).otherwise(t))


def _lane(turns: Column, on: Column) -> Column:
    return F.struct(turns.alias("turns"), on.alias("on"))


def split_structure(route: DataFrame, attached: DataFrame) -> DataFrame:
    """What leaves at the start of each segment: rows (route, seq, roads_left, roads_right, keep_left, keep_right, lanes_left, lanes_right, prio_left, prio_right, turns_left, turns_right, speak).

    route: (route, seq, highway, bearing_begin, bearing_end, turn_lanes); attached: (route, seq,
    bearing, lanes, turn_lanes, highway, restricted), a road that begins where the segment
    does. Segments where nothing leaves have no row. turns_left and turns_right are the
    turns of the lanes of roads left and right of the way on.
    """
    w = W.partitionBy("route").orderBy("seq")
    lag = lambda c, n: F.lag(c).over(w).alias(n)
    r = route.select("route", "seq", F.col("bearing_begin").alias("cur"), F.col("turn_lanes").alias("_own"), speak_priority(F.col("highway")).alias("_prio"), lag("bearing_begin", "_pb"), lag("bearing_end", "_pe"), lag("turn_lanes", "_pl"), lag(speak_priority(F.col("highway")), "_pp"))
    a = attached.where("not coalesce(restricted, false)").select("route", "seq", "bearing", F.greatest(F.coalesce("lanes", F.lit(1)), F.lit(1)).alias("n"), F.col("turn_lanes").alias("_al"), speak_priority(F.col("highway")).alias("prio"))
    j = a.join(r.where("_pe is not null"), ["route", "seq"])
    j = j.withColumns({"_had": directions(parse(F.col("_pl"))), "_has": directions(parse(F.col("_own")))})
    had, own = F.col("_had"), F.col("_has")
    off = angle.degrees_diff(F.col("bearing"), F.col("cur"))
    straight = F.abs(angle.degrees_diff(F.col("_pe"), F.col("bearing"))) < TURN_ANGLE
    near = F.abs(off) < TURN_ANGLE
    back, cur, at = (angle.normalize360(F.col(c) - s) for c, s in (("_pb", 180), ("cur", 0), ("bearing", 0)))
    right = F.when(back > cur, (at > cur) & (at < back)).otherwise(~((at > back) & (at < cur)))
    same = (F.size(had) > 0) & (had == own)
    j = j.withColumns({"off": off, "straight": straight, "near": near, "right": right, "same": same, "sharp": F.exists(had, lambda t: _in(t, SHARP))})
    has = lambda n: F.array_contains(had, CODES[n])
    counted = (F.abs(F.col("off")) <= 150) | F.col("sharp")
    # with the same lanes before and after, a road to a side that no lane turns to is no way on
    barred = counted & F.col("same") & ~F.col("near") & ~F.col("straight") & ((F.col("right") & ~has("TR")) | ~has("TL"))
    j = j.where(~barred)
    seen = ((F.size(had) > 0) | (F.col("prio") != SILENT) | (F.greatest("_pp", "_prio") == SILENT)) & (F.col("near") | F.col("straight"))
    on_right = F.col("off") >= 0
    total = lambda c, v: F.sum(F.when(c, v).otherwise(0)).cast("int")
    turns = lambda c: F.array_distinct(F.flatten(F.collect_list(F.when(c, directions(parse(F.col("_al")))))))
    return j.groupBy("route", "seq").agg(
        total(counted & ~F.col("right"), 1).alias("roads_left"), total(counted & F.col("right"), 1).alias("roads_right"),
        F.max(seen & on_right).alias("keep_left"), F.max(seen & ~on_right).alias("keep_right"),
        total(seen & ~on_right, F.col("n")).alias("lanes_left"), total(seen & on_right, F.col("n")).alias("lanes_right"),
        F.max(F.when(seen & ~on_right, F.col("prio"))).alias("prio_left"), F.max(F.when(seen & on_right, F.col("prio"))).alias("prio_right"),
        turns(seen & ~on_right).alias("turns_left"), turns(seen & on_right).alias("turns_right"),
        F.max(seen & (F.col("prio") <= F.greatest("_pp", "_prio"))).alias("speak"),
    )


def active_range(lanes: Column, left: Column, right: Column, before: Column, now: Column, leaving: Column) -> Column:
    """(first, last, turn): the lanes that stay on the way when `left` and `right` roads leave; null if the lanes do not tell.

    before, now: lanes before and after; leaving: lanes of the roads that leave. Where these
    add up and all leave to one side the count decides, else the directions of the lanes.
    """
    n = F.size(lanes)
    by_count = (now > 0) & (before > now) & (before == now + leaving)
    made = lambda a, b, t: F.struct(a.cast("int").alias("first"), b.cast("int").alias("last"), t.alias("turn"))
    has = lambda t: F.transform(lanes, lambda v: F.array_contains(v["turns"], t))

    def span(d: Column) -> Column:
        def by_turns(v: Column) -> Column:
            first = F.array_position(has(v["start"]), True).cast("int") - 1
            last = n - F.array_position(F.reverse(has(v["end"])), True).cast("int")
            return made(first, last, v["start"])

        out = F.when((n == 0) | (left + right >= F.size(d)), None)
        out = out.when(by_count & (left == 0) & (right > 0), made(F.lit(0), now - 1, F.get(d, F.lit(0)))).when(by_count & (left > 0) & (right == 0), made(n - now, n - 1, F.get(d, left)))
        return out.otherwise(_let(F.struct(F.get(d, left).alias("start"), F.get(d, F.size(d) - right - 1).alias("end")), by_turns))

    return _let(directions(lanes), span)


def activated(lanes: Column, span: Column) -> Column:
    """Lanes of a range (first, last, turn) are to be taken, with its turn as their main one."""
    inside = lambda i: (i >= span["first"]) & (i <= span["last"])
    return F.transform(lanes, lambda v, i: _lane(F.when(inside(i) & F.array_contains(v["turns"], span["turn"]), swapped(v["turns"], span["turn"])).otherwise(v["turns"]), v["on"] | F.coalesce(inside(i), F.lit(False))))


def allows(main: Column, turn: Column, leftmost: Column | bool = True, rightmost: Column | bool = True) -> Column:
    """Whether a lane with that main turn serves a turn: the same one, one to its side, a slight one for straight on, and sharp turns at the edges."""
    side = lambda names: _in(main, names) & _in(turn, names)
    no_u = lambda names: tuple(n for n in names if n not in ("TU", "TRU"))
    edge = lambda e, names: (F.lit(e) if isinstance(e, bool) else e) & side(names)
    return (turn == main) | side(no_u(LEFT)) | side(no_u(RIGHT)) | ((main == CODES["C"]) & _in(turn, SLIGHT)) | edge(leftmost, SHARP_LEFT) | edge(rightmost, SHARP_RIGHT)


def lanes_for(lanes: Column, span: Column, main: Column) -> Column:
    """Lanes to be taken for a main turn: those of the range that serve it, or, if the range is none or serves it nowhere, those with just that turn."""
    some = F.slice(lanes, span["first"] + 1, F.greatest(span["last"] - span["first"] + 1, F.lit(0)))
    serves = F.exists(some, lambda v: allows(main, v["turns"][0], span["first"] == 0, span["last"] == F.size(lanes) - 1))
    ranged = F.coalesce((span["first"] >= 0) & (span["last"] >= span["first"]) & (span["last"] < F.size(lanes)) & serves, F.lit(False))
    inside = lambda i: F.coalesce((i >= span["first"]) & (i <= span["last"]), F.lit(False))
    return _let(ranged, lambda r: F.transform(lanes, lambda v, i: _lane(v["turns"], F.when(r, inside(i) & allows(main, v["turns"][0])).otherwise(v["turns"][0] == main))))


def active_turn(lanes: Column, old: Column) -> Column:
    """The turn that the lanes to be taken make of an old one: the last of them that serves it, or for a sharp old turn the first sharp one."""
    step = lambda s, v: F.when(~v["on"] | s["done"], s).otherwise(_then(s, v))

    def _then(s: Column, v: Column) -> Column:
        t = F.when(allows(old, v["turns"][0]), v["turns"][0]).otherwise(s["t"])
        return F.struct(t.alias("t"), (_in(old, SHARP) & _in(t, SHARP)).alias("done"))

    return F.aggregate(lanes, F.struct(old.alias("t"), F.lit(False).alias("done")), step)["t"]


def from_turn(lanes: Column, turn: Column) -> Column:
    """Lanes after the final turn is known: if some lane has it, it becomes the main turn of those, lanes that begin with it are to be taken, those without it are not."""
    has = lambda v: F.array_contains(v["turns"], turn)
    put = lambda v: F.when(v["turns"][0] == turn, _lane(v["turns"], F.lit(True))).when(has(v), _lane(swapped(v["turns"], turn), v["on"])).otherwise(_lane(v["turns"], F.lit(False)))
    return F.when(F.exists(lanes, has), F.transform(lanes, put)).otherwise(lanes)


def _active(lanes: Column) -> tuple[Column, Column, Column]:
    """(first, last, number) of lanes to be taken; first is -1 if none is."""
    on = F.transform(lanes, lambda v: v["on"])
    first = F.array_position(on, True).cast("int") - 1
    return first, F.when(first < 0, -1).otherwise(F.size(lanes) - F.array_position(F.reverse(on), True).cast("int")), F.size(F.filter(on, lambda v: v))


def merged(lanes: Column, after: Column) -> Column:
    """Lanes narrowed to those that suit the lanes of the next turn: as many on the left or right as it takes there, or the middle ones for a turn between."""
    def cut(v: Column) -> Column:
        a0, a1, n, t0, t1, m = (v[c] for c in ("a0", "a1", "n", "t0", "t1", "m"))
        size, size_t = F.size(lanes), F.size(after)
        straight = F.transform(F.sequence(a0, F.greatest(a1, a0)), lambda i: F.array_contains(F.get(lanes, i)["turns"], CODES["C"]))
        span = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
        # cut at the edges, then half of what is still too much from each side
        e0, e1 = a0 + (a0 == 0).cast("int"), a1 - (a1 == size - 1).cast("int")
        spare = (n - (a0 == 0).cast("int") - (a1 == size - 1).cast("int") - m) / 2
        middle = F.when(spare > 0, span(F.floor(e0 + spare), F.ceil(e1 - spare))).otherwise(span(e0, e1))

        def between(g: Column) -> Column:
            n_straight, s0 = F.size(F.filter(g, lambda x: x)), a0 + F.array_position(g, True).cast("int") - 1
            return F.when((n_straight > 0) & (n_straight <= m), span(s0, s0 + n_straight - 1)).otherwise(middle)

        new = F.when((n < 2) | (t0 < 0) | (m >= n), None).when(t0 == 0, span(a0, a1 - (n - m))).when(t1 == size_t - 1, span(a0 + (n - m), a1))
        return new.when(size_t == n, span(a0 + t0, a0 + t1)).otherwise(_let(straight, between))

    ends = [c.alias(k) for k, c in zip(("a0", "a1", "n", "t0", "t1", "m"), (*_active(lanes), *_active(after)), strict=True)]
    put = lambda new: F.when(new.isNull(), lanes).otherwise(F.transform(lanes, lambda v, i: _lane(v["turns"], v["on"] & (i >= new["a"]) & (i <= new["b"]))))
    return _let(_let(F.struct(*ends), cut), put)


def common_lane(lanes: Column, turn: Column, next_turn: Column, next_lanes: Column, may_left: Column, may_right: Column) -> Column:
    """One turn for all lanes to be taken: their only one, or the next turn's where the way goes straight on towards it; lanes without it are not to be taken."""
    on = F.filter(lanes, lambda v: v["on"])
    first = F.coalesce(F.get(F.filter(next_lanes, lambda v: v["on"]), F.lit(0))["turns"][0], F.lit(-1))
    keeps = _in(turn, KEEP)

    def common(v: Column) -> Column:
        have, ahead = v["have"], v["ahead"]
        taken = keeps & F.array_contains(have, next_turn)
        one = F.when(F.size(have) == 1, have[0])
        one = one.when(taken & may_left & _in(next_turn, LEFT), next_turn).when(taken & may_left & _in(ahead, LEFT), ahead)
        one = one.when(taken & may_right & _in(next_turn, RIGHT), next_turn).when(taken & may_right & _in(ahead, RIGHT), ahead).when(taken & _in(ahead, KEEP), ahead)
        return F.coalesce(one, F.when(~_in(turn, ("KL", "KR")), turn))

    def put(one: Column) -> Column:
        lane = lambda v: F.when(~v["on"] | (v["turns"][0] == one), v).when(F.array_contains(v["turns"], one), _lane(swapped(v["turns"], one), v["on"])).otherwise(_lane(v["turns"], F.size(lanes) == 1))
        return F.when(one.isNull(), lanes).otherwise(F.transform(lanes, lane))

    return _let(_let(F.struct(directions(on).alias("have"), first.alias("ahead")), common), put)


def narrowed(turns: DataFrame) -> DataFrame:
    """Rows (route, seq, turn, lanes) with lanes that suit the next turn of the route too, where it is near.

    turns: (route, seq, turn, lanes, gap, highway, may_left, may_right), gap the way to the route's
    next row. Each round takes the next row's lanes as the last round left them, in those rows whose
    next row changed; rounds go on until no lane changes, so chains of near turns are followed
    to their ends. After k rounds the last k + 1 rows of a chain are done and left out.
    """
    # rows run backwards, so the one before is the next of the route
    w = W.partitionBy("route").orderBy(F.desc("seq"))
    fast = F.coalesce(F.col("highway"), F.lit("")).rlike("^(trunk|motorway)")
    near = F.coalesce(F.lag("lanes").over(w).isNotNull() & (F.col("gap") < F.when(fast, NEAR_FAST).otherwise(NEAR)), F.lit(False))
    rows = turns.where(F.size("lanes") > 0).withColumns({"_near": near, "_turn": F.lag("turn").over(w), "_k": F.row_number().over(w)})
    depth = F.col("_k") - F.max(F.when(~F.col("_near"), F.col("_k"))).over(w)
    now = F.when(F.col("_near"), F.col("lanes")).otherwise(from_turn(F.col("lanes"), F.col("turn")))
    cols = ("route", "seq", "turn", "lanes", "may_left", "may_right", "_turn", "_depth")
    rows = checkpointed(rows.withColumn("_depth", depth).select(*cols, now.alias("now"), F.lit(True).alias("_moved")))
    out, k = rows.where("_depth = 0"), 1
    while True:
        ahead = rows.withColumns({"_lanes": F.lag("now").over(w), "_go": F.lag("_moved").over(w)}).where(F.col("_depth") >= k)
        cut = ahead.withColumn("_cut", F.when(F.col("_go"), merged(F.col("lanes"), F.col("_lanes"))))
        put = F.when(F.col("_go"), common_lane(F.col("_cut"), F.col("turn"), F.col("_turn"), F.col("_lanes"), F.col("may_left"), F.col("may_right"))).otherwise(F.col("now"))
        rows = checkpointed(cut.withColumn("_new", put).select(*cols, F.col("_new").alias("now"), (F.col("_new") != F.col("now")).alias("_moved")))
        if rows.where("_moved").isEmpty():
            return out.unionByName(rows).select("route", "seq", "turn", F.col("now").alias("lanes"))
        out, k = out.unionByName(rows.where(F.col("_depth") == k)), k + 1


def guidance(route: DataFrame, attached: DataFrame) -> DataFrame:
    """Rows (route, seq, turn, lanes) for every segment that begins with a turn and has lanes before it.

    route: (route, seq, length, highway, bearing_begin, bearing_end, turn_lanes, n_lanes, turn),
    turn a number at a segment's start or null; attached as in split_structure().
    """
    w = W.partitionBy("route").orderBy("seq")
    r = route.withColumns({"_text": F.lag("turn_lanes").over(w), "_before": F.lag("n_lanes").over(w), "_at": F.coalesce(F.sum("length").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    r = r.where(F.col("turn").isNotNull() & F.col("_text").isNotNull()).join(split_structure(route, attached).select("route", "seq", "roads_left", "roads_right", "lanes_left", "lanes_right"), ["route", "seq"], "left")
    r = r.withColumn("_raw", parse(F.col("_text"), F.col("turn")))
    span = F.when(F.col("roads_left").isNotNull(), active_range(F.col("_raw"), F.col("roads_left"), F.col("roads_right"), F.col("_before"), F.col("n_lanes"), F.col("lanes_left") + F.col("lanes_right")))
    r = r.withColumn("_span", span).withColumn("lanes", lanes_for(F.col("_raw"), F.col("_span"), F.col("turn")))
    turn_to = lambda n: F.exists("_raw", lambda v: F.array_contains(v["turns"], CODES[n]))
    t = r.select("route", "seq", active_turn(F.col("lanes"), F.col("turn")).alias("turn"), "lanes", "_at", "highway", (F.coalesce("roads_left", F.lit(0)) == 0).alias("_l"), (F.coalesce("roads_right", F.lit(0)) == 0).alias("_r"), turn_to("TU").alias("_tu"), turn_to("TRU").alias("_tru"))
    return narrowed(t.select("route", "seq", "turn", "lanes", (F.lead("_at").over(w) - F.col("_at")).alias("gap"), "highway", (F.col("_l") | F.col("_tu")).alias("may_left"), (F.col("_r") | F.col("_tru")).alias("may_right")))
