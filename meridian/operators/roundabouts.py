"""Roundabouts: the circle of a ring from its vertices, its roads in driving order, exits and turn angles.

Planar coordinates grow eastward (x) and southward (y), as tile coordinates do; angles of
roads around a ring are degrees counter-clockwise from the east, bearings as in turns.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import angle

# fixed value: beyond this angle the way out says less than the circle
SHARP = 120


def circles(pieces: DataFrame) -> DataFrame:
    """The circle of each ring: pieces has ring and points (array of x, y), in driving order within a piece.

    Rows (ring, n, x, y, radius, spread, clockwise): the least-squares circle (Kasa's form,
    solved from sums), the root mean square of the vertices' distances from it, and the
    driving direction as seen on a map with north up. A vertex that pieces share counts once
    for each. x, y, radius and spread are null where the vertices lie on one line or are
    fewer than three; clockwise is null where the driven area is zero. Null points and
    pieces without any are passed over; a null ring is a ring like others. Sums combine
    before the shuffle, so a ring of very many vertices is no burden to one task.
    """
    known = F.filter("points", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    p = pieces.select("ring", known.alias("points")).where(F.size("points") > 0)
    # sums of cubes keep their digits only near the ring, so vertices are taken from its corner
    corner = p.groupBy("ring").agg(F.min(F.array_min(F.transform("points", lambda q: q["x"]))).alias("_ox"), F.min(F.array_min(F.transform("points", lambda q: q["y"]))).alias("_oy"))
    o = corner.withColumnRenamed("ring", "_ring")
    p = p.join(o, p["ring"].eqNullSafe(o["_ring"])).drop("_ring")
    nxt = F.concat(F.slice("points", 2, F.size("points") - 1), F.array(F.element_at("points", -1)))
    v = p.select("ring", "_ox", "_oy", F.explode(F.arrays_zip(F.col("points").alias("a"), nxt.alias("b"))).alias("s"))
    x, y = ((F.col(f"s.a.{c}") - F.col(f"_o{c}")).cast("double") for c in "xy")
    bx, by = ((F.col(f"s.b.{c}") - F.col(f"_o{c}")).cast("double") for c in "xy")
    v = v.select("ring", "_ox", "_oy", x.alias("x"), y.alias("y"), (x * x + y * y).alias("z"), (x * by - bx * y).alias("c"))
    s = lambda e, n: F.sum(F.expr(e)).alias(n)
    g = v.groupBy("ring", "_ox", "_oy").agg(F.count("*").alias("n"), s("x", "sx"), s("y", "sy"), s("z", "sz"), s("x*x", "sxx"), s("x*y", "sxy"), s("y*y", "syy"), s("x*z", "sxz"), s("y*z", "syz"), s("z*z", "szz"), s("c", "turned"))
    n = F.col("n")
    cov = {k: F.col(f"s{k}") - F.col(f"s{k[0]}") * F.col(f"s{k[1]}") / n for k in ("xx", "xy", "yy", "xz", "yz")}
    g = g.select("ring", "_ox", "_oy", "n", "turned", "sx", "sy", "sz", "sxx", "sxy", "syy", "sxz", "syz", "szz", *(c.alias(f"c{k}") for k, c in cov.items()))
    det = F.expr("cxx * cyy - cxy * cxy")
    fits = (n >= 3) & (det > F.expr("1e-9 * cxx * cyy"))
    g = g.withColumn("_cx", F.when(fits, F.expr("(cxz * cyy - cyz * cxy) / 2") / det)).withColumn("_cy", F.when(fits, F.expr("(cyz * cxx - cxz * cxy) / 2") / det))
    g = g.withColumn("_rr", F.expr("(sz - 2 * _cx * sx - 2 * _cy * sy) / n + _cx * _cx + _cy * _cy"))
    # distance squared less radius squared, over twice the radius: the distance from the circle to first order
    e = F.expr("szz + 4 * _cx * _cx * sxx + 4 * _cy * _cy * syy + 8 * _cx * _cy * sxy - 4 * _cx * sxz - 4 * _cy * syz + 2 * (_cx * _cx + _cy * _cy - _rr) * (sz - 2 * _cx * sx - 2 * _cy * sy) + n * (_cx * _cx + _cy * _cy - _rr) * (_cx * _cx + _cy * _cy - _rr)")
    spread = F.sqrt(F.greatest(e / n, F.lit(0.0))) / (2 * F.sqrt("_rr"))
    return g.select("ring", "n", (F.col("_ox") + F.col("_cx")).alias("x"), (F.col("_oy") + F.col("_cy")).alias("y"), F.sqrt("_rr").alias("radius"), spread.alias("spread"), F.when(F.col("turned") != 0, F.col("turned") > 0).alias("clockwise"))


def around(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    """Where a point lies around a centre: degrees counter-clockwise from the east, 0 to 360."""
    return angle.normalize360(F.degrees(F.atan2(cy.cast("double") - y, x.cast("double") - cx)))


def in_driving_order(rings: DataFrame, attached: DataFrame) -> DataFrame:
    """Roads that meet a ring, numbered as one drives past them: attached has ring, road_id, x, y (where they meet).

    rings is circles' result. Adds at (degrees around the centre), ord (from 0) and n_roads.
    Numbering starts at the east and goes the ring's way round (counter-clockwise where it is
    not known); roads at one place go by road_id. A road that meets a ring twice is numbered
    twice. Roads of rings without a circle are left out, repeated rows count once.
    """
    c = rings.where("radius is not null").select(F.col("ring").alias("_ring"), F.col("x").alias("_cx"), F.col("y").alias("_cy"), F.coalesce("clockwise", F.lit(False)).alias("_cw"))
    a = attached.select("ring", "road_id", "x", "y").distinct()
    a = a.join(c, a["ring"] == c["_ring"]).withColumn("at", around(F.col("x"), F.col("y"), F.col("_cx"), F.col("_cy")))
    w = W.partitionBy("ring").orderBy(F.when(F.col("_cw"), angle.normalize360(-F.col("at"))).otherwise(F.col("at")), "road_id")
    return a.withColumn("ord", F.row_number().over(w) - 1).withColumn("n_roads", F.count("*").over(W.partitionBy("ring"))).select("ring", "road_id", "x", "y", "at", "ord", "n_roads")


def exits(ordered: DataFrame, passages: DataFrame) -> DataFrame:
    """Which exit a passage takes: passages has ring, from_road, to_road and columns of its own.

    ordered is in_driving_order's result. Adds exit, 1 for the first road after the way in;
    a passage that leaves where it came in takes the last exit, the whole way round. exit is
    null where a road does not meet the ring. A road that meets a ring twice is entered at its
    first number and left at the first one after. Ranks are subtracted, so no passage meets
    all roads of a ring.
    """
    own = [c for c in passages.columns if c not in ("ring", "from_road", "to_road")]
    o = ordered.groupBy("ring", "road_id").agg(F.array_sort(F.collect_list("ord")).alias("_o"), F.first("n_roads").alias("_n"))
    i = o.select(F.col("ring").alias("_r1"), F.col("road_id").alias("_f"), F.element_at("_o", 1).alias("_in"), "_n")
    t = o.select(F.col("ring").alias("_r2"), F.col("road_id").alias("_t"), F.col("_o").alias("_out"))
    p = passages.join(i, (passages["ring"] == i["_r1"]) & (passages["from_road"] == i["_f"]), "left")
    p = p.join(t, (p["ring"] == t["_r2"]) & (p["to_road"] == t["_t"]), "left")
    past = F.array_min(F.transform("_out", lambda q: F.pmod(q - F.col("_in") - 1, F.col("_n"))))
    return p.select("ring", "from_road", "to_road", *own, (past + 1).cast("int").alias("exit"))


def sides(attached: Column, came: Column, goes: Column) -> Column:
    """Roads beside a way through a junction: struct (n_left, n_right) of attached bearings.

    came is the bearing of the road before, goes the one of the road after, both at their
    starts and in degrees. Attached bearings that are null are passed over, a null array has none.
    """
    back, on = angle.normalize360(came - 180), angle.normalize360(goes)
    known = F.transform(F.filter(F.coalesce(attached, F.array().cast("array<double>")), lambda b: b.isNotNull()), lambda b: angle.normalize360(b))
    left = lambda b: F.when(back > on, ~((b > on) & (b < back))).otherwise((b > back) & (b < on))
    n_left = F.size(F.filter(known, left))
    return F.struct(n_left.alias("n_left"), (F.size(known) - n_left).alias("n_right"))


def turn_angle(out: Column, circle: Column) -> Column:
    """The angle of a roundabout turn: between the roads, or by the circle where that turns more than 120 degrees."""
    return F.when(F.abs(out) > SHARP, circle).otherwise(out)


def ring_turns(route: DataFrame, key: str = "route", order: str = "seq", left_side: bool = False) -> DataFrame:
    """Roundabout turns of routes: one at the first segment of a ring and one at each mini roundabout.

    route has bearing_begin and bearing_end (degrees), roundabout, n_attached (roads that
    meet the segment before its end), attached (bearings of the roads at its start),
    mini_begin and mini_end (its ends are marked as mini roundabouts) and clockwise (the
    road's own mark, or null: clockwise where one drives on the left).

    Adds exit and ring_angle, null on all other segments: a segment right after a ring has no
    turn, a mini roundabout needs the mark on both segments and a road beside them. Nulls in
    roundabout, mini_begin and mini_end count as false, in n_attached as zero. A route that
    starts in a ring gets its exit without an angle. Rows of equal order have no defined turn.
    """
    w = W.partitionBy(key).orderBy(order)
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    r = route.withColumn("_ring", f("roundabout"))
    r = r.withColumns({"_before": F.coalesce(F.lag("_ring").over(w), F.lit(False)), "_came": F.lag("bearing_begin").over(w), "_prev": F.lag("bearing_end").over(w), "_marked": F.coalesce(F.lag(f("mini_end")).over(w), F.lit(False)) & f("mini_begin")})
    r = r.withColumn("_run", F.sum((~F.col("_ring") | ~F.col("_before")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy(key, "_run")
    rest = w.rowsBetween(0, W.unboundedFollowing)
    ends = F.struct("bearing_begin", "bearing_end")
    # the segment after the ring, or the route's last one
    r = r.withColumns({"_exits": F.sum(F.coalesce("n_attached", F.lit(0))).over(run), "_last": F.coalesce(F.first(F.when(~F.col("_ring"), ends), ignorenulls=True).over(rest), F.last(ends).over(rest))})
    diff = angle.degrees_diff
    first = F.col("_ring") & ~F.col("_before")
    big = turn_angle(diff(F.col("_last.bearing_begin"), F.col("_prev")), -diff(F.col("bearing_begin"), F.col("_last.bearing_end") + 180))
    mini = F.col("_marked") & ~F.col("_ring") & ~F.col("_before") & (F.size(F.coalesce("attached", F.array().cast("array<double>"))) > 0)
    small = turn_angle(diff(F.col("bearing_begin"), F.col("_prev")), diff(F.col("bearing_begin"), F.col("_prev") + 180))
    r = r.withColumn("_s", sides(F.col("attached"), F.col("_came"), F.col("bearing_begin")))
    beside = F.when(F.coalesce("clockwise", F.lit(left_side)), F.col("_s.n_left")).otherwise(F.col("_s.n_right"))
    out = {"exit": F.when(first, F.col("_exits") + 1).when(mini, beside + 1).cast("int"), "ring_angle": F.when(first & F.col("_prev").isNotNull(), big).when(mini, small)}
    return r.withColumns(out).select(*route.columns, "exit", "ring_angle")
