"""Queries over roundabouts: every part is a ring, whose order lines are its vertices and whose suppliers are its roads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import roundabouts
from .views import by_order

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


#: Valid in both dialects. Odd rings are driven clockwise; a vertex strays from its circle by up to four units.
VERTICES = """select l_partkey as ring, l_orderkey as ord, cast(l_linenumber as bigint) as line, l_suppkey as road_id,
cast(round(l_partkey * 90001 + (1000 + l_partkey % 50 * 40 + (l_orderkey * 7 + l_linenumber) % 9 - 4) * cos(((l_orderkey * 7919 + l_linenumber * 104729) % 36000) * pi() / 18000.0)) as bigint) as x,
cast(round(l_partkey % 1000 * 80021 - (1000 + l_partkey % 50 * 40 + (l_orderkey * 7 + l_linenumber) % 9 - 4) * sin(((l_orderkey * 7919 + l_linenumber * 104729) % 36000) * pi() / 18000.0)) as bigint) as y,
(l_orderkey * 7919 + l_linenumber * 104729) % 36000 as turn from lineitem"""
#: Moments about each ring's mean, where circles() takes them about its corner.
FITTED = f"""v as ({VERTICES}), m as (select ring, count(*) as n, min(x) as ox, min(y) as oy from v group by ring),
d as (select v.ring, v.ord, v.line, v.turn, n, ox, oy, (v.x - ox)::double as x, (v.y - oy)::double as y from v join m using (ring)),
a as (select ring, avg(x) as ax, avg(y) as ay from d group by ring),
u as (select d.ring, n, ox + ax as mx, oy + ay as my, x - ax as x, y - ay as y from d join a using (ring)),
s as (select ring, n, mx, my, sum(x*x) as xx, sum(x*y) as xy, sum(y*y) as yy, sum(x*(x*x+y*y))/2 as xz, sum(y*(x*x+y*y))/2 as yz from u group by ring, n, mx, my),
k as (select ring, n, mx, my, xx, yy, case when n >= 3 and xx*yy - xy*xy > 1e-9*xx*yy then (xz*yy - yz*xy)/(xx*yy - xy*xy) end as cx, case when n >= 3 and xx*yy - xy*xy > 1e-9*xx*yy then (yz*xx - xz*xy)/(xx*yy - xy*xy) end as cy from s),
fit as (select ring, n, mx + cx as x, my + cy as y, sqrt(cx*cx + cy*cy + (xx + yy)/n) as radius from k)"""


def _vertices(spark, d):
    return spark.sql(VERTICES.replace("from lineitem", "from {t}"), t=spark.read.parquet(f"{d}/lineitem.parquet"))


def _circles(spark, d):
    v = _vertices(spark, d)
    # a ring's vertices as it is driven; a ring has as many as its part has lines
    w = F.array_sort(F.collect_list(F.struct(F.when(F.col("ring") % 2 == 1, -F.col("turn")).otherwise(F.col("turn")).alias("t"), "ord", "line", "x", "y")))
    return roundabouts.circles(v.groupBy("ring").agg(w.alias("_v")).select("ring", F.transform("_v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points")))


@query("ring_circles", f"with {FITTED} select ring, n, round(x, 3) as x, round(y, 3) as y, round(radius, 3) as radius from fit")
def ring_circles(spark, d):
    return _circles(spark, d).select("ring", "n", *(F.round(c, 3).alias(c) for c in ("x", "y", "radius")))


@query(
    "ring_exits",
    f"""with {FITTED}, r as (select distinct v.ring, road_id, v.x, v.y, v.ring % 2 = 1 as cw, fit.x as cx, fit.y as cy from v join fit using (ring) where radius is not null),
ats as (select ring, road_id, cw, (degrees(atan2(cy - y, x - cx)) + 720) % 360 as deg from r),
spots as (select ring, road_id, case when cw then (360 - deg) % 360 else deg end as deg from ats),
p as (select ring, ord, min(road_id) as from_road, max(road_id) as to_road from v group by ring, ord),
i as (select p.*, f.deg as came from p join (select ring, road_id, min(deg) as deg from spots group by ring, road_id) f on f.ring = p.ring and f.road_id = p.from_road),
o as (select i.*, (t.deg, t.road_id) as goes, row_number() over (partition by i.ring, i.ord order by (t.deg, t.road_id) <= (i.came, i.from_road), t.deg) as k from i join spots t on t.ring = i.ring and t.road_id = i.to_road),
e as (select o.ring, o.ord, cast(count(*) as int) as exit from o join spots a on a.ring = o.ring and ((a.deg, a.road_id) <= (o.came, o.from_road), a.deg, a.road_id) <= (o.goes <= (o.came, o.from_road), o.goes[1], o.goes[2]) where o.k = 1 group by o.ring, o.ord)
select p.ring, p.ord, p.from_road, p.to_road, e.exit from p left join e on p.ring = e.ring and p.ord = e.ord""",
)
def ring_exits(spark, d):
    v = _vertices(spark, d)
    rings = _circles(spark, d).withColumn("clockwise", F.col("ring") % 2 == 1)
    passed = v.groupBy("ring", "ord").agg(F.min("road_id").alias("from_road"), F.max("road_id").alias("to_road"))
    return roundabouts.exits(roundabouts.in_driving_order(rings, v), passed)


#: Valid in both dialects: every order is a route over its lines.
ROUTES = """select l_orderkey as route, cast(l_linenumber as bigint) as seq, cast(min(l_partkey) * 37 % 360 - 180 as double) as bearing_begin, cast(min(l_suppkey) * 53 % 360 - 180 as double) as bearing_end,
min(l_suppkey) % 3 = 0 as roundabout, cast(min(l_quantity) as bigint) % 3 as n_attached, cast(min(l_quantity) as bigint) as q, min(l_partkey) % 4 > 0 as mini_begin, min(l_partkey) % 5 > 0 as mini_end,
case when min(l_partkey) % 7 = 0 then true when min(l_partkey) % 7 = 1 then false end as clockwise from lineitem group by l_orderkey, l_linenumber"""


def _diff(a, b):
    return f"(({a}) - ({b}) - 360 * ceil((({a}) - ({b}) - 180) / 360))"


_OUT, _CIRCLE = _diff("n.bearing_begin", "p.bearing_end"), "-" + _diff("s.bearing_begin", "n.bearing_end + 180")
_MOUT, _MCIRCLE = _diff("s.bearing_begin", "p.bearing_end"), _diff("s.bearing_begin", "p.bearing_end + 180")


@query(
    "ring_turns",
    f"""with r as ({ROUTES}), t as (select *, lag(roundabout) over w as before, lag(seq) over w as pseq from r window w as (partition by route order by seq)),
starts as (select * from t where roundabout and not coalesce(before, false)),
stops as (select s.route, s.seq, min(x.seq) as stop from starts s left join r x on x.route = s.route and x.seq > s.seq and not x.roundabout group by s.route, s.seq),
ends as (select route, max(seq) as finish from r group by route),
counts as (select s.route, s.seq, s.stop, cast(sum(x.n_attached) + 1 as int) as exit from stops s join r x on x.route = s.route and x.seq >= s.seq and x.seq < coalesce(s.stop, x.seq + 1) group by s.route, s.seq, s.stop),
big as (select c.route, c.seq, c.exit, case when abs({_OUT}) > 120 then {_CIRCLE} else {_OUT} end as ring_angle from counts c join t s on s.route = c.route and s.seq = c.seq join ends e on e.route = c.route join r n on n.route = c.route and n.seq = coalesce(c.stop, e.finish) left join r p on p.route = s.route and p.seq = s.pseq),
mini as (select s.*, (p.bearing_begin + 540) % 360 as back, (s.bearing_begin + 360) % 360 as fore, case when abs({_MOUT}) > 120 then {_MCIRCLE} else {_MOUT} end as ring_angle from t s join r p on p.route = s.route and p.seq = s.pseq where p.mini_end and s.mini_begin and not s.roundabout and not p.roundabout and s.q % 4 > 0),
arms as (select m.route, m.seq, (m.q * g.k * 67 + 360) % 360 as b, back, fore from mini m join (select unnest(range(1, 4)) as k) g on g.k <= m.q % 4),
split as (select route, seq, count(*) filter (case when back > fore then not (b > fore and b < back) else b > back and b < fore end) as n_left, count(*) as n from arms group by route, seq),
small as (select m.route, m.seq, cast(1 + case when coalesce(m.clockwise, false) then n_left else n - n_left end as int) as exit, ring_angle from mini m join split using (route, seq))
select * from big union all select * from small""",
)
def ring_turns(spark, d):
    r = spark.sql(ROUTES.replace("from lineitem", "from {t}"), t=by_order(spark, d))
    n = F.col("q") % 4
    arms = F.when(n > 0, F.transform(F.sequence(F.lit(1), n.cast("int")), lambda k: (F.col("q") * k * 67).cast("double")))
    return roundabouts.ring_turns(r.withColumn("attached", arms)).where("exit is not null").select("route", "seq", "exit", "ring_angle")
