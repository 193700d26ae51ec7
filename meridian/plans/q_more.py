"""Queries over road attributes, turns, timetables, terrain, labels, coastlines and the overlay."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lanes, road, text, timing
from ..functions.lanes import CODES
from ..operators import coast, labels, lane_guidance, overlay, raster, route_parts, transit, turns
from ..sources import text_sinks
from .views import SQL, dealt, features, view

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _tag(k, v):
    return F.struct((F.lit(k) if isinstance(k, str) else k).alias("tag"), (F.lit(v) if isinstance(v, str) else v).alias("value"))


def _parts(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), "p_brand", "p_type", "p_name")


@query(
    "road_values",
    "select p_partkey as id, case when p_size % 4 = 0 then 1 when p_size % 4 = 1 then -1 when p_size % 4 = 2 then 1 else 0 end as oneway, case when p_size % 5 > 0 then p_size % 5 else -1 end as lanes, round(case when p_size % 3 = 0 then p_size / 3.6::double when p_size % 3 = 1 then 50 / 3.6::double else 40 end, 6) as speed, case when p_size % 2 = 0 then p_name else p_brand end as name from part",
)
def road_values(spark, d):
    p, size = _parts(spark, d), F.col("size")
    way = F.when(size % 4 == 0, "yes").when(size % 4 == 1, "-1").otherwise("no")
    ring = F.when(size % 4 == 2, "roundabout").otherwise("none")
    speed = F.when(size % 3 == 0, size.cast("string")).when(size % 3 == 1, "50").otherwise("none")
    types = F.array(_tag("oneway", way), _tag("junction", ring), _tag("lanes", (size % 5).cast("string")), _tag("maxspeed", "90"), _tag("maxspeed:forward", speed), _tag("maxspeed:backward", "10"))
    names = F.map_from_entries(F.array_compact(F.array(_tag("name", F.col("p_brand")), F.when(size % 2 == 0, _tag("name:de", F.col("p_name"))))))
    return p.select("id", types.alias("t"), names.alias("m")).select("id", road.oneway(F.col("t")).alias("oneway"), road.lanes(F.col("t")).alias("lanes"), F.round(road.max_speed(F.col("t"), F.lit(True)), 6).alias("speed"), road.name(F.col("m"), "de").alias("name"))


_LANES = ("left|through", "through;right|none", "slight_left|through|right", "reverse;left|through")
_SHOWN = ("TL|C", "C,TR|C", "TSLL|C|TR", "TU,TL|C")


@query("lane_strings", f"select p_partkey as id, case p_partkey % 4 when 0 then '{_SHOWN[0]}' when 1 then '{_SHOWN[1]}' when 2 then '{_SHOWN[2]}' else '{_SHOWN[3]}' end as shown, p_partkey % 4 in (1, 2) as turns_right from part")
def lane_strings(spark, d):
    t = F.get(F.array(*map(F.lit, _LANES)), (F.col("id") % 4).cast("int"))
    p = _parts(spark, d).select("id", lanes.lanes_column(t).alias("l"))
    return p.select("id", lanes.shown(F.col("l")).alias("shown"), lanes.has_turn(F.col("l"), "TR").alias("turns_right"))


_B = "select l_orderkey as route, cast(l_linenumber as bigint) as seq, min(l_partkey) % 360 as bin, min(l_suppkey) * 37 % 360 as bout, min(l_suppkey) % 3 as side, cast(min(l_quantity) as bigint) as length from lineitem group by l_orderkey, l_linenumber"


@query(
    "turn_instructions",
    f"with b as ({_B}), l as (select *, lag(bout) over w - bin as raw, lag(side) over w as sides from b window w as (partition by route order by seq)), a as (select *, cast(raw - 360 * ceil((raw - 180) / 360.0::double) as double) as a from l) select route, seq, a as angle, case when a is null or coalesce(sides, 0) = 0 then null when a < -150 then 'TRU' when a < -120 then 'TSHR' when a < -45 then 'TR' when a <= -5 then 'TSLR' when a < 5 then 'C' when a < 45 then 'TSLL' when a < 120 then 'TL' when a < 150 then 'TSHL' else 'TU' end as turn from a",
)
def turn_instructions(spark, d):
    b = spark.sql(_B.replace("from lineitem", "from {t}"), t=spark.read.parquet(f"{d}/lineitem.parquet"))
    r = b.select("route", "seq", F.col("bin").cast("double").alias("bearing_in"), F.col("bout").cast("double").alias("bearing_out"), F.col("side").alias("n_side"), "length", F.lit(False).alias("roundabout"))
    return turns.turns(r).select("route", "seq", "angle", "turn")


@query("to_next_turn", f"with s as ({SQL['segments']}), e as (select *, sum(length) over (partition by route order by seq desc rows unbounded preceding) as rest from s) select route, seq, cast(rest - first_value(case when turn is not null then rest end ignore nulls) over (partition by route order by seq rows between 1 following and unbounded following) as bigint) as to_turn from e")
def to_next_turn(spark, d):
    return turns.next_turn_distance(view(spark, d, "segments")).select("route", "seq", "to_turn")


@query("segment_times", "select l_orderkey as id, l_linenumber as line, l_partkey as part, round(l_quantity * 100 / least((l_tax * 100 + 1) * 1.5::double, 9), 6) as cost, round(l_quantity * 100 / case when l_suppkey % 40 + 1 > 15 then 15 + (l_suppkey % 40 + 1 - 15) / 2.0::double else l_suppkey % 40 + 1 end, 6) as seconds from lineitem")
def segment_times(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    q = F.col("l_quantity") * 100
    cost = timing.segment_cost(q, F.col("l_tax") * 100 + 1, F.lit(1.5), F.lit(9.0))
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.round(cost, 6).alias("cost"), F.round(timing.damped(q, F.col("l_suppkey") % 40 + 1), 6).alias("seconds"))


@query("slope_buckets", "with s as (select p_partkey as id, (p_size - 25) / 200.0::double * 100 as s from part) select id, cast(case when abs(s) < 1 then 0 else sign(s) * (cast(floor((abs(s) + 2) / 3) as int) * 3 - 2) end as int) as bucket from s")
def slope_buckets(spark, d):
    return _parts(spark, d).select("id", timing.slope_bucket((F.col("size") - 25).cast("double"), F.lit(200.0)).cast("int").alias("bucket"))


@query("merged_stops", "with s as (select o_custkey % 700 as id, o_orderkey as n, o_orderkey % 100 as x, o_orderstatus = 'P' and o_orderkey % 50 = 1 as gone from orders) select id, arg_min(n, n) as first_file, arg_min(x, n) as x from s group by id having not bool_or(gone)")
def merged_stops(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    gone = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 50 == 1)
    s = o.select((F.col("o_custkey") % 700).alias("id"), F.col("o_orderkey").alias("file_ord"), (F.col("o_orderkey") % 100).alias("x"), F.col("o_orderkey").alias("y"), F.array().cast("array<bigint>").alias("deleted"), gone.alias("is_deleted"))
    return transit.merge_stops(s).select("id", F.col("y").alias("first_file"), "x")


@query("timetable", "with r as (select p_partkey as route, p_size as s from part), t as (select route, s, k as trip, 100 + k * (s * 10) as start from r, range(0, 4) g(k)) select route, cast(trip as bigint) as trip, cast(j as bigint) as seq, cast(start + j * (s + 2) + j * 5 as bigint) as due from t, range(0, 4) h(j)")
def timetable(spark, d):
    s = F.col("size").cast("bigint")
    r = _parts(spark, d).select(F.col("id").alias("route"), F.array(F.lit(100).cast("bigint"), s * 10, s * 10, s * 10).alias("trip_intervals"), F.array(s + 2, s + 2, s + 2).alias("stop_intervals"), F.array(*[F.lit(5).cast("bigint")] * 3).alias("waits"))
    return transit.timetable(r).select("route", F.col("trip").cast("bigint").alias("trip"), F.col("seq").cast("bigint").alias("seq"), F.col("at").alias("due"))


@query("best_results", "with r as (select o_custkey % 200 as q, o_orderkey as id, o_orderkey * 31 % 997 as s, o_orderkey % 5 as a, o_orderkey % 7 + 10 as b from orders), w as (select x.*, exists (select 1 from r y where y.q = x.q and (y.s < x.s or (y.s = x.s and y.id < x.id)) and y.a = x.a and y.b = x.b) as worse from r x), k as (select *, row_number() over (partition by q order by s, id) as n from w where not worse) select q as query, id, s as seconds, n as rank from k where n <= 5")
def best_results(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    r = o.select((F.col("o_custkey") % 200).alias("query"), k.alias("id"), (k * 31 % 997).alias("seconds"), F.array(k % 5, k % 7 + 10).alias("routes"))
    return transit.best_results(r, 5).select("query", "id", "seconds", F.col("rank").cast("bigint").alias("rank"))


@query("stitched_routes")
def stitched_routes(spark, d):
    v = view(spark, d, "calls")
    stop = F.struct(F.col("stop").alias("id"), (F.col("stop") * 30).alias("x"), (F.col("stop") % 7 * 30).alias("y"))
    parts = v.groupBy("route", (F.col("due") % 3).cast("int").alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "due", stop.alias("s")))), lambda r: r["s"]).alias("stops"))
    return transit.combine_routes(parts)


@query("joined_routes", f"select road_id as route, string_agg(cast(road_id * 8 + i as varchar), ',' order by i) as stops from ({SQL['vertices']}) group by road_id having count(*) > 1")
def joined_routes(spark, d):
    """Every order as a route of which one source has the first half, one the rest and one the stops around the seam."""
    v = view(spark, d, "vertices").select(F.col("road_id").alias("route"), "i", F.struct((F.col("road_id") * 8 + F.col("i")).alias("id"), "x", "y").alias("s"), F.row_number().over(W.partitionBy("road_id").orderBy("i")).alias("n"))
    part = F.explode(F.array_compact(F.array(F.when(F.col("n") <= 3, 0), F.when(F.col("n").between(3, 5), 1), F.when(F.col("n") >= 4, 2)))).alias("part")
    parts = v.select("route", "i", "s", part).groupBy("route", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda r: r["s"]).alias("stops"))
    got = route_parts.join_parts(parts, 50)
    return got.select("route", F.array_join(F.transform("stops", lambda s: s["id"].cast("string")), ",").alias("stops"))


@query("water_polygons")
def water_polygons(spark, d):
    b = view(spark, d, "boxes")
    size = 1 << 25
    tx, ty = F.floor(F.col("cx") / size), F.floor(F.col("cy") / size)
    ring = lambda x, y, w: F.array(*[F.struct((x + i).cast("bigint").alias("x"), (y + j).cast("bigint").alias("y")) for i, j in ((0, 0), (0, w), (w, w), (w, 0), (0, 0))])
    return coast.water(b.select(tx.alias("tx"), ty.alias("ty"), "id", ring(F.col("cx"), F.col("cy"), 2_000_000).alias("points")), 6)


@query("placed_labels")
def placed_labels(spark, d):
    k = F.col("id")
    p = _parts(spark, d).select((k % 20).alias("tile"), "id", (F.col("size") % 10).alias("ord"), F.col("p_brand").alias("text"), (k * 7919 % 2000).cast("double").alias("x"), (k * 104729 % 2000).cast("double").alias("y"), F.lit(60.0).alias("w"), F.lit(14.0).alias("h"), (k % 4 * 0.3).alias("angle"))
    return labels.place(p, 150.0)


@query("thinned_lines")
def thinned_lines(spark, d):
    f = features(spark, d).select((F.col("id") % 5).alias("tile"), "id", F.col("min_zoom").cast("int").alias("ord"), "points")
    return labels.thin_out(f, 3, 1 << 27)


@query("shaded_tiles")
def shaded_tiles(spark, d):
    k = F.col("id")
    h = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: ((i * k * 31) % 97).cast("float"))
    t = raster.shaded(dealt(_parts(spark, d).select("id"), "id").select("id", h.alias("heights")), 16, 30.0)
    return t.select("id", F.round("slope_mean", 4).alias("slope_mean"), F.sha2("shade", 256).alias("shade"))


@query("overlay_costs")
def overlay_costs(spark, d):
    arcs = view(spark, d, "arcs")
    cells = spark.range(60).select(F.col("id").alias("node"), F.floor(F.col("id") / 15).alias("cell"))
    points, net = overlay.build(arcs, cells)
    q = spark.range(12).selectExpr("id as query", "id * 5 as start", "(id * 17 + 3) % 60 as end")
    return overlay.route(q, arcs, cells, points, net)


@query("type_bundles", "select p_partkey as id, 'brand=' || p_brand || ';type=' || p_type as bundle, 2 as n from part")
def type_bundles(spark, d):
    f = features(spark, d).select("id", text_sinks.bundle(F.col("tags")).alias("bundle"))
    return f.withColumn("n", F.size(text_sinks.unbundle(F.col("bundle"))))


@query("track_lines", f"select trace, ind, '<trkpt lat=\"' || printf('%.7f', lat) || '\" lon=\"' || printf('%.7f', lon) || '\"/>' as line from ({SQL['points']})")
def track_lines(spark, d):
    return text_sinks.track_lines(view(spark, d, "points"))


@query("dictionary_codes", "select p_type as value, row_number() over (order by p_type) - 1 as code from (select distinct p_type from part)")
def dictionary_codes(spark, d):
    return text_sinks.dictionary(spark.read.parquet(f"{d}/part.parquet"), "p_type")


@query("merged_catalog", "select n_name as name, case when n_nationkey % 3 = 0 then 2 else 1 end as size from nation")
def merged_catalog(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    return text_sinks.merge_catalog(n.select(F.col("n_name").alias("name"), F.lit(1).alias("size")), n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("name"), F.lit(2).alias("size")))


@query("host_names", "select page_id as id, regexp_extract(url, '([^/\\\\]*)$', 1) as file from pages")
def host_names(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("id"), text.file_name(F.col("url")).alias("file"))


_LANE_TEXTS = ("left|through|right", "left;through|through;right", "slight_left|through|through|slight_right", "reverse;left|through|through;right|right", "left|left;through|right", "sharp_left|left|through", "through|through;slight_right|right", "left;through;right")
_LANE_ROWS = "select l_orderkey as route, l_linenumber as seq, cast(l_partkey % 8 as int) as k, cast(l_suppkey % 3 as int) as l, cast(l_partkey % 2 as int) as r from lineitem"
_LANE_CASE = "case w when 'left' then 'TL' when 'right' then 'TR' when 'slight_left' then 'TSLL' when 'slight_right' then 'TSLR' when 'sharp_left' then 'TSHL' when 'reverse' then 'TU' else 'C' end"


@query(
    "lane_ranges",
    f"""with t as (select route, seq, l, r, [{", ".join(f"'{t}'" for t in _LANE_TEXTS)}][k + 1] as text from ({_LANE_ROWS})),
p as (select *, list_transform(string_split(text, '|'), lambda lane: list_transform(string_split(lane, ';'), lambda w: {_LANE_CASE})) as lanes from t),
d as (select *, list_filter(flatten(lanes), lambda x, i: list_position(flatten(lanes), x) = i) as dirs from p),
s as (select *, case when l + r < len(dirs) then dirs[l + 1] end as a, case when l + r < len(dirs) then dirs[len(dirs) - r] end as b from d),
q as (select *, list_position(list_transform(lanes, lambda v: list_contains(v, a)), true) as lo, len(lanes) + 1 - list_position(list_reverse(list_transform(lanes, lambda v: list_contains(v, b))), true) as hi from s)
select route, seq, cast(case when a is null then -1 else lo - 1 end as integer) as first, cast(case when a is null then -1 else hi - 1 end as integer) as last,
  array_to_string(list_transform(lanes, lambda v, i: case when a is not null and i between lo and hi then '+' else '' end || array_to_string(case when a is not null and i between lo and hi and list_contains(v, a) then list_transform(v, lambda t, k: case when k = 1 then a when k = list_position(v, a) then v[1] else t end) else v end, ',')), '|') as shown from q""",
)
def lane_ranges(spark, d):
    t = spark.sql(_LANE_ROWS.replace("from lineitem", "from {t}"), t=spark.read.parquet(f"{d}/lineitem.parquet"))
    t = t.withColumn("lanes", lane_guidance.parse(F.get(F.array(*map(F.lit, _LANE_TEXTS)), F.col("k"))))
    none = F.lit(0)
    t = t.withColumn("span", lane_guidance.active_range(F.col("lanes"), F.col("l"), F.col("r"), none, none, none))
    return t.select("route", "seq", *(F.coalesce(f"span.{c}", F.lit(-1)).alias(c) for c in ("first", "last")), lane_guidance.shown(lane_guidance.activated(F.col("lanes"), F.col("span"))).alias("shown"))


@query("guided_lanes")
def guided_lanes(spark, d):
    """Lanes at every turn of routes along orders, with roads that leave at each, narrowed towards the next turn."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("route"), F.col("l_linenumber").alias("seq")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").alias("q"))
    text = F.get(F.array(*map(F.lit, _LANE_TEXTS)), (F.col("p") % 8).cast("int"))
    way = F.get(F.array(*map(F.lit, ("primary", "motorway", "residential", "service"))), (F.col("s") % 4).cast("int"))
    turn = F.get(F.array(*(F.lit(CODES[n]) for n in ("C", "TL", "TR", "KL", "KR", "TSLR"))), (F.col("s") % 7).cast("int"))
    route = li.select("route", "seq", (F.col("q") * 8).cast("int").alias("length"), way.alias("highway"), (F.col("s") * 7 % 360).cast("double").alias("bearing_begin"), (F.col("s") * 7 % 360).cast("double").alias("bearing_end"), text.alias("turn_lanes"), F.size(F.split(text, "\\|")).alias("n_lanes"), turn.alias("turn"))
    off = li.where("p % 3 <> 0").select("route", "seq", (F.col("p") * 31 % 360).cast("double").alias("bearing"), (F.col("p") % 3).cast("int").alias("lanes"), text.alias("turn_lanes"), way.alias("highway"), (F.col("p") % 11 == 0).alias("restricted"))
    return lane_guidance.guidance(route, off).select("route", "seq", "turn", lane_guidance.shown(F.col("lanes")).alias("shown"))
