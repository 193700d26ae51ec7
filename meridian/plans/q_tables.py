"""Queries over whole tables: scans, merges, joins, windows, graphs, drawing order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import angle, text, tile
from ..operators import graph, route, scan, spatial
from .q_scalar import _P, _places
from .views import SQL, features, roads, view

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


_B = f"with b as ({SQL['boxes']}), f as (select *, cx as l, cy as t, cx + dx as r, cy + dy as o from b)"
#: Boxes are this much wider on each side where they are joined with each other.
_WIDER = 12_000_000
_BOX = (200_000_000, 100_000_000, 900_000_000, 1_200_000_000)


@query("bbox_scan", f"{_B} select id, l as \"left\", t as top from f where r >= {_BOX[0]} and l <= {_BOX[2]} and o >= {_BOX[1]} and t <= {_BOX[3]}")
def bbox_scan(spark, d):
    return scan.in_box(scan.with_bounds(features(spark, d)), *_BOX).select("id", "left", "top")


@query("level_scan", f"{_B} select id, min_zoom, max_zoom from f where min_zoom <= 12 and max_zoom >= 12")
def level_scan(spark, d):
    return scan.at_level(features(spark, d), 12).select("id", "min_zoom", "max_zoom")


@query("leg_crossing", f"{_B}, c as (select id, (case when l < 5e8 then 1 else 0 end + case when l > 9e8 then 2 else 0 end + case when t < 5e8 then 4 else 0 end + case when t > 9e8 then 8 else 0 end) as p, (case when r < 5e8 then 1 else 0 end + case when r > 9e8 then 2 else 0 end + case when t < 5e8 then 4 else 0 end + case when t > 9e8 then 8 else 0 end) as q, (case when r < 5e8 then 1 else 0 end + case when r > 9e8 then 2 else 0 end + case when o < 5e8 then 4 else 0 end + case when o > 9e8 then 8 else 0 end) as s from f) select id, (p & q) = 0 or (q & s) = 0 as inside from c")
def leg_crossing(spark, d):
    box = [F.lit(v) for v in (500_000_000, 500_000_000, 900_000_000, 900_000_000)]
    return features(spark, d).select("id", scan.crosses_box(F.col("points"), *box).alias("inside"))


@query("dedupe_live", "select id, file_ord, n from (select o_orderkey % 400 as id, o_orderkey as n, cast(o_orderkey % 100000 as bigint) as file_ord, row_number() over (partition by o_orderkey % 400 order by o_orderkey % 100000, o_orderkey) as k from orders) where k = 1 or id = 0")
def dedupe_live(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    p = F.array(F.struct(F.col("o_orderkey").alias("x"), F.col("o_orderkey").alias("y")))
    rows = o.select((F.col("o_orderkey") % 400).alias("id"), F.col("o_orderkey").alias("n"), (F.col("o_orderkey") % 100000).alias("file_ord"), p.alias("points"))
    return scan.first_of_each(rows, 15).select("id", "file_ord", "n")


@query("tombstone_filter", "with d as (select o_orderkey % 500 as id, min(o_orderkey % 7) as gone from orders where o_orderkey % 97 = 0 group by 1) select o_orderkey as n, o_orderkey % 500 as id from orders left join d on o_orderkey % 500 = d.id where gone is null or gone > o_orderkey % 5")
def tombstone_filter(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("n"), (F.col("o_orderkey") % 500).alias("id"), (F.col("o_orderkey") % 5).alias("file_ord"))
    gone = spark.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 97 = 0").select((F.col("o_orderkey") % 500).alias("id"), (F.col("o_orderkey") % 7).alias("file_ord"))
    return scan.without_deleted(o, gone).select("n", "id")


@query("tag_lookup", "select p_partkey as id, p_brand as brand, p_brand = 'Brand#11' as first_is, contains(p_type, 'STEEL') as steel, '' as missing from part")
def tag_lookup(spark, d):
    f = features(spark, d)
    t = F.col("tags")
    return f.select("id", text.first_value(t, "brand").alias("brand"), text.first_is(t, "brand", "Brand#11").alias("first_is"), F.exists(t, lambda x: (x["tag"] == "type") & F.contains(x["value"], F.lit("STEEL"))).alias("steel"), F.coalesce(text.first_value(t, "absent"), F.lit("")).alias("missing"))


@query("simple_layer", "select p_partkey as id, case when p_size % 5 = 0 then -1 when p_size % 5 = 1 then 0 when p_size % 5 = 2 then 1 when p_partkey % 3 = 0 then -1 when p_partkey % 3 = 1 then 1 else 0 end as layer from part")
def simple_layer(spark, d):
    k = F.col("p_size") % 5
    t = lambda a, b: F.struct(F.lit(a).alias("tag"), b.alias("value"))
    layer = F.when(k == 0, "-2").when(k == 1, "0").when(k == 2, "5").otherwise("")
    way = F.col("p_partkey") % 3
    tags = F.array(t("tunnel", F.when(way == 0, "yes").otherwise("no")), t("bridge", F.when(way == 1, "yes").otherwise("no")), t("layer", layer))
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), text.simple_layer(tags).alias("layer"))


@query("dict_join", "select p_partkey as id, n_name as name from part join nation on p_size % 25 = n_nationkey")
def dict_join(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 25).alias("code"))
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    return p.join(n, "code").select("id", "name")


_V = f"with v as ({SQL['vertices']})"


@query("junction_join", f"{_V} select a.x, a.y, a.road_id as road_a, b.road_id as road_b, count(*) as n from v a join v b on a.x = b.x and a.y = b.y and a.road_id < b.road_id group by all")
def junction_join(spark, d):
    return spatial.junctions(roads(spark, d)).groupBy("x", "y", "road_a", "road_b").agg(F.count("*").alias("n"))


@query("tile_range_join", f"{_B}, w as (select id, l - {_WIDER} as l, t - {_WIDER} as t, r + {_WIDER} as r, o + {_WIDER} as o from f) select a.id as a, b.id as b from w a join w b on a.r >= b.l and a.l <= b.r and a.o >= b.t and a.t <= b.o where a.id < b.id")
def tile_range_join(spark, d):
    f = scan.with_bounds(features(spark, d)).select("id", *((F.col(c) + _WIDER * k).alias(c) for c, k in (("left", -1), ("top", -1), ("right", 1), ("bottom", 1))))
    g = f.toDF("id2", "left2", "top2", "right2", "bottom2")
    return spatial.boxes_meet(f, g, 8).where("id < id2").select(F.col("id").alias("a"), F.col("id2").alias("b"))


@query("nearest_place", f"{_P}, c as (select q.id, t.id as other, sqrt(pow(cast(q.x31 - t.x31 as double), 2) + pow(cast(q.y31 - t.y31 as double), 2)) as dist from t q join t on q.id <> t.id), n as (select *, row_number() over (partition by id order by dist, other) as rank from c) select id, other, rank, round(dist, 1) as dist from n where rank <= 3")
def nearest_place(spark, d):
    p = _places(spark, d)
    q = p.select("id", F.col("x31").alias("x"), F.col("y31").alias("y"))
    o = p.select(F.col("id").alias("other"), F.col("x31").alias("x2"), F.col("y31").alias("y2"))
    dist = F.when(F.col("id") == F.col("other"), 1e18).otherwise(F.sqrt(F.pow((F.col("x") - F.col("x2")).cast("double"), F.lit(2)) + F.pow((F.col("y") - F.col("y2")).cast("double"), F.lit(2))))
    got = spatial.nearest(q, o, "id", dist, "other", 1 << 25, k=3)
    return got.select("id", "other", F.col("rank").cast("bigint").alias("rank"), F.round("distance", 1).alias("dist"))


@query("radius_stops", f"{_P} select a.id, b.id as other from t a join t b on abs(a.x31 - b.x31) <= 20000000 and abs(a.y31 - b.y31) <= 20000000 and a.id < b.id")
def radius_stops(spark, d):
    p = _places(spark, d)
    a = p.select("id", F.col("x31").alias("x"), F.col("y31").alias("y"))
    b = p.select(F.col("id").alias("other"), F.col("x31").alias("x2"), F.col("y31").alias("y2"))
    return spatial.within(a, b, 20_000_000, F.col("id") < F.col("other")).select("id", "other")


@query("owner_range_join", "select o_orderkey as p, p_partkey as owner from orders join part on o_orderkey >= p_partkey * 30 and o_orderkey < p_partkey * 30 + p_size")
def owner_range_join(spark, d):
    p = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("p"))
    r = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("owner"), (F.col("p_partkey") * 30).alias("s"), (F.col("p_partkey") * 30 + F.col("p_size")).alias("e"))
    return spatial.in_ranges(p, r, "p", "s", "e", 100).select("p", "owner")


@query("restriction_antijoin", f"with m as ({SQL['moves']}), r as ({SQL['bans']}), o as (select distinct from_id from r where type >= 5) select m.from_id, m.to_id from m where not exists (select 1 from r where r.from_id = m.from_id and r.to_id = m.to_id and type between 1 and 4) and (m.from_id not in (select from_id from o) or exists (select 1 from r where r.from_id = m.from_id and r.to_id = m.to_id and type >= 5))")
def restriction_antijoin(spark, d):
    return spatial.allowed_turns(view(spark, d, "moves"), view(spark, d, "bans"))


@query("ocean_ratio", "select o_custkey % 50 as tile, avg(case when o_orderstatus = 'O' then 1.0::double else 0 end) >= 0.5 as water, round(avg(case when o_orderstatus = 'O' then 1.0::double else 0 end), 6) as ratio from orders group by 1")
def ocean_ratio(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 50).alias("tile"), (F.col("o_orderstatus") == "O").alias("ocean"))
    g = o.groupBy("tile").agg(scan.ocean_share(o).alias("s"))
    return g.select("tile", (F.col("s") >= 0.5).alias("water"), F.round("s", 6).alias("ratio"))


@query("route_totals", "select l_orderkey as route, cast(sum(l_suppkey % 50) as bigint) as walk, cast(sum(l_quantity) as bigint) as ride, cast(sum(l_linenumber) as bigint) as stops, cast(sum(l_partkey % 900) as bigint) as seconds, count(*) - 1 as changes from lineitem group by 1")
def route_totals(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    legs = li.select(F.col("l_orderkey").alias("route"), (F.col("l_suppkey") % 50).alias("walk"), F.col("l_quantity").cast("bigint").alias("ride"), F.col("l_linenumber").cast("bigint").alias("stops"), (F.col("l_partkey") % 900).alias("seconds"))
    return route.totals(legs)


_LEG = "(pow(sin((lat - plat) / 180.0 * pi() / 2), 2) + cos(plat / 180.0 * pi()) * cos(lat / 180.0 * pi()) * pow(sin((lon - plon) / 180.0 * pi() / 2), 2))"


@query("trace_distance", f"with p as ({SQL['points']}), w as (select *, lag(lat) over (partition by trace order by ind) as plat, lag(lon) over (partition by trace order by ind) as plon from p), g as (select *, coalesce(6372.8::double * (2 * atan2(sqrt({_LEG}), sqrt(1 - {_LEG}))) * 1000, 0) as leg from w) select trace, ind, round(leg, 2) as leg, round(sum(leg) over (partition by trace order by ind rows unbounded preceding), 2) as total from g")
def trace_distance(spark, d):
    t = route.cumulated(view(spark, d, "points"), lambda lag: tile.distance(lag("lat"), lag("lon"), F.col("lat"), F.col("lon")))
    return t.select("trace", "ind", F.round("leg", 2).alias("leg"), F.round("total", 2).alias("total"))


_S = f"with s as ({SQL['segments']})"


@query("turn_sections", f"{_S}, g as (select *, sum(case when turn is not null then 1 else 0 end) over (partition by route order by seq rows unbounded preceding) as section from s) select route, cast(section as bigint) as section, max(turn) as turn, count(*) as segments, cast(sum(length) as bigint) as length from g group by route, section")
def turn_sections(spark, d):
    return route.turn_sections(view(spark, d, "segments"))


@query("suffix_time", f"{_S} select route, seq, cast(coalesce(sum(length) over (partition by route order by seq rows between 1 following and unbounded following), 0) as bigint) as remaining from s")
def suffix_time(spark, d):
    return route.remaining(view(spark, d, "segments"), "length").select("route", "seq", "remaining")


@query("contiguous_merge", f"{_S}, n as (select *, case when lag(road_id) over w = road_id and lag(seq) over w = seq - 1 then 0 else 1 end as fresh from s window w as (partition by route order by seq)), g as (select *, sum(fresh) over (partition by route order by seq rows unbounded preceding) as island from n) select route, cast(island as bigint) as island, max(road_id) as road_id, min(seq) as i, max(seq) + 1 as j, count(*) as slices from g group by route, island")
def contiguous_merge(spark, d):
    s = view(spark, d, "segments").select("route", "seq", "road_id", F.col("seq").alias("i"), (F.col("seq") + 1).alias("j"))
    return route.merge_slices(s)


@query("muted_turns", f"{_S} select route, seq, not coalesce(turn = 'C' and lag(turn) over (partition by route order by seq) = 'C', false) as spoken from s")
def muted_turns(spark, d):
    return route.mute_repeats(view(spark, d, "segments")).select("route", "seq", "spoken")


@query("fill_heights", f"with v as (select road_id, i, i * 10 as total, case when (road_id + i) % 3 = 0 then quantity end as height from ({SQL['vertices']})), a as (select *, last_value(height ignore nulls) over b as h0, first_value(height ignore nulls) over c as h1, last_value(case when height is not null then total end ignore nulls) over b as d0, first_value(case when height is not null then total end ignore nulls) over c as d1 from v window b as (partition by road_id order by i rows between unbounded preceding and current row), c as (partition by road_id order by i rows between current row and unbounded following)) select road_id, i, round(coalesce(height, case when d1 = d0 then h0 else h0 + (h1 - h0) * (total - d0) / (d1 - d0) end), 4) as filled from a")
def fill_heights(spark, d):
    v = view(spark, d, "vertices").select("road_id", "i", (F.col("i") * 10).alias("total"), F.when((F.col("road_id") + F.col("i")) % 3 == 0, F.col("quantity")).alias("height"))
    return route.fill_heights(v).select("road_id", "i", F.round("filled", 4).alias("filled"))


@query("union_unique", "with a as (select o_orderkey % 1000 as id, 0 as src from orders), b as (select o_orderkey % 1500 as id, 1 as src from orders), u as (select * from a union all select * from b), m as (select id, min(src) as least from u where id > 0 group by id) select u.id, count(*) as n from u left join m using (id) where least is null or src = least group by u.id")
def union_unique(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    a, b = o.selectExpr("o_orderkey % 1000 as id"), o.selectExpr("o_orderkey % 1500 as id")
    return scan.union_first(a, b).groupBy("id").agg(F.count("*").alias("n"))


@query("array_sets", "with g as (select o_custkey as id, list_distinct(list(o_orderkey % 20)) as a, list_distinct(list(o_orderkey % 30)) as b from orders group by 1) select id, cast(len(list_intersect(a, b)) as bigint) as common, len(list_filter(b, lambda x: not list_contains(a, x))) = 0 as all_in from g")
def array_sets(spark, d):
    g = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(F.col("o_orderkey") % 20).alias("a"), F.collect_set(F.col("o_orderkey") % 30).alias("b"))
    return g.select("id", F.size(F.array_intersect("a", "b")).cast("bigint").alias("common"), (F.size(F.array_except("b", "a")) == 0).alias("all_in"))


@query("top_results", f"with b as ({SQL['boxes']}), r as (select brand, id, dx * dy as size, row_number() over (partition by brand order by dx * dy desc, id) as k from b) select brand, id, size, k from r where k <= 5")
def top_results(spark, d):
    from pyspark.sql import Window as W

    b = view(spark, d, "boxes").select("brand", "id", (F.col("dx") * F.col("dy")).alias("size"))
    k = F.row_number().over(W.partitionBy("brand").orderBy(F.col("size").desc(), "id"))
    return b.withColumn("k", k.cast("bigint")).where("k <= 5")


@query("bounded_shortest_path", f"with recursive e as (select a, b, min(cost) as cost from ({SQL['arcs']}) group by a, b), p as (select 0::bigint as node, 0::bigint as cost, 0 as hops union select e.b, p.cost + e.cost, hops + 1 from p join e on p.node = e.a where hops < 3) select node, min(cost) as cost from p group by node")
def bounded_shortest_path(spark, d):
    start = spark.range(1).selectExpr("id as source", "id as node")
    return graph.within_hops(view(spark, d, "arcs"), start, 3).select("node", "cost")


@query("shortest_costs")
def shortest_costs(spark, d):
    start = spark.range(3).selectExpr("id as source", "id as node")
    return graph.one_to_all(view(spark, d, "arcs"), start)


@query(
    "transit_rounds",
    f"""with c as ({SQL['calls']}), r0 as (select 1::bigint as source, stop, 0::bigint as due from (select min(stop) as stop from c)),
    b1 as (select source, route, min(seq) as seq from r0 join c using (stop) where c.due >= r0.due group by all), r1 as (select source, c.stop, min(c.due) as due from b1 join c using (route) where c.seq > b1.seq group by all),
    a1 as (select source, stop, min(due) as due from (select * from r0 union all select * from r1) group by all),
    b2 as (select source, route, min(seq) as seq from a1 join c using (stop) where c.due >= a1.due group by all), r2 as (select source, c.stop, min(c.due) as due from b2 join c using (route) where c.seq > b2.seq group by all)
    select source, stop, min(due) as due from (select * from a1 union all select * from r2) group by all""",
)
def transit_rounds(spark, d):
    c = view(spark, d, "calls").withColumnRenamed("due", "at")
    start = c.agg(F.min("stop").alias("stop")).select(F.lit(1).cast("bigint").alias("source"), "stop", F.lit(0).cast("bigint").alias("at"))
    return graph.transit_rounds(c, start, 1).select("source", "stop", F.col("at").alias("due"))


_RULES = "case when type like '%STEEL' then 3 when type like '%BRASS' then 2 when brand = 'Brand#11' then 1 else 0 end"


@query(
    "tile_draw_list",
    f"{_B}, v as (select f.*, 0 as src from f where id % 10 <> 0 union all select f.*, 1 from f where id % 2 = 0), d as (select id from f where id % 97 = 0), k as (select *, row_number() over (partition by id order by src) as n from v where id not in (select id from d) and min_zoom <= 12 and max_zoom >= 12 and r >= 0 and l <= 1073741823 and o >= 0 and t <= 1073741823), g as (select id, cast({_RULES} as int) as ord from k where n = 1) select id, ord, row_number() over (order by ord, id) as position from g",
)
def tile_draw_list(spark, d):
    """All features of a tile, live updates applied, deleted ones left out, in drawing order."""
    from ..operators import styles

    f = scan.with_bounds(features(spark, d))
    rows = f.where("id % 10 <> 0").unionByName(f.where("id % 2 = 0").withColumn("file_ord", F.lit(1)))
    gone = f.where("id % 97 = 0").select("id", F.lit(0).alias("file_ord"))
    rows = scan.without_deleted(rows, gone)
    rows = scan.in_box(scan.at_level(rows, 12), *scan.tile_box(1, 0, 0))
    rows = scan.first_of_each(rows, 15)
    style = styles.first_match([({"type": "%STEEL"}, 3), ({"type": "%BRASS"}, 2), ({"brand": "Brand#11"}, 1)], 0)
    return styles.positions(rows.select("id", style.alias("ord")))
