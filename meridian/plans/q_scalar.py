"""Queries that apply scalar columns: tiles, distances, angles, strings, units, packed integers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import angle, bits, text, tile
from .views import SQL, view

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


_P = f"with p as ({SQL['places']}), m as (select *, ln(tan(lat / 180.0 * pi()) + 1 / cos(lat / 180.0 * pi())) as merc from p), t as (select *, cast(trunc((lon + 180) / 360 * 2147483648::double) as bigint) as x31, cast(trunc((1 - merc / pi()) / 2 * 2147483648::double) as bigint) as y31 from m)"
_HAV = "6372.8::double * (2 * atan2(sqrt({h}), sqrt(1 - {h}))) * 1000"


def _places(spark, d):
    return view(spark, d, "places").withColumns({"x31": tile.x31(F.col("lon")), "y31": tile.y31(F.col("lat"))})


@query("tile_xy", f"{_P} select id, x31, y31, x31 >> 17 as tx, y31 >> 17 as ty from t")
def tile_xy(spark, d):
    return _places(spark, d).select("id", "x31", "y31", F.shiftright("x31", 17).alias("tx"), F.shiftright("y31", 17).alias("ty"))


@query("tile_lonlat_roundtrip", f"{_P} select id, round(x31 / 1024.0::double / 2097152 * 360.0 - 180.0, 6) as lon, round(atan(sinh(pi() * (1 - 2 * (y31 / 1024.0::double) / 2097152))) * 180.0 / pi(), 6) as lat from t")
def tile_roundtrip(spark, d):
    return _places(spark, d).select("id", F.round(tile.lon31(F.col("x31")), 6).alias("lon"), F.round(tile.lat31(F.col("y31")), 6).alias("lat"))


_H = "(pow(sin((52.5::double - lat) / 180.0 * pi() / 2), 2) + cos(lat / 180.0 * pi()) * cos(52.5::double / 180.0 * pi()) * pow(sin((13.4::double - lon) / 180.0 * pi() / 2), 2))"


@query("haversine", f"{_P} select id, round({_HAV.format(h=_H)}, 3) as metres from p")
def haversine(spark, d):
    p = view(spark, d, "places")
    return p.select("id", F.round(tile.distance(F.col("lat"), F.col("lon"), F.lit(52.5), F.lit(13.4)), 3).alias("metres"))


def _edge(row: str) -> str:
    lat = f"(atan(sinh(pi() * (1 - 2 * (({row}) * 131072 / 1024.0::double) / 2097152))))"
    h = f"(cos({lat}) * cos({lat}) * pow(sin(360.0::double / 16384 / 180.0 * pi() / 2), 2))"
    return f"({_HAV.format(h=h)} / 131072)"


@query(
    "tile_metric_distance",
    f"""{_P}, q as (select id, x31, y31, least(x31 + 300000, 2147483647) as x2, least(y31 + 200000, 2147483647) as y2 from t),
    l as (select id, x31 as xa, y31 as ya, x2 as xb, y2 as yb, (y31 > 1073741824) <> (y2 > 1073741824) and y31 <> 1073741824 and y2 <> 1073741824 as c, x31 + cast(trunc((x2 - x31) * cast(1073741824 - y31 as double) / (y2 - y31)) as bigint) as mx from q),
    g as (select id, case when c then mx else xa end as x1, case when c then 1073741824 else ya end as y1, xb as x2, yb as y2 from l union all select id, mx, 1073741824, xa, ya from l where c),
    w as (select *, cast(floor(y1 / 2) + floor(y2 / 2) as bigint) as my from g),
    u as (select *, my / 131072::double - floor(my / 131072::double) as part, floor(my / 131072::double) as r from w),
    s as (select id, sqrt(pow((x2 - x1) * (part * {_edge("r + 1")} + (1 - part) * {_edge("r")}), 2) + pow((y1 - y2) * (part * {_edge("r + 1")} + (1 - part) * {_edge("r")}), 2)) as m from u)
    select id, round(sum(m), 3) as metres from s group by id""",
)
def tile_metric(spark, d):
    p = _places(spark, d)
    x2, y2 = F.least(F.col("x31") + 300000, F.lit(2147483647)), F.least(F.col("y31") + 200000, F.lit(2147483647))
    return p.select("id", F.round(tile.tile_metric(F.col("x31"), F.col("y31"), x2, y2), 3).alias("metres"))


@query("check_degrees", f"with p as ({SQL['places']}) select id, round(case when lon * 5 > 180 then lon * 5 - 360 * ceil((lon * 5 - 180) / 360) when lon * 5 < -180 then lon * 5 + 360 * ceil((-180 - lon * 5) / 360) else lon * 5 end, 4) as lon, round(greatest(-85.0511::double, least(85.0511::double, case when lat * 3 > 90 then lat * 3 - 180 * ceil((lat * 3 - 90) / 180) when lat * 3 < -90 then lat * 3 + 180 * ceil((-90 - lat * 3) / 180) else lat * 3 end)), 4) as lat from p")
def check_degrees(spark, d):
    return view(spark, d, "places").select("id", F.round(tile.check_longitude(F.col("lon") * 5), 4).alias("lon"), F.round(tile.check_latitude(F.col("lat") * 3), 4).alias("lat"))


_TURN = "case when a < -150 then 'TRU' when a < -120 then 'TSHR' when a < -45 then 'TR' when a <= -5 then 'TSLR' when a < 5 then 'C' when a < 45 then 'TSLL' when a < 120 then 'TL' when a < 150 then 'TSHL' else 'TU' end"


@query("angle_norm", f"with p as (select id, lon * 4 - lat * 2 as d from ({SQL['places']})), q as (select id, d - 360 * ceil((d - 180) / 360) as a, d - 360 * floor(d / 360) as n from p) select id, round(a, 4) as diff, round(n, 4) as full_turn, {_TURN} as turn from q")
def angle_norm(spark, d):
    a = angle.degrees_diff(F.col("lon") * 4, F.col("lat") * 2)
    return view(spark, d, "places").select("id", F.round(a, 4).alias("diff"), F.round(angle.normalize360(F.col("lon") * 4 - F.col("lat") * 2), 4).alias("full_turn"), angle.turn_by_angle(a).alias("turn"))


@query(
    "project_point",
    f"with b as ({SQL['boxes']}), t as (select id, cx, cy, dx, dy, greatest(0::double, least(1::double, ((cast(cx as double) + cast(dx * 2 as double) / 3 - cx) * dx + cast(dy as double) * dy) / (cast(dx as double) * dx + cast(dy as double) * dy))) as k from b) select id, cast(trunc(cx + dx * k) as bigint) as x, cast(trunc(cy + dy * k) as bigint) as y from t",
)
def project_point(spark, d):
    x, y, dx, dy = (F.col(c) for c in ("cx", "cy", "dx", "dy"))
    p = angle.project(x.cast("double") + dx * 2 / 3, y + dy, x, y, x + dx, y + dy)
    return view(spark, d, "boxes").select("id", p["x"].alias("x"), p["y"].alias("y"))


@query("polygon_area", f"select id, round(abs(cast(cx as double) * cy - cast(cx + dx as double) * cy + cast(cx + dx as double) * (cy + dy) - cast(cx + dx as double) * cy + cast(cx + dx as double) * cy - cast(cx as double) * (cy + dy)) / 2 / 1e12, 5) as area from ({SQL['boxes']})")
def polygon_area(spark, d):
    from .views import features

    return features(spark, d).select("id", F.round(angle.ring_area(F.col("points")) / 1e12, 5).alias("area"))


_UNITS = "select p_partkey as id, case p_partkey % 6 when 0 then 'none' when 1 then cast(p_size as varchar) || ' mph' when 2 then cast(p_size as varchar) when 3 then cast(p_size as varchar) || '.5' when 4 then 'walk' else cast(p_size as varchar) || ' km/h' end as v from part"


def _units(spark, d):
    return spark.sql(_UNITS.replace("varchar", "string").replace("from part", "from {t}"), t=spark.read.parquet(f"{d}/part.parquet"))


@query("parse_speed", f"select id, round(case when v = 'none' then 40 when regexp_extract(v, '^-?[0-9]+(\\.[0-9]+)?') = '' then -1 else cast(regexp_extract(v, '^-?[0-9]+(\\.[0-9]+)?') as double) / 3.6::double * case when contains(v, 'mph') then 1.6::double else 1 end end, 6) as speed from ({_UNITS})")
def parse_speed(spark, d):
    return _units(spark, d).select("id", F.round(text.parse_speed(F.col("v"), -1.0), 6).alias("speed"))


_LENGTHS = "select p_partkey as id, cast(p_size as varchar) || case p_partkey % 7 when 0 then ' km' when 1 then ' ft' when 2 then '''10\"' when 3 then ' cm' when 4 then ' mile' when 5 then '.25 m' else ' in' end as v from part"


@query("parse_length", f"select id, round(case id % 7 when 0 then n * 1000 when 1 then n * 0.3048::double when 2 then n * 0.3048::double + 10 * 0.0254::double when 3 then n * 0.01::double when 4 then n * 1609.34::double when 5 then n + 0.25::double else n * 0.0254::double end, 5) as metres from (select p_partkey as id, cast(p_size as double) as n from part)")
def parse_length(spark, d):
    t = spark.read.parquet(f"{d}/part.parquet")
    return spark.sql(_LENGTHS.replace("varchar", "string").replace("'''10\"'", "'\\'10\"'").replace("from part", "from {t}"), t=t).select("id", F.round(text.parse_length(F.col("v"), -1.0), 5).alias("metres"))


@query("parse_weight", "select p_partkey as id, round(case p_partkey % 3 when 0 then p_size * 0.4535::double / 1000.0 when 1 then p_size else -1 end, 8) as tonnes from part")
def parse_weight(spark, d):
    v = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" lbs"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit("t"))).otherwise("t5")
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.round(text.parse_weight(v, -1.0), 8).alias("tonnes"))


@query("interval_seconds", "select o_orderkey as id, cast(case o_orderkey % 4 when 0 then (o_custkey % 90) * 60 when 1 then (o_custkey % 24) * 3600 + (o_custkey % 60) * 60 when 2 then (o_custkey % 24) * 3600 + (o_custkey % 60) * 60 + o_orderkey % 60 else 300 end as bigint) as seconds from orders")
def interval_seconds(spark, d):
    s = lambda c: c.cast("string")
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    v = F.when(o % 4 == 0, s(c % 90)).when(o % 4 == 1, F.concat_ws(":", s(c % 24), s(c % 60))).when(o % 4 == 2, F.concat_ws(":", s(c % 24), s(c % 60), s(o % 60))).otherwise("x:5")
    return spark.read.parquet(f"{d}/orders.parquet").select(o.alias("id"), text.interval_seconds(v).cast("bigint").alias("seconds"))


@query("lanes_unpack", "with l as (select l_orderkey as id, l_linenumber as line, cast((l_partkey * 31 + l_suppkey) % 32768 as bigint) as lane from lineitem) select id, line, lane & 1 = 1 as active, (lane >> 1) & 15 as first_turn, (lane >> 5) & 31 as second_turn, (lane >> 10) & 31 as third_turn from l")
def lanes_unpack(spark, d):
    lane = ((F.col("l_partkey") * 31 + F.col("l_suppkey")) % 32768).cast("bigint")
    got = [bits.lane_turn(lane, p) for p in (bits.LANE_PRIMARY, bits.LANE_SECONDARY, bits.LANE_TERTIARY)]
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), bits.lane_active(lane).alias("active"), *[g.alias(n) for g, n in zip(got, ("first_turn", "second_turn", "third_turn"), strict=True)])


@query("source_id", "with i as (select o_orderkey as id, o_orderkey * 4096 + case o_orderkey % 3 when 0 then 4398046511104 when 1 then 1099511627776 else 0 end as packed from orders) select id, case when id % 3 < 2 then ((packed & ~(4398046511104 | 1099511627776)) >> 5) >> 6 else packed >> 6 end as source_id, id % 3 = 1 as split, id % 3 = 0 as relation from i")
def source_id(spark, d):
    o = F.col("o_orderkey")
    p = o * 4096 + F.when(o % 3 == 0, 1 << 42).when(o % 3 == 1, 1 << 40).otherwise(0)
    return spark.read.parquet(f"{d}/orders.parquet").select(o.alias("id"), bits.source_id(p).alias("source_id"), bits.is_split(p).alias("split"), bits.is_relation(p).alias("relation"))


@query("point_ids", "select l_orderkey as id, l_linenumber as line, (l_orderkey << 11) + (cast(l_linenumber as bigint) << 1) + case when l_returnflag = 'R' then 1 else 0 end as packed from lineitem")
def point_ids(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), bits.point_id(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_returnflag") == "R").alias("packed"))


@query("split_distinct_runs", "with e as (select page_id as id, list_filter(string_split(url, '/'), lambda s: s <> '') as p from pages) select id, array_to_string(list_filter(p, lambda s, i: i = 1 or p[i - 1] <> s), '/') as parts from e")
def split_runs(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("id"), text.split_distinct_runs(F.col("url"), "/").alias("parts"))


@query("colors", "with c as (select p_partkey as id, (p_partkey * 7919) % 16777216 as rgb, p_partkey % 256 as a from part) select id, cast(case when id % 2 = 0 then rgb - 16777216 when a >= 128 then a * 16777216 + rgb - 4294967296 else a * 16777216 + rgb end as bigint) as color, '#' || case when id % 2 = 0 or a = 255 then '' else lower(lpad(to_hex(a), 2, '0')) end || lower(lpad(to_hex(rgb), 6, '0')) as shown from c")
def colors(spark, d):
    k = F.col("p_partkey")
    rgb = F.lpad(F.hex((k * 7919) % 16777216), 6, "0")
    v = F.when(k % 2 == 0, F.concat(F.lit("#"), rgb)).otherwise(F.concat(F.lit("#"), F.lpad(F.hex(k % 256), 2, "0"), rgb))
    t = spark.read.parquet(f"{d}/part.parquet").select(k.alias("id"), text.parse_color(v).alias("color"))
    return t.withColumn("shown", text.color_text(F.col("color")))


@query("short_refs", "select o_orderkey as id, case when length(r) > 8 then substring(r, 1, 8) || '…' else r end as ref, case when length(r) > 5 then substring(r, 1, 5) || '…' else r end as small from (select o_orderkey, o_orderpriority || case when o_orderkey % 2 = 0 then '' else '' end as r from orders)")
def short_refs(spark, d):
    v = F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, ":north").otherwise(""))
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), text.short_ref(v).alias("ref"), text.short_ref(v, True).alias("small"))


@query("road_priority", "select p_partkey as id, case p_size % 6 when 0 then 10 when 1 then 3 when 2 then 2 when 3 then 1 when 4 then 0 else 3 end as priority from part")
def road_priority(spark, d):
    names = F.array(*map(F.lit, ("highway_track", "highway_residential", "highway_tertiary", "highway_secondary", "highway_motorway", "highway_motorway_link")))
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), angle.highway_priority(F.get(names, F.col("p_size") % 6)).alias("priority"))


@query("metres3857", f"{_P} select id, round(x31 / 2147483648::double * 2 * 20037508.342789244::double - 20037508.342789244::double, 3) as mx, case when x31 - 1000000000 >= 0 then (x31 - 1000000000 + 256) >> 9 else -((1000000000 - x31 + 256) >> 9) end as in_tile from t")
def metres3857(spark, d):
    return _places(spark, d).select("id", F.round(tile.metres3857(F.col("x31")), 3).alias("mx"), tile.scale_to_tile(F.col("x31"), F.lit(1000000000), 9).alias("in_tile"))
