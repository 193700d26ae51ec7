"""Queries over rules, calendars, tiles and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hours
from ..operators import geometry, graph, match, rule_masks, rules
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


HOURS = ("24/7", "Mo-Fr 08:00-18:00", "Sa,Su 10:00-14:00", "Fr,Sa 20:00-03:00", "Mo-Fr 08:00-12:00,13:00-17:30; We off", "Jun-Aug: Mo-Su 09:00-17:00", "Su off")


@query(
    "open_at",
    "with e as (select event_id as id, ts, event_id % 7 as k, extract(isodow from ts) as d, extract(hour from ts) * 60 + extract(minute from ts) as m, extract(month from ts) as mo from events) select id, case k when 0 then true when 1 then d <= 5 and m between 480 and 1080 when 2 then d >= 6 and m between 600 and 840 when 3 then (d in (5, 6) and m >= 1200) or (d in (6, 7) and m < 180) when 4 then d <= 5 and d <> 3 and (m between 480 and 720 or m between 780 and 1050) when 5 then mo between 6 and 8 and m between 540 and 1020 else false end as open from e",
)
def open_at(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    text = F.get(F.array(*map(F.lit, HOURS)), (F.col("event_id") % 7).cast("int"))
    return e.select(F.col("event_id").alias("id"), hours.open_at(text, F.col("ts")).alias("open"))


PROFILE = """<profile>
<attribute name="default" value="40"/><attribute name="winter" value="true"/>
<way attribute="speed">
  <if param="winter"><select value="20" t="type" v="ECONOMY"/></if>
  <select value="$limit" t="limit"><gt value1="$limit" value2="30"/></select>
  <ifnot t="brand" v="Brand#11"><select value="55" t="wide"/></ifnot>
  <select value=":default"/>
</way>
<way attribute="access"><select value="-1" t="closed" v="yes"/><select value="1"/></way>
</profile>"""


_RULED = "with p as (select p_partkey as id, p_brand as brand, split_part(p_type, ' ', 1) as kind, p_size from part) select id, cast(case when kind = 'ECONOMY' then 20 when p_size % 2 = 0 and p_size > 30 then p_size when brand <> 'Brand#11' and p_size % 3 = 0 then 55 else 40 end as double) as speed, cast(case when p_size % 5 = 0 then -1 else 1 end as double) as access from p"


def _ruled(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    pick = lambda k, c, v: F.when(c, F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")))
    size, yes = F.col("p_size"), F.lit("yes")
    have = [pick("brand", F.lit(True), F.col("p_brand")), pick("type", F.lit(True), F.split("p_type", " ")[0]), pick("limit", size % 2 == 0, size), pick("wide", size % 3 == 0, yes), pick("closed", size % 5 == 0, yes)]
    return p.select(F.col("p_partkey").alias("id"), F.map_from_entries(F.array_compact(F.array(*have))).alias("tags"))


@query("rule_speed", _RULED)
def rule_speed(spark, d):
    cols = rules.compile_profile(PROFILE, F.col("tags"))
    return _ruled(spark, d).select("id", cols["speed"].alias("speed"), cols["access"].alias("access"))


@query("masked_rules", _RULED)
def masked_rules(spark, d):
    """The same profile as bit masks over interned tags."""
    return rule_masks.with_attributes(_ruled(spark, d), PROFILE).select("id", "speed", "access")


@query("mvt_tiles")
def mvt_tiles(spark, d):
    f = features(spark, d).withColumn("area", F.col("id") % 2 == 0)
    return geometry.tiles(f, 6).select("tx", "ty", "n_features", F.length("tile").cast("bigint").alias("n_bytes"), F.sha2("tile", 256).alias("sha256"))


_SNAP = f"with p as (select trace, ind, cast(trunc(lon * 1e4) as bigint) as x, cast(trunc(lat * 1e4) as bigint) as y from ({SQL['points']}))"


def _trace_points(spark, d):
    return view(spark, d, "points").select("trace", "ind", (F.col("lon") * 1e4).cast("bigint").alias("x"), (F.col("lat") * 1e4).cast("bigint").alias("y"))


@query("matched_traces")
def matched_traces(spark, d):
    grid = spark.range(60).select(F.col("id").alias("road_id"), F.transform(F.sequence(F.lit(0), F.lit(45)), lambda k: F.struct((k * 2000).cast("bigint").alias("x"), (F.col("id") * 1200 + k * 3).alias("y"))).alias("points"))
    return match.match(_trace_points(spark, d), match.legs(grid), 700, 500.0)


@query("snapped_points", f"{_SNAP} select trace, ind, cast(ceil(y / 1000.0::double - 0.5) as bigint) as road, abs(y - cast(ceil(y / 1000.0::double - 0.5) as bigint) * 1000) as off from p")
def snapped_points(spark, d):
    grid = spark.range(80).select(F.col("id").alias("road_id"), F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.struct((k * 3000).cast("bigint").alias("x"), (F.col("id") * 1000).alias("y"))).alias("points"))
    s = match.snap(_trace_points(spark, d), match.legs(grid), 600)
    return s.select("trace", "ind", F.col("leg.road_id").alias("road"), F.col("off").cast("bigint").alias("off"))


@query("paths_per_query")
def paths_per_query(spark, d):
    arcs = view(spark, d, "arcs")
    q = spark.range(20).selectExpr("id as query", "id as start", "(id * 7 + 11) % 60 as end")
    return graph.per_query(q, _arcs_per_query(arcs))


def _arcs_per_query(arcs):
    """The subgraph of each query: here the arcs of one of twenty overlapping thirds of the network."""
    k = F.explode(F.filter(F.sequence(F.lit(0), F.lit(19)), lambda i: (F.col("a") + F.col("b") + i) % 3 != 0)).alias("query")
    return arcs.select(k, "a", "b", F.col("cost").cast("double").alias("cost")).withColumn("query", F.col("query").cast("bigint"))


_ROAD_STATS = f"with v as ({SQL['vertices']}) select road_id, count(*) as n, min(x) as \"left\", max(x) as \"right\" from v group by road_id"


@query("road_bounds", _ROAD_STATS)
def road_bounds(spark, d):
    from ..operators import scan

    r = scan.with_bounds(roads(spark, d))
    return r.select("road_id", F.size("points").cast("bigint").alias("n"), "left", "right")
