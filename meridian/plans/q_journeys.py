"""Queries over journeys, direction points, regions and the remaining text and number forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits, text
from ..operators import graph, journeys, match
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


_S = f"with s as ({SQL['segments']})"


@query("journey_legs", "select o_custkey as journey, cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as bigint) as leg, o_orderkey % 60 as start, lead(o_orderkey % 60) over (partition by o_custkey order by o_orderkey) as finish from orders qualify finish is not null")
def journey_legs(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("journey"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 60).alias("node"))
    return journeys.journey_legs(o).select("journey", F.col("leg").cast("bigint").alias("leg"), "start", F.col("end").alias("finish"))


@query("journey_costs")
def journey_costs(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("journey"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 60).alias("node"))
    legs = journeys.journey_legs(o)
    best = graph.one_to_all(view(spark, d, "arcs"), legs.select(F.col("start").alias("source"), F.col("start").alias("node")))
    return journeys.journey_costs(legs, best)


@query("trimmed_routes", f"{_S}, t as (select *, coalesce(sum(length) over (partition by route order by seq rows between unbounded preceding and 1 preceding), 0) as b, coalesce(sum(length) over (partition by route order by seq rows between 1 following and unbounded following), 0) as a from s) select route, seq from t where b >= 20 and a >= 20")
def trimmed_routes(spark, d):
    return journeys.trim_ends(view(spark, d, "segments"), 20).select("route", "seq")


@query("reused_tails", f"{_S}, t as (select *, coalesce(sum(length) over (partition by route order by seq rows between unbounded preceding and 1 preceding), 0) as b from s) select route, seq from t where b >= 60")
def reused_tails(spark, d):
    return journeys.reuse_tail(view(spark, d, "segments"), 60).select("route", "seq")


@query("merged_turns", f"{_S}, t as (select *, coalesce(sum(length) over (partition by route order by seq rows between unbounded preceding and 1 preceding), 0) as b from s), l as (select *, last_value(case when turn is not null then b end ignore nulls) over (partition by route order by seq rows between unbounded preceding and 1 preceding) as p from t) select route, seq, coalesce(turn is not null and b - p <= 30, false) as merges from l")
def merged_turns(spark, d):
    return journeys.merged_turns(view(spark, d, "segments"), 30).select("route", "seq", "merges")


@query("demoted_keeps", f"{_S}, k as (select route, seq, case turn when 'TL' then 'KL' when 'C' then 'KR' end as turn from s) select route, seq, case when turn in ('KL', 'KR') and lag(turn) over (partition by route order by seq) = turn then 'C' else turn end as turn from k")
def demoted_keeps(spark, d):
    s = view(spark, d, "segments").withColumn("turn", F.when(F.col("turn") == "TL", "KL").when(F.col("turn") == "C", "KR"))
    return journeys.demoted_keeps(s).select("route", "seq", "turn")


@query("merged_regions", "with p as (select o_custkey as id, o_orderkey as region_ord, o_orderstatus = 'F' as complete from orders) select id, region_ord, complete from (select *, row_number() over (partition by id order by complete desc, region_ord desc) as k from p) where k = 1")
def merged_regions(spark, d):
    p = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("region_ord"), (F.col("o_orderstatus") == "F").alias("complete"))
    return journeys.merge_regions(p)


@query("direction_points", "with p as (select p_partkey as point, p_partkey * 7919 % 9000 as x, p_partkey * 104729 % 9000 as y from part), q as (select *, abs(y - cast(round(y / 1000.0::double) as bigint) * 1000) as off, cast(round(y / 1000.0::double) as bigint) as road from p) select point, road, off from q where off <= 300 and point % 2 = 0")
def direction_points(spark, d):
    k = F.col("p_partkey")
    p = spark.read.parquet(f"{d}/part.parquet").select(k.alias("point"), (k * 7919 % 9000).alias("x"), (k * 104729 % 9000).alias("y"), F.when(k % 2 == 0, 80.0).otherwise(10.0).alias("angle"))
    grid = spark.range(11).select(F.col("id").alias("road_id"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct((i * 1000).cast("bigint").alias("x"), (F.col("id") * 1000).alias("y"))).alias("points"))
    got = journeys.direction_points(p, match.legs(grid), 300)
    return got.select("point", F.col("leg.road_id").alias("road"), F.col("off").cast("bigint").alias("off"))


@query("transit_ids", "select o_orderkey as id, case when o_custkey % 3000 < 2048 then (o_orderkey << 22) + ((o_custkey % 3000) << 11) + o_orderkey % 100 end as packed from orders")
def transit_ids(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return spark.read.parquet(f"{d}/orders.parquet").select(k.alias("id"), bits.transit_id(k, c % 3000, k % 100).alias("packed"))


@query("saturated_sums", "select p_partkey as id, cast(least(greatest(p_partkey * 2000000 + cast(p_size as bigint) * 50000000, -2147483648), 2147483647) as int) as total from part")
def saturated_sums(spark, d):
    t = spark.read.parquet(f"{d}/part.parquet")
    return t.select(F.col("p_partkey").alias("id"), bits.saturating_add(F.col("p_partkey") * 2_000_000, F.col("p_size").cast("bigint") * 50_000_000).alias("total"))


@query("parameter_texts", "select p_partkey as id, case when p_size % 2 = 0 then 'avoid,' else '' end || 'height=' || cast(p_size as varchar) || ',' || 'weight=' || printf('%.1f', p_size / 2.0::double) as params from part")
def parameter_texts(spark, d):
    s = F.col("p_size")
    m = F.create_map(F.lit("weight"), text.number_text(s / 2), F.lit("avoid"), F.when(s % 2 == 0, "true").otherwise("false"), F.lit("height"), s.cast("string"))
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), text.parameters_text(m).alias("params"))


@query("dash_patterns", "select p_partkey as id, round(p_size * 1.5::double + 2, 3) as first_dash, round(4 * 1.5::double, 3) as second_dash, 'icon_' || p_brand || '_small' as icon from part")
def dash_patterns(spark, d):
    v = F.concat(F.col("p_size").cast("string"), F.lit(":2_4"))
    tags = F.array(F.struct(F.lit("brand").alias("tag"), F.col("p_brand").alias("value")))
    p = text.dashes(v, 1.5)
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.round(F.get(p, F.lit(0)), 3).alias("first_dash"), F.round(F.get(p, F.lit(1)), 3).alias("second_dash"), text.icon_name(F.lit("icon_?brand?_small"), tags).alias("icon"))


@query("blended_colors", "select p_partkey as id, cast(floor((p_partkey % 256) * 128 / 255) + floor(255 * 64 / 255) * 256 as bigint) as color from part")
def blended_colors(spark, d):
    k = F.col("p_partkey")
    return spark.read.parquet(f"{d}/part.parquet").select(k.alias("id"), bits.blend_bytes(k % 256 + 255 * 256, F.lit(128 + 64 * 256)).alias("color"))
