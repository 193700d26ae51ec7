"""Queries over planar predicates, style sheets, whole map searches and more route windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import bits, hours, planar, text, tile
from ..operators import match, route, search, style_sheet
from .views import SQL, features, view

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


_B = f"with b as ({SQL['boxes']})"


def _pt(x, y):
    return F.struct(x.alias("x"), y.alias("y"))


@query("segments_meet", "with p as (select p_partkey as id, p_partkey % 20 as ax, p_partkey * 3 % 20 as ay, p_partkey * 7 % 20 as bx, p_partkey * 11 % 20 as byy, p_size % 20 as cx, p_size * 3 % 20 as cy, p_size * 5 % 20 as dx, p_size * 7 % 20 as dy from part), o as (select *, sign((bx - ax) * (cy - ay) - (byy - ay) * (cx - ax)) as o1, sign((bx - ax) * (dy - ay) - (byy - ay) * (dx - ax)) as o2, sign((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) as o3, sign((dx - cx) * (byy - cy) - (dy - cy) * (bx - cx)) as o4 from p) select id, (o1 <> o2 and o3 <> o4) or (o1 = 0 and cx between least(ax, bx) and greatest(ax, bx) and cy between least(ay, byy) and greatest(ay, byy)) or (o2 = 0 and dx between least(ax, bx) and greatest(ax, bx) and dy between least(ay, byy) and greatest(ay, byy)) or (o3 = 0 and ax between least(cx, dx) and greatest(cx, dx) and ay between least(cy, dy) and greatest(cy, dy)) or (o4 = 0 and bx between least(cx, dx) and greatest(cx, dx) and byy between least(cy, dy) and greatest(cy, dy)) as meet from o")
def segments_meet(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size").cast("bigint")
    ends = [_pt(k % 20, k * 3 % 20), _pt(k * 7 % 20, k * 11 % 20), _pt(s % 20, s * 3 % 20), _pt(s * 5 % 20, s * 7 % 20)]
    return spark.read.parquet(f"{d}/part.parquet").select(k.alias("id"), planar.segments_meet(*ends).alias("meet"))


@query("ring_contains", f"{_B}, q as (select *, cx + dx * 2 / 3 as px, cy + dy / 3 as py, cx + dx / 4 as qx from b) select id, cast(py - cy as double) / dy < cast(px - cx as double) / dx as inside, cast(py - cy as double) / dy < cast(qx - cx as double) / dx as second, true as clockwise from q")
def ring_contains(spark, d):
    f = features(spark, d)
    x, y, dx, dy = (F.col(c) for c in ("cx", "cy", "dx", "dy"))
    p = F.col("points")
    return f.select("id", planar.ring_contains(p, x + dx * 2 / 3, y + dy / 3).alias("inside"), planar.ring_contains(p, x + dx / 4, y + dy / 3).alias("second"), planar.clockwise(p).alias("clockwise"))


@query("box_overlap", f"{_B} select id, round(greatest(least(cx + dx, 1000000000) - greatest(cx, 0), 0)::double * greatest(least(cy + dy, 1000000000) - greatest(cy, 0), 0) / 1e9, 3) as shared from b")
def box_overlap(spark, d):
    x, y = F.col("cx"), F.col("cy")
    other = tuple(F.lit(v).cast("bigint") for v in (0, 0, 1_000_000_000, 1_000_000_000))
    return view(spark, d, "boxes").select("id", F.round(planar.overlap_area((x, y, x + F.col("dx"), y + F.col("dy")), other) / 1e9, 3).alias("shared"))


@query("road_heading", f"{_B} select id, round(case when dx >= 500000 then 90 else degrees(atan2(dx, -dy)) end, 5) as heading from b")
def road_heading(spark, d):
    return features(spark, d).select("id", F.round(planar.heading(F.col("points"), F.lit(0), True, 500_000.0), 5).alias("heading"))


SHEET = """<style name="day"><property name="night"/><constant name="main" value="#ff8800"/>
<group minzoom="8"><rule tag="brand" value="Brand#11" color="$main" width="3"><also additional="type" width="4"/><also night="true" color="#222222"/></rule>
<rule tag="brand" color="#cccccc" width="1"/></group><rule color="#000000"/></style>"""


@query("style_outputs", "select p_partkey as id, case when p_size % 10 + 5 >= 8 and p_brand = 'Brand#11' then '#222222' when p_size % 10 + 5 >= 8 then '#cccccc' else '#000000' end as color, case when p_size % 10 + 5 >= 8 and p_brand = 'Brand#11' then '4' when p_size % 10 + 5 >= 8 then '1' end as width from part")
def style_outputs(spark, d):
    # the rule without a tag stands last, so it only catches what nothing else does
    sheet = SHEET.replace('<rule color="#000000"/>', "")
    out = style_sheet.compile_sheet(sheet, F.col("tags"), F.col("min_zoom"), {"night": "true"})
    return features(spark, d).select("id", F.coalesce(out["color"], F.lit("#000000")).alias("color"), out["width"].alias("width"))


def _sources(spark, d):
    f = features(spark, d).withColumn("is_base", F.col("id") % 9 == 0)
    k = F.col("id")
    extra = F.when(k % 5 == 0, F.array(_tag("natural", "coastline"))).when(k % 97 == 0, F.array(_tag("change", "delete"))).otherwise(F.array().cast("array<struct<tag:string,value:string>>"))
    f = f.withColumn("tags", F.concat("tags", extra))
    return f.where("id % 3 > 0").unionByName(f.where("id % 2 = 0 or id % 3 = 0").withColumn("file_ord", F.lit(1)))


def _tag(k, v):
    return F.struct(F.lit(k).alias("tag"), F.lit(v).alias("value"))


_FOUND = f"{_B}, s as (select *, 0 as src from b where id % 3 > 0 union all select *, 1 from b where id % 2 = 0 or id % 3 = 0), f as (select * from s where min_zoom <= 10 and max_zoom >= 10 and cx + dx >= 0 and cx <= 1073741823 and cy + dy >= 0 and cy <= 1073741823 and not (id % 97 = 0 and id % 5 <> 0)), k as (select *, row_number() over (partition by id order by src) as n from f), found as (select *, case when id % 5 = 0 then 'coast' when id % 9 = 0 then 'base' else 'detail' end as kind from k where n = 1)"


@query("map_search", f"{_FOUND} select id, kind from found")
def map_search(spark, d):
    from ..operators.scan import tile_box

    return search.map_search(_sources(spark, d), tile_box(1, 0, 0), 10).select("id", "kind")


@query("class_counts", f"{_FOUND} select kind, count(*) as n, min(cx) as \"left\", min(cy) as top, max(cx + dx) as \"right\", max(cy + dy) as bottom from found group by kind")
def class_counts(spark, d):
    from ..operators.scan import tile_box

    return search.class_counts(search.map_search(_sources(spark, d), tile_box(1, 0, 0), 10))


@query("next_beyond", f"with v as (select road_id as trace, i as ind, i * 10 as total from ({SQL['vertices']})) select trace, ind, (select min(w.ind) from v w where w.trace = v.trace and w.total >= v.total + 20) as next from v")
def next_beyond(spark, d):
    v = view(spark, d, "vertices").select(F.col("road_id").alias("trace"), F.col("i").alias("ind"), (F.col("i") * 10).alias("total"))
    return route.first_beyond(v, 20).select("trace", "ind", "next")


@query("close_traces", f"with p as (select trace, row_number() over (partition by trace order by ind) as ind, cast(trunc(lon * 1e3) as bigint) as x, cast(trunc(lat * 1e3) as bigint) as y from ({SQL['points']})), h as (select a.trace, a.ind, coalesce(bool_or(abs(a.x - b.x) <= 1500 and abs(a.y - b.y) <= 1500), false) as hit from p a left join p b on a.trace = b.trace and b.ind between a.ind + 1 and a.ind + 3 group by a.trace, a.ind) select trace, bool_and(hit) as close from h group by trace")
def close_traces(spark, d):
    from pyspark.sql import Window as W

    p = view(spark, d, "points").withColumn("ind", F.row_number().over(W.partitionBy("trace").orderBy("ind")))
    p = p.select("trace", "ind", (F.col("lon") * 1e3).cast("bigint").alias("x"), (F.col("lat") * 1e3).cast("bigint").alias("y"))
    ahead = p.withColumn("ind", F.col("ind") - 2)
    return match.close_to(p, ahead, 1500, 1)


@query("unrepeated_points", f"{_B} select id, case when dx > 600000 then 3 else 1 end as n from b")
def unrepeated_points(spark, d):
    p = [F.get("points", F.lit(i)) for i in (0, 1, 0)]
    return features(spark, d).select("id", F.size(planar.outlier_free(F.array(*p), 600_000.0)).alias("n"))


@query("hours_texts")
def hours_texts(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")


    def run(t: pd.Series) -> pd.Series:
        return pd.Series([hours.describe("Mo-Fr 08:00-18:00; Sa 09:00-13:00", x.to_pydatetime()) for x in t], dtype=object)

    return e.select(F.col("event_id").alias("id"), F.pandas_udf(run, "string")("ts").alias("text"))


@query("trimmed_words", "select doc_id as id, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) as trimmed from documents")
def trimmed_words(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.md5(text.trim_blank(F.col("text")).cast("binary")).alias("trimmed"))


@query("tile_cells", f"with p as ({SQL['places']}), t as (select id, cast(trunc((lon + 180) / 360 * 2147483648::double) as bigint) as x31, cast(trunc((1 - ln(tan(lat / 180.0 * pi()) + 1 / cos(lat / 180.0 * pi())) / pi()) / 2 * 2147483648::double) as bigint) as y31 from p) select (x31 >> 25) * 64 + (y31 >> 25) as cell, count(*) as n, min(id) as first_id from t group by 1")
def tile_cells(spark, d):
    p = view(spark, d, "places").select("id", tile.tile_id(tile.x31(F.col("lon")), tile.y31(F.col("lat")), 6).alias("cell"))
    return p.groupBy("cell").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("lane_packing", "select p_partkey as id, (p_partkey % 11) * 2 + (p_size % 11) * 32 + (p_size % 7) * 1024 + case when p_size % 2 = 0 then 1 else 0 end as lane from part")
def lane_packing(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size").cast("bigint")
    return spark.read.parquet(f"{d}/part.parquet").select(k.alias("id"), bits.pack_lane(k % 11, s % 11, s % 7, s % 2 == 0).alias("lane"))
