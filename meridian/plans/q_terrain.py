"""Queries over height tiles: every part is a tile of sixteen by sixteen heights on a grid sixty-four tiles wide."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import terrain
from ..operators.raster import NODATA
from ..sources import geotiff
from .views import dealt

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SIDE, CELL = 16, 30.0


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _tiles(spark, d):
    """Tiles as files' bytes and read from them: heights are those of the whole grid's pixels, some not known."""
    k = F.col("p_partkey")
    t = dealt(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size"), "p_partkey").select(F.lit(9).alias("zoom"), (k % 64).alias("x"), F.floor(k / 64).alias("y"), F.col("p_size").cast("bigint").alias("lift"))
    x, y = (lambda i: F.col("x") * SIDE + i % SIDE), (lambda i: F.col("y") * SIDE + F.floor(i / SIDE))
    h = F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda i: F.when((x(i) * 13 + y(i) * 7) % 101 == 0, F.lit(NODATA)).otherwise((x(i) * x(i) * 7 + y(i) * 31 + x(i) * y(i) * 3) % 977 + F.col("lift")).cast("float"))
    files = t.select("zoom", "x", "y", geotiff.encoded(h, SIDE).alias("content"))
    return geotiff.decoded(files).select("zoom", "x", "y", "heights")


PIXELS = """t as (select p_partkey % 64 as x, p_partkey // 64 as y, cast(p_size as bigint) as lift from part),
w as (select t.x as tx, t.y as ty, t.x * 16 + i % 16 as x, t.y * 16 + i // 16 as y, lift from t, (select unnest(range(0, 256)) as i) g),
p as (select tx, ty, x, y, case when (x * 13 + y * 7) % 101 <> 0 then ((x * x * 7 + y * 31 + x * y * 3) % 977 + lift)::double end as h from w)"""
_NEAR = " ".join(f"left join p p{i} on p{i}.x = c.x + {dx} and p{i}.y = c.y + {dy}" for i, (dx, dy) in enumerate(terrain.AROUND))
_N = {d: f"coalesce(p{i}.h, c.h)" for i, d in enumerate(terrain.AROUND)}
_DX = f"(({_N[1, -1]} + 2 * {_N[1, 0]} + {_N[1, 1]}) - ({_N[-1, -1]} + 2 * {_N[-1, 0]} + {_N[-1, 1]})) / 240.0::double"
_DY = f"(({_N[-1, 1]} + 2 * {_N[0, 1]} + {_N[1, 1]}) - ({_N[-1, -1]} + 2 * {_N[0, -1]} + {_N[1, -1]})) / 240.0::double"


@query(
    "terrain_slopes",
    f"""with {PIXELS}, s as (select c.tx, c.ty, degrees(atan(sqrt(power({_DX}, 2) + power({_DY}, 2)))) as s from p c {_NEAR} where c.h is not null)
select tx as x, ty as y, count(*) as n_known, cast(round(avg(s), 2) as double) as slope_mean from s group by tx, ty""",
)
def terrain_slopes(spark, d):
    known = F.filter("slope", lambda s: s != NODATA)
    total = F.aggregate(known, F.lit(0.0), lambda a, s: a + s)
    t = terrain.shaded(_tiles(spark, d), SIDE, CELL).where(F.size(known) > 0)
    return t.select("x", "y", F.size(known).cast("bigint").alias("n_known"), F.round(total / F.size(known), 2).alias("slope_mean"))


@query(
    "terrain_pyramid",
    f"""with {PIXELS}, a as (select x // 2 as x, y // 2 as y, avg(h) as h from p where h is not null group by x // 2, y // 2),
b as (select x // 2 as x, y // 2 as y, avg(h) as h from a group by x // 2, y // 2)
select 7 as zoom, x // 16 as x, y // 16 as y, count(*) as n_known, round(avg(h), 1) as mean from b group by x // 16, y // 16""",
)
def terrain_pyramid(spark, d):
    t = terrain.coarser(terrain.coarser(_tiles(spark, d), SIDE, "average"), SIDE, "average")
    known = F.filter("heights", lambda h: h != NODATA)
    total = F.aggregate(known, F.lit(0.0), lambda a, h: a + h)
    return t.where(F.size(known) > 0).select("zoom", "x", "y", F.size(known).cast("bigint").alias("n_known"), F.round(total / F.size(known), 1).alias("mean"))
