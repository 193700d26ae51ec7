"""A time field along a route calculated before: how long a place still has to go, judged by the route's place nearest to it.

The nearest place is looked up by cells that widen until one is found, of the place's own
route alone; all else are columns. Places off the route pay for their distance to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import spatial


def _far(ax, ay, bx, by) -> Column:
    return F.sqrt(F.pow((ax - bx).cast("double"), F.lit(2)) + F.pow((ay - by).cast("double"), F.lit(2)))


def direction(points: DataFrame) -> DataFrame:
    """points (route, i, x, y, speed), speed on the way to a place, with rest, the time from it to the end, whole, that of the route, and the neighbours' coordinates."""
    w = W.partitionBy("route").orderBy("i")
    nxt = lambda c: F.lead(c).over(w)
    step = F.coalesce(_far(F.col("x"), F.col("y"), nxt("x"), nxt("y")) / nxt("speed"), F.lit(0.0))
    p = points.withColumn("_step", step).withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w), "nx": nxt("x"), "ny": nxt("y")})
    back = W.partitionBy("route").orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)
    return p.withColumn("rest", F.sum("_step").over(back)).withColumn("whole", F.max("rest").over(W.partitionBy("route"))).drop("_step")


def of_slices(slices: DataFrame, max_speed: float) -> DataFrame:
    """Points (route, i, x, y, speed) of route slices (route, seq, points, length, seconds): each slice's mean speed, or max_speed where it has none; a slice's first point is the one before's last."""
    speed = F.when((F.col("seconds") == 0) | (F.col("length") == 0), float(max_speed)).otherwise(F.col("length") / F.col("seconds"))
    p = slices.select("route", "seq", speed.alias("speed"), F.posexplode("points").alias("k", "p")).where("k > 0")
    return p.select("route", (F.row_number().over(W.partitionBy("route").orderBy("seq", "k")) - 1).alias("i"), "p.x", "p.y", "speed")


def nearest_place(asked: DataFrame, line: DataFrame, width: int) -> DataFrame:
    """asked (id, route, x, y) with the place (at, of direction()) of its route nearest to it and its distance; ties to the earlier. Routes without places have no row."""
    place = line.select("route", F.col("x").alias("x2"), F.col("y").alias("y2"), "i", F.struct(*(c for c in line.columns if c != "route")).alias("at"))
    return spatial.nearest(asked, place, "id", _far(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")), "i", width, on=["route"]).drop("x2", "y2", "i", "rank")


def deviation(at: Column, x: Column, y: Column) -> Column:
    """Distance to the leg from the nearest place to the closer of its neighbours; 0 at the ends of the route."""
    later = _far(x, y, at["nx"], at["ny"]) <= _far(x, y, at["px"], at["py"])
    bx, by = F.when(later, at["nx"]).otherwise(at["px"]), F.when(later, at["ny"]).otherwise(at["py"])
    dx, dy = (bx - at["x"]).cast("double"), (by - at["y"]).cast("double")
    sq = dx * dx + dy * dy
    u = F.when(sq == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - at["x"]) * dx + (y - at["y"]) * dy) / sq)))
    off = F.sqrt(F.pow(x - at["x"] - dx * u, F.lit(2)) + F.pow(y - at["y"] - dy * u, F.lit(2)))
    return F.when(at["nx"].isNull() | at["px"].isNull(), 0.0).otherwise(off)


def adopted(line: DataFrame, ends: DataFrame, width: int, max_speed: float) -> DataFrame:
    """The part of each route between the places nearest to a journey's start and target: direction() rows with start_time and end_time, from the start to its place and from its place to the target.

    ends: (route, sx, sy, ex, ey). A target that lies before its start leaves nothing.
    """
    ask = lambda p: ends.select(F.struct("route", F.lit(p)).alias("id"), "route", F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y"))
    near = nearest_place(ask("s").union(ask("e")), line, width)
    one = lambda p, n: near.where(F.col("id.col2") == p).select("route", F.col("at.i").alias(f"_{p}"), (F.col("distance") / float(max_speed)).alias(n))
    cut = line.join(one("s", "start_time"), "route").join(one("e", "end_time"), "route").where("i >= _s and i <= _e").drop("_s", "_e")
    kept = direction(cut.select("route", "i", "x", "y", "speed"))
    return kept.join(cut.select("route", "i", "start_time", "end_time"), ["route", "i"])


def time_estimate(asked: DataFrame, line: DataFrame, width: int, min_speed: float) -> DataFrame:
    """Rows (id, seconds): for asked (id, route, x, y, to_start) the time to the journey's target, or from its start, over an adopted() route.

    Null where the nearest place is that end itself, as the route then says nothing.
    """
    near = nearest_place(asked, line, width)
    at = F.col("at")
    late = deviation(at, F.col("x"), F.col("y")) / float(min_speed)
    ahead = F.when(at["nx"].isNotNull(), at["rest"] + late + at["end_time"])
    behind = F.when(at["px"].isNotNull(), at["whole"] - at["rest"] + late + at["start_time"])
    return near.select("id", F.when(F.col("to_start"), behind).otherwise(ahead).alias("seconds"))
