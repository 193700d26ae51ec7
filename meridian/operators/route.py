"""Ordered-route operators as window functions: route rows have route, seq and per-segment columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cumulated(trace: DataFrame, dist, key: str = "trace", order: str = "ind") -> DataFrame:
    """Adds leg (dist from the row before, 0 at the first) and total (running sum)."""
    w = W.partitionBy(key).orderBy(order)
    leg = F.coalesce(dist(lambda c: F.lag(c).over(w)), F.lit(0.0))
    return trace.withColumn("leg", leg).withColumn("total", F.sum("leg").over(w.rowsBetween(W.unboundedPreceding, 0)))


def turn_sections(route: DataFrame, key: str = "route", order: str = "seq", turn: str = "turn", length: str = "length") -> DataFrame:
    """One row a section from a turn to the next: (key, section, turn, segments, length)."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    s = route.withColumn("section", F.sum(F.col(turn).isNotNull().cast("int")).over(w))
    return s.groupBy(key, "section").agg(F.max(turn).alias("turn"), F.count("*").alias("segments"), F.sum(length).alias("length"))


def remaining(route: DataFrame, value: str, key: str = "route", order: str = "seq") -> DataFrame:
    """Adds remaining: the sum of value over the rows after."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(1, W.unboundedFollowing)
    return route.withColumn("remaining", F.coalesce(F.sum(value).over(w), F.lit(0)))


def merge_slices(slices: DataFrame, key: str = "route", order: str = "seq", road: str = "road_id", start: str = "i", end: str = "j") -> DataFrame:
    """Consecutive slices of one road that go on where the last ended, in the same direction, become one."""
    w = W.partitionBy(key).orderBy(order)
    way = F.signum(F.col(end) - F.col(start))
    same = (F.lag(road).over(w) == F.col(road)) & (F.lag(end).over(w) == F.col(start)) & (F.lag(way).over(w) == way)
    s = slices.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int"))
    s = s.withColumn("island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy(key, "island").agg(F.first(road).alias(road), F.min_by(start, order).alias(start), F.max_by(end, order).alias(end), F.count("*").alias("slices"))


def fill_heights(points: DataFrame, height: str = "height", at: str = "total", key: str = "road_id", order: str = "i") -> DataFrame:
    """Unknown heights between known ones, linear in distance; before the first and after the last stay unknown."""
    back = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(key).orderBy(order).rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col(height).isNotNull(), F.col(at))
    p = points.withColumns({"_h0": F.last(height, True).over(back), "_h1": F.first(height, True).over(ahead), "_d0": F.last(known, True).over(back), "_d1": F.first(known, True).over(ahead)})
    mid = F.when(F.col("_d1") == F.col("_d0"), F.col("_h0")).otherwise(F.col("_h0") + (F.col("_h1") - F.col("_h0")) * (F.col(at) - F.col("_d0")) / F.nullif(F.col("_d1") - F.col("_d0"), F.lit(0)))
    return p.withColumn("filled", F.coalesce(F.col(height), mid)).drop("_h0", "_h1", "_d0", "_d1")


def mute_repeats(route: DataFrame, key: str = "route", order: str = "seq", turn: str = "turn") -> DataFrame:
    """Adds spoken: false where a turn only repeats 'C' (straight on) after another 'C'."""
    w = W.partitionBy(key).orderBy(order)
    again = (F.col(turn) == "C") & (F.lag(turn).over(w) == "C")
    return route.withColumn("spoken", ~F.coalesce(again, F.lit(False)))


def totals(legs: DataFrame, key: str = "route") -> DataFrame:
    """Of public-transport legs (walk, ride, stops, seconds): sums and changes, one row a route."""
    return legs.groupBy(key).agg(F.sum("walk").alias("walk"), F.sum("ride").alias("ride"), F.sum("stops").alias("stops"), F.sum("seconds").alias("seconds"), (F.count("*") - 1).alias("changes"))


def first_beyond(trace: DataFrame, distance: float, key: str = "trace", order: str = "ind", at: str = "total") -> DataFrame:
    """Adds next: the first later point more than distance along, null if the trace ends before."""
    w = W.partitionBy(key).orderBy(F.col(at)).rangeBetween(distance, W.unboundedFollowing)
    beyond = F.min(F.struct(F.col(at), F.col(order))).over(w)
    return trace.withColumn("next", F.when(beyond[at] >= F.col(at) + distance, beyond[order]))
