"""Routes over several targets, direction points, and overlay regions that meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def journey_legs(stops: DataFrame) -> DataFrame:
    """Rows (journey, leg, start, end) of journeys (journey, seq, node): one leg from each target to the next."""
    w = W.partitionBy("journey").orderBy("seq")
    return stops.withColumn("end", F.lead("node").over(w)).where("end is not null").select("journey", (F.row_number().over(w) - 1).alias("leg"), F.col("node").alias("start"), "end")


def journey_costs(legs: DataFrame, best: DataFrame) -> DataFrame:
    """Rows (journey, cost, legs, missing): legs joined with least costs (source, node, cost); a leg without a way counts as missing."""
    b = best.select(F.col("source").alias("start"), F.col("node").alias("end"), "cost")
    return legs.join(b, ["start", "end"], "left").groupBy("journey").agg(F.sum("cost").alias("cost"), F.count("*").alias("legs"), F.sum(F.col("cost").isNull().cast("int")).alias("missing"))


def direction_points(points: DataFrame, legs: DataFrame, reach: int, turn: float = 45.0) -> DataFrame:
    """Each direction point (point, x, y, angle or null) with the road leg it stands on: the nearest in reach whose bearing fits.

    Rows (point, leg, off). A point with an angle takes a leg within turn degrees of it,
    either way along the road.
    """
    from ..functions import angle, planar
    from .match import candidates

    p = points.select(F.col("point").alias("trace"), F.lit(0).alias("ind"), "x", "y", "angle")
    c = candidates(p, legs, reach)
    along = planar.bearing(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    away = F.abs(angle.degrees_diff(F.col("angle"), along))
    fits = F.col("angle").isNull() | (away <= turn) | (away >= 180 - turn)
    return c.where(fits).groupBy("trace").agg(F.min(F.struct("off", "leg")).alias("m")).select(F.col("trace").alias("point"), "m.leg", "m.off")


def merge_regions(points: DataFrame) -> DataFrame:
    """One row an overlay point of several regions (id, region_ord, complete, ...): a complete one before an incomplete one, the later of equals."""
    w = W.partitionBy("id").orderBy(F.desc("complete"), F.desc("region_ord"))
    return points.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def reuse_tail(route: DataFrame, keep_after: float, key: str = "route", order: str = "seq", length: str = "length") -> DataFrame:
    """The part of an old route that a recalculation keeps: the segments from the first that starts keep_after along."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return route.withColumn("_at", F.coalesce(F.sum(length).over(w), F.lit(0))).where(F.col("_at") >= keep_after).drop("_at")


def trim_ends(route: DataFrame, cut: float, key: str = "route", order: str = "seq", length: str = "length") -> DataFrame:
    """A route without the segments within cut of either end: what a precalculated direction keeps."""
    w = W.partitionBy(key).orderBy(order)
    before = F.coalesce(F.sum(length).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.coalesce(F.sum(length).over(w.rowsBetween(1, W.unboundedFollowing)), F.lit(0))
    return route.withColumns({"_b": before, "_a": after}).where((F.col("_b") >= cut) & (F.col("_a") >= cut)).drop("_b", "_a")


def merged_turns(route: DataFrame, reach: float, key: str = "route", order: str = "seq") -> DataFrame:
    """Adds merges: whether a turn comes within reach after the one before it, so that both are told together."""
    w = W.partitionBy(key).orderBy(order)
    at = F.coalesce(F.sum("length").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    r = route.withColumn("_at", at)
    last = F.last(F.when(F.col("turn").isNotNull(), F.col("_at")), True).over(w.rowsBetween(W.unboundedPreceding, -1))
    return r.withColumn("merges", F.coalesce(F.col("turn").isNotNull() & (F.col("_at") - last <= reach), F.lit(False))).drop("_at")


def demoted_keeps(route: DataFrame, key: str = "route", order: str = "seq") -> DataFrame:
    """turn with a keep (KL, KR) that repeats the keep before it made straight on."""
    w = W.partitionBy(key).orderBy(order)
    again = F.col("turn").isin("KL", "KR") & (F.lag("turn").over(w) == F.col("turn"))
    return route.withColumn("turn", F.when(again, "C").otherwise(F.col("turn")))


def progress(done: Column, total: Column, start: float, share: float) -> Column:
    """Per cent of a stage that takes a share of the whole after start, never above its end."""
    return F.lit(start) + share * F.least(F.coalesce(done / F.nullif(total, F.lit(0)), F.lit(0.0)), F.lit(1.0))
