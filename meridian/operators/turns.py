"""Turn instructions from an ordered route, as windows over its segments.

route rows: route, seq, road_id, bearing_in, bearing_out (degrees at the segment's start
and end), length, roundabout, and n_side: roads that meet the segment's end beside the route.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import angle


def turns(route: DataFrame, key: str = "route", order: str = "seq") -> DataFrame:
    """Adds angle (to the segment before, left positive) and turn: null at the first segment and where no road meets.

    A run of roundabout segments is one turn at its first, RNDB with the number of exits passed.
    """
    w = W.partitionBy(key).orderBy(order)
    a = angle.degrees_diff(F.lag("bearing_out").over(w), F.col("bearing_in"))
    r = route.withColumn("angle", a).withColumn("_first", F.col("roundabout") & ~F.coalesce(F.lag("roundabout").over(w), F.lit(False)))
    r = r.withColumn("_ring", F.sum(F.col("_first").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    ring = W.partitionBy(key, "_ring", "roundabout")
    exits = F.sum("n_side").over(ring)
    plain = F.when(F.coalesce(F.lag("n_side").over(w), F.lit(0)) > 0, angle.turn_by_angle(F.col("angle")))
    turn = F.when(F.col("_first"), F.concat(F.lit("RNDB"), F.greatest(exits, F.lit(1)).cast("string"))).when(F.col("roundabout"), F.lit(None)).when(F.lag("roundabout").over(w), F.lit(None)).otherwise(plain)
    return r.withColumn("turn", F.when(F.col("angle").isNotNull() | F.col("_first"), turn)).drop("_first", "_ring")


def uturns(route: DataFrame, key: str = "route", order: str = "seq", reach: float = 50.0) -> DataFrame:
    """Adds uturn: two turns to one side within reach metres that together turn back (150 degrees or more)."""
    w = W.partitionBy(key).orderBy(order)
    nxt = F.lead("angle").over(w)
    both = (F.abs(F.col("angle") + nxt) >= 150) & (F.signum("angle") == F.signum(nxt)) & (F.col("length") < reach)
    return route.withColumn("uturn", F.coalesce(both, F.lit(False)))


def next_turn_distance(route: DataFrame, key: str = "route", order: str = "seq") -> DataFrame:
    """Adds to_turn: metres from a segment's start to the next turn after it, null if none comes."""
    back = W.partitionBy(key).orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, 0)
    r = route.withColumn("_end", F.sum("length").over(back))
    ahead = W.partitionBy(key).orderBy(order).rowsBetween(1, W.unboundedFollowing)
    at = F.first(F.when(F.col("turn").isNotNull(), F.col("_end")), ignorenulls=True).over(ahead)
    return r.withColumn("to_turn", F.col("_end") - at).drop("_end")


def street_names(route: DataFrame, key: str = "route", order: str = "seq", name: str = "name") -> DataFrame:
    """Adds street: a segment's name, else its neighbour's before, else the one after."""
    w = W.partitionBy(key).orderBy(order)
    e = lambda c: F.nullif(c, F.lit(""))
    return route.withColumn("street", F.coalesce(e(F.col(name)), e(F.lag(name).over(w)), e(F.lead(name).over(w)), F.lit("")))


def connected(route: DataFrame, dist, limit: float, key: str = "route", order: str = "seq") -> DataFrame:
    """Rows where a segment starts farther than limit from the end of the one before: (key, order, gap)."""
    w = W.partitionBy(key).orderBy(order)
    gap = dist(F.lag("x_end").over(w), F.lag("y_end").over(w), F.col("x"), F.col("y"))
    return route.withColumn("gap", gap).where(F.col("gap") > limit).select(key, order, "gap")


def side_roads(route: DataFrame, junction_roads: DataFrame) -> DataFrame:
    """Roads that meet a route's segment ends, but for the route's own: route has route, seq, x_end, y_end, road_id; roads have x, y, road_id.

    Rows (route, seq, side): neither the segment's road nor the next one's.
    """
    w = W.partitionBy("route").orderBy("seq")
    r = route.withColumn("_next", F.lead("road_id").over(w)).withColumnRenamed("road_id", "_own")
    j = junction_roads.select(F.col("x").alias("x_end"), F.col("y").alias("y_end"), F.col("road_id").alias("side"))
    return r.join(j, ["x_end", "y_end"]).where((F.col("side") != F.col("_own")) & ~F.col("side").eqNullSafe(F.col("_next"))).select("route", "seq", "side").distinct()


def split_at_junctions(slices: DataFrame, junctions: DataFrame, key: str = "route", order: str = "seq") -> DataFrame:
    """Route slices (route, seq, road_id, i, j) cut where another road meets them inside: junctions has road_id, at.

    Rows (route, seq, piece, road_id, i, j), pieces in the direction of travel.
    """
    inner = F.array_distinct(F.filter(F.col("_at"), lambda p: (p > F.least("i", "j")) & (p < F.greatest("i", "j"))))
    at = junctions.groupBy("road_id").agg(F.collect_set("at").alias("_at"))
    s = slices.join(at, "road_id", "left").withColumn("_at", F.coalesce("_at", F.array().cast(f"array<{slices.schema['i'].dataType.simpleString()}>")))
    cuts = F.array_sort(F.concat(F.array("i", "j"), inner))
    s = s.withColumn("_c", F.when(F.col("i") <= F.col("j"), cuts).otherwise(F.reverse(cuts)))
    n = F.size("_c")
    legs = F.arrays_zip(F.slice("_c", 1, n - 1).alias("i"), F.slice("_c", 2, n - 1).alias("j"))
    return s.select(key, order, "road_id", F.posexplode(legs).alias("piece", "_l")).select(key, order, "piece", "road_id", F.col("_l.i").alias("i"), F.col("_l.j").alias("j"))


def keep_turns(route: DataFrame) -> DataFrame:
    """turn where a way goes straight on beside another that does nearly so too: keep left or right of it.

    route has turn and the number of side roads that go on within 45 degrees, n_left and n_right.
    """
    keep = F.when(F.col("turn").isin("C", "TSLL", "TSLR"), F.when((F.col("n_right") > 0) & (F.col("n_left") == 0), "KL").when((F.col("n_left") > 0) & (F.col("n_right") == 0), "KR"))
    return route.withColumn("turn", F.coalesce(keep, F.col("turn")))


def without_minor_stops(points: DataFrame, side_class) -> DataFrame:
    """Stop signs of a route (route, seq, priority) whose side roads are all of a lower class: those rows go.

    side_class: rows (route, seq, priority) of the side roads, larger numbers lesser classes.
    """
    least = side_class.groupBy("route", "seq").agg(F.min("priority").alias("_least"))
    return points.join(least, ["route", "seq"], "left").where("_least is null or _least <= priority").drop("_least")
