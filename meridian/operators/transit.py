"""Public-transport tables: merging stops of several files, stitching route parts, timetables, results.

stops: file_ord, id, x, y, deleted (array of route ids), is_deleted. parts: route, part (order), stops (array of struct id, x, y).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge_stops(stops: DataFrame) -> DataFrame:
    """One row an id: the first file's place, the route ids deleted by any later file, gone if a file deletes the stop."""
    first = F.min_by(F.struct("x", "y"), "file_ord").alias("p")
    out = stops.groupBy("id").agg(first, F.array_distinct(F.flatten(F.collect_list("deleted"))).alias("deleted"), F.max("is_deleted").alias("_gone"))
    return out.where("not _gone").select("id", "p.x", "p.y", F.array_sort("deleted").alias("deleted"))


def stops_near(points: DataFrame, stops: DataFrame, reach: int) -> DataFrame:
    """Stops in the square around each point (point, x, y), an id once a point: rows (point, stop)."""
    from .spatial import within

    s = stops.select(F.col("id").alias("stop"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return within(points, s, reach).select("point", "stop").distinct()


def stitch(parts: list[list[tuple]], reach: float = 40.0) -> list[list[tuple]]:
    """Parts of a route, each stops (id, x, y), joined where one ends with what another starts with.

    A shared run of stops joins once; then ends join starts within reach, the nearest first.
    """
    left = [list(p) for p in parts if p]
    joined = True
    while joined:
        joined = False
        for i in range(len(left)):
            for j in range(len(left)):
                if i == j:
                    continue
                ids, other = [s[0] for s in left[i]], [s[0] for s in left[j]]
                n = next((k for k in range(min(len(ids), len(other)), 0, -1) if ids[-k:] == other[:k]), 0)
                if n:
                    left[i] += left[j][n:]
                    del left[j]
                    joined = True
                    break
            if joined:
                break
    while True:
        gaps = [(math.hypot(a[-1][1] - b[0][1], a[-1][2] - b[0][2]), i, j) for i, a in enumerate(left) for j, b in enumerate(left) if i != j]
        gaps = [g for g in gaps if g[0] <= reach]
        if not gaps:
            return left
        _, i, j = min(gaps)
        left[i] += left[j]
        del left[j]


def combine_routes(parts: DataFrame, reach: float = 40.0) -> DataFrame:
    """Rows (route, piece, stops): every route's parts stitched; pieces that stay apart are numbered."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        got = stitch([[(s["id"], s["x"], s["y"]) for s in p] for p in pdf.sort_values("part").stops], reach)
        return pd.DataFrame([(pdf.route.iloc[0], k, [int(s[0]) for s in p]) for k, p in enumerate(got)], columns=["route", "piece", "stops"])

    return parts.select("route", "part", "stops").groupBy("route").applyInPandas(solve, "route long, piece int, stops array<long>")


def timetable(routes: DataFrame) -> DataFrame:
    """Rows (route, trip, seq, at): trips (intervals between departures) expanded over stops (intervals between stops, waits)."""
    trip = routes.select("route", "stop_intervals", "waits", F.posexplode("trip_intervals").alias("trip", "_gap"))
    w = W.partitionBy("route").orderBy("trip").rowsBetween(W.unboundedPreceding, 0)
    trip = trip.withColumn("_start", F.sum("_gap").over(w))
    n = F.size("stop_intervals")
    at = F.transform(F.sequence(F.lit(0), n), lambda k: F.col("_start") + F.when(k > 0, F.aggregate(F.slice("stop_intervals", 1, F.greatest(k, F.lit(1))), F.lit(0).cast("bigint"), lambda s, v: s + v) + F.aggregate(F.slice("waits", 1, F.greatest(k, F.lit(1))), F.lit(0).cast("bigint"), lambda s, v: s + v)).otherwise(0))
    return trip.select("route", "trip", F.posexplode(at).alias("seq", "at"))


def next_departures(calls: DataFrame, wanted: DataFrame, wait: int) -> DataFrame:
    """For each wish (wish, route, seq, at) the first trip that leaves that stop within wait: (wish, trip, dep)."""
    c = calls.select("route", "seq", "trip", F.col("at").alias("dep"))
    ok = (F.col("dep") >= F.col("at")) & (F.col("dep") <= F.col("at") + wait)
    return wanted.join(c, ["route", "seq"]).where(ok).groupBy("wish").agg(F.min(F.struct("dep", "trip")).alias("m")).select("wish", "m.trip", "m.dep")


def best_results(results: DataFrame, limit: int) -> DataFrame:
    """The first results of each query by seconds (ties by id), without those that ride a better one's routes and more.

    results: query, id, seconds, routes (array). A result goes if a faster one's routes are all among its own.
    Of results with the same routes only the first can stay or take out others, so sets of
    routes are compared, and of those only the ones whose first route is among the other's.
    """
    a = results.select("query", "id", "seconds", "routes", F.array_sort(F.array_distinct("routes")).alias("_set"))
    known = F.col("query").isNotNull() & F.col("seconds").isNotNull() & F.col("routes").isNotNull()
    k = F.rank().over(W.partitionBy("query", "_set").orderBy("seconds", "id"))
    live = a.where(known).withColumn("_k", k).where("_k = 1").drop("_k")
    none = F.struct(F.lit(False).alias("some"), F.lit(None).cast(results.schema["routes"].dataType.elementType).alias("route"))
    some = lambda r: F.struct(F.lit(True).alias("some"), r.alias("route"))
    own = live.select("query", "id", "seconds", "_set", F.explode(F.concat(F.array(none), F.transform("_set", some))).alias("e"))
    other = live.select(F.col("query").alias("_q"), F.col("id").alias("_id"), F.col("seconds").alias("_s"), F.col("_set").alias("_r"), F.when(F.size("_set") == 0, none).otherwise(some(F.get("_set", F.lit(0)))).alias("f"))
    faster = (F.col("_s") < F.col("seconds")) | ((F.col("_s") == F.col("seconds")) & (F.col("_id") < F.col("id")))
    meet = (F.col("query") == F.col("_q")) & (F.col("e.some") == F.col("f.some")) & F.col("e.route").eqNullSafe(F.col("f.route"))
    worse = own.join(other, meet).where(faster & (F.size(F.array_except("_r", "_set")) == 0)).select("query", "id", "_set").distinct()
    kept = live.join(worse, ["query", "id", "_set"], "left_anti").select(*a.columns).unionByName(a.where(~known))
    k = F.row_number().over(W.partitionBy("query").orderBy("seconds", "id"))
    return kept.drop("_set").withColumn("rank", k).where(F.col("rank") <= limit)


def change_time(same: Column, config: Column, default: int) -> Column:
    """Seconds to change: the configured value unless missing or 0, none on the same route."""
    return F.when(same, 0).otherwise(F.coalesce(F.nullif(config, F.lit(0)), F.lit(default)))


def visited(path: Column, route: Column) -> Column:
    return F.array_contains(path, route)


def order_ways(ways: list[list[tuple]], stops: list[tuple]) -> list[list[tuple]]:
    """Ways (points) in the order of the stops nearest to their ends, turned round where they run against them."""
    near = lambda p: min(range(len(stops)), key=lambda i: (math.hypot(p[0] - stops[i][0], p[1] - stops[i][1]), i))
    out = []
    for w in ways:
        a, b = near(w[0]), near(w[-1])
        out.append((min(a, b), w if a <= b else w[::-1]))
    return [w for _, w in sorted(out, key=lambda t: t[0])]
