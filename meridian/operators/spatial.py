"""Spatial joins as equi joins on grid cells with an exact test after.

Nothing is broadcast unasked and no side is crossed with another: rows meet only in the
cells they touch. Cells are as wide as the reach of the join, so each row of one side
looks at its own cell and the eight around it. Rows dealt to cells ask for a merge join:
Spark takes them for as small as the file they come from and would send them to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import checkpointed


def _cells(x: Column, y: Column, width: int, ring: int) -> Column:
    """Cells (cx, cy) of a point, with the rings around it."""
    cx, cy = F.floor(x / width), F.floor(y / width)
    around = [F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in range(-ring, ring + 1) for j in range(-ring, ring + 1)]
    return F.array(*around)


def within(left: DataFrame, right: DataFrame, reach: int, on: Column | None = None, lx="x", ly="y", rx="x2", ry="y2") -> DataFrame:
    """Pairs whose squares of half width reach meet: abs(dx) <= reach and abs(dy) <= reach, and the exact test on."""
    a = left.withColumn("_c", F.explode(_cells(F.col(lx), F.col(ly), reach, 1))).hint("merge")
    b = right.withColumn("_c", _cells(F.col(rx), F.col(ry), reach, 0)[0])
    box = (F.abs(F.col(lx) - F.col(rx)) <= reach) & (F.abs(F.col(ly) - F.col(ry)) <= reach)
    out = a.join(b, "_c").where(box)
    return (out if on is None else out.where(on)).drop("_c")


#: Right rows of a group that meet all of its left rows, as they are no more than the cells around a place.
FEW = 9


def nearest(left: DataFrame, right: DataFrame, key: str, dist: Column, tie: str, width: int, k: int = 1, grow: int = 4, lx="x", ly="y", rx="x2", ry="y2", on: list[str] | None = None) -> DataFrame:
    """The k nearest right rows of each left row (one a key) by dist, ties by tie; all of them if the right side has fewer. on: columns that must be equal.

    The search widens: rows that find k candidates whose k-th distance lies within the ring
    searched are done, and those alone whose ring holds the whole right side; the others look
    at a ring `grow` times as wide. It starts at width, or below it where the right side is so
    dense that a cell would hold many more than k rows. With on, groups of at most FEW right
    rows are joined whole. dist must not be below the larger of abs(dx), abs(dy).
    """
    order = W.partitionBy(key).orderBy("_d", tie)
    best = lambda df: df.withColumn("_d", dist).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    done = None
    if on:
        right = right.withColumn("_n", F.count("*").over(W.partitionBy(*on)))
        done = best(left.hint("merge").join(right.where(F.col("_n") <= FEW).drop("_n"), on))
        right = right.where(F.col("_n") > FEW).drop("_n")
        left = left.join(right.select(*on).distinct(), on, "left_semi")
    span = lambda df, x, y: df.agg(*(f(c) for c in (x, y) for f in (F.min, F.max)), F.count("*")).first()
    b = span(right, rx, ry)
    a = span(left, lx, ly) if b[4] else b
    if None in (*a, *b):
        none = (left.join(right, on) if on else left.join(right, F.lit(False))).limit(0).withColumns({"distance": dist, "rank": F.lit(1)})
        return none if done is None else done.withColumnRenamed("_d", "distance")
    whole = max(a[1], b[1]) - min(a[0], b[0]), max(a[3], b[3]) - min(a[2], b[2])
    todo, w = left, width
    if not on:
        sides, share = (b[1] - b[0], b[3] - b[2]), 2 * k / b[4]
        w = max(1, min(width, int(max((sides[0] * sides[1] * share) ** 0.5, max(sides) * share))))
    while True:
        cells = todo.withColumn("_c", F.explode(_cells(F.col(lx), F.col(ly), w, 1))).hint("merge")
        there = right.withColumn("_c", _cells(F.col(rx), F.col(ry), w, 0)[0])
        got = best(cells.join(there, ["_c", *(on or [])]).drop("_c"))
        if w > max(whole):
            return (got if done is None else done.unionByName(got)).withColumnRenamed("_d", "distance")
        got = checkpointed(got)
        sure = got.groupBy(key).agg(F.max("_d").alias("_far"), F.count("*").alias("_k")).where((F.col("_k") == k) & (F.col("_far") <= w)).select(key)
        part = got.join(sure, key, "left_semi")
        done = part if done is None else done.unionByName(part)
        todo = checkpointed(todo.join(sure, key, "left_anti"))
        if todo.isEmpty():
            return done.withColumnRenamed("_d", "distance")
        w *= grow


def junctions(roads: DataFrame) -> DataFrame:
    """Pairs of roads that share a vertex: (x, y, road_a, i_a, road_b, i_b), each pair once.

    roads: road_id, points. The vertex itself is the key; a road that passes a vertex twice
    is there twice. Vertices that one road alone touches are dropped before the join.
    """
    v = roads.select("road_id", F.posexplode("points").alias("i", "p")).select("road_id", "i", "p.x", "p.y")
    shared = v.groupBy("x", "y").agg(F.min("road_id").alias("lo"), F.max("road_id").alias("hi")).where("lo < hi").select("x", "y")
    v = v.join(shared, ["x", "y"], "left_semi")
    a = v.select("x", "y", F.col("road_id").alias("road_a"), F.col("i").alias("i_a"))
    b = v.select("x", "y", F.col("road_id").alias("road_b"), F.col("i").alias("i_b"))
    return a.join(b, ["x", "y"]).where("road_a < road_b")


def boxes_meet(left: DataFrame, right: DataFrame, zoom: int, names=("left", "top", "right", "bottom"), other=("left2", "top2", "right2", "bottom2")) -> DataFrame:
    """Pairs of rows whose boxes overlap, both inclusive: each box goes to the tiles of a zoom that it touches.

    A pair that meets in several tiles is kept in the first of them, so nothing is deduplicated after.
    """
    shift = 31 - zoom

    def dealt(df: DataFrame, n) -> DataFrame:
        xs = F.sequence(F.shiftright(n[0], shift), F.shiftright(n[2], shift))
        df = df.withColumn("_tx", F.explode(xs))
        return df.withColumn("_ty", F.explode(F.sequence(F.shiftright(n[1], shift), F.shiftright(n[3], shift))))

    a, b = dealt(left, names), dealt(right, other)
    l1, t1, r1, b1 = (F.col(c) for c in names)
    l2, t2, r2, b2 = (F.col(c) for c in other)
    meet = (r1 >= l2) & (l1 <= r2) & (b1 >= t2) & (t1 <= b2)
    first = (F.col("_tx") == F.shiftright(F.greatest(l1, l2), shift)) & (F.col("_ty") == F.shiftright(F.greatest(t1, t2), shift))
    return a.hint("merge").join(b, ["_tx", "_ty"]).where(meet & first).drop("_tx", "_ty")


def in_ranges(points: DataFrame, ranges: DataFrame, p: str, start: str, end: str, width: int) -> DataFrame:
    """Points joined with the half-open ranges [start, end) that hold them, by buckets of a width."""
    a = points.withColumn("_b", F.floor(F.col(p) / width))
    b = ranges.where(F.col(end) > F.col(start)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return a.hint("merge").join(b, "_b").where((F.col(p) >= F.col(start)) & (F.col(p) < F.col(end))).drop("_b")


def allowed_turns(moves: DataFrame, restrictions: DataFrame) -> DataFrame:
    """Moves (from_id, to_id) that restrictions (from_id, to_id, type) leave.

    Types 1 to 4 forbid the named move; 5 to 7 allow only the moves they name from a road.
    """
    no = restrictions.where("type between 1 and 4").select("from_id", "to_id").distinct()
    only = restrictions.where("type >= 5").select("from_id", "to_id").distinct().withColumn("_named", F.lit(True))
    exclusive = only.select("from_id").distinct().withColumn("_only", F.lit(True))
    out = moves.join(no, ["from_id", "to_id"], "left_anti").join(exclusive, "from_id", "left").join(only, ["from_id", "to_id"], "left")
    return out.where("_only is null or _named").drop("_only", "_named")
