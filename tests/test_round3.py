"""Tests of the findings of round 3."""

from __future__ import annotations

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from meridian.operators import graph, match, spatial, transit


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_snap_is_at_no_distance_on_a_leg(spark):
    """Every whole point of a leg lies on it: a foot cut to whole units lay one beside some of them."""
    roads = spark.createDataFrame([(1, [{"x": 0, "y": 0}, {"x": 3000, "y": 0}])], "road_id long, points array<struct<x:long,y:long>>")
    pts = spark.range(3001).selectExpr("1L as trace", "id as ind", "id as x", "0L as y")
    got = match.snap(pts, match.legs(roads), 600)
    assert got.count() == 3001 and got.where("off > 1e-6 or px <> ind").count() == 0


@pytest.mark.parametrize("name", ["radius_stops", "tile_range_join", "terrain_slopes"])
def test_rows_dealt_to_cells_are_not_broadcast(spark, sf_dir, name):
    assert "Broadcast" not in plan(__spark_entry__.queries()[name](spark, sf_dir))


def test_nearest_starts_as_narrow_as_places_are_dense(spark):
    """All places lie within one cell of the width asked for; no round joins all of them with all."""
    p = spark.range(400).selectExpr("id", "id % 20 * 10 as x", "id div 20 * 10 as y")
    q = p.toDF("other", "x2", "y2")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def far(x, y, x2, y2):
        seen.add(1)
        return float((x - x2) ** 2 + (y - y2) ** 2) ** 0.5

    got = spatial.nearest(p, q, "id", far("x", "y", "x2", "y2"), "other", 1 << 20, k=2).collect()
    assert len(got) == 800 and {(r.id, r["rank"]): (r.other, r.distance) for r in got}[0, 2] == (1, 10.0)
    assert seen.value < 400 * 400 / 2


def test_nearest_of_small_and_large_groups(spark):
    """Groups of few places are joined whole, others by cells: the same answers, ties to the smaller place."""
    g = spark.range(60).selectExpr("id as other", "cast(id >= 5 as int) as g", "id * id % 101 * 7 as x2", "id * 13 % 89 * 5 as y2")
    q = spark.range(90).selectExpr("id", "cast(id % 3 as int) as g", "id * 11 % 97 * 6 as x", "id * 17 % 83 * 4 as y")
    dist = F.sqrt(F.pow((F.col("x") - F.col("x2")).cast("double"), F.lit(2)) + F.pow((F.col("y") - F.col("y2")).cast("double"), F.lit(2)))
    got = {(r.id, r["rank"]): r.other for r in spatial.nearest(q, g, "id", dist, "other", 8, k=2, on=["g"]).collect()}
    places = g.collect()
    want = {}
    for r in q.collect():
        near = sorted((((r.x - p.x2) ** 2 + (r.y - p.y2) ** 2) ** 0.5, p.other) for p in places if p.g == r.g)
        want |= {(r.id, n): o for n, (_, o) in enumerate(near[:2], 1)}
    assert got == want and len(got) == 120
    # the groups of few are done before any round looks for the extent of the others
    few = spatial.nearest(q, g.where("g = 0"), "id", dist, "other", 8, on=["g"])
    assert few.count() == 30 and "explode" not in plan(few)


@pytest.mark.parametrize("name", ["shaded_tiles", "terrain_pyramid", "terrain_slopes"])
def test_tiles_of_a_small_file_are_many_tasks(spark, sf_dir, name):
    assert "REPARTITION_BY_NUM" in plan(__spark_entry__.queries()[name](spark, sf_dir))


def test_best_results_against_all_pairs(spark):
    """Empty, repeated and unknown routes too; rows of one set of routes do not meet each other."""
    rows = [(i % 3, i, i * 31 % 17, [(), (1,), (2, 1), (1, 2, 1), (3,), (2, 3), (1, 3, 4), (None, 2), None][i * 7 % 9 if i > 40 else 1 + i * 5 % 8]) for i in range(90)]
    rows = [(q, i, s, None if r is None else list(r)) for q, i, s, r in rows]
    got = transit.best_results(spark.createDataFrame(rows, "query int, id int, seconds int, routes array<int>"), 9).collect()
    worse = lambda a, b: b[0] == a[0] and (b[2], b[1]) < (a[2], a[1]) and a[3] is not None and b[3] is not None and set(b[3]) <= set(a[3])
    want = set()
    for q in range(3):
        left = sorted((a[2], a[1]) for a in rows if a[0] == q and not any(worse(a, b) for b in rows))
        want |= {(q, i, n) for n, (_, i) in enumerate(left[:9], 1)}
    assert {(r["query"], r.id, r["rank"]) for r in got} == want
    made = spark.range(3000).selectExpr("1 as query", "id", "id % 1000 as seconds", "array(id % 5, id % 7 + 10) as routes")
    assert transit.best_results(made, 5000).count() == 35
    assert "rank(seconds" in plan(transit.best_results(made, 5))


def test_many_checkpointed_rows_are_not_broadcast(spark):
    """A round's rows pack to a small file, whatever they take in memory."""
    many = graph.checkpointed(spark.range(300_000).selectExpr("id % 7 as k", "'x' as v"))
    few = graph.checkpointed(spark.range(10).selectExpr("id as k"))
    assert "SortMergeJoin" in plan(few.join(many, "k", "left")) and "SortMergeJoin" in plan(many.where("v = 'x'").select("k").join(many.withColumnRenamed("v", "w"), "k"))
