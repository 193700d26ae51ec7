"""Tests of the findings of round 3 that were left open at first."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridian.operators import routing

ROADS = "road_id long, points array<struct<x:long,y:long>>, oneway int, speed double, penalty long, ring boolean"
BANS = "from_id long, to_id long, via_id long, type int"


def roads(spark, lines):
    return spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in p], 0, 1.0, 0, False) for k, p in lines.items()], ROADS)


def test_sections_need_no_restrictions(spark):
    """the legs of a network are made without its states and arcs."""
    never = spark.createDataFrame([(1, 2, None, 1)], BANS).withColumn("type", F.raise_error(F.lit("restrictions were read")).cast("int"))
    net = routing.build(roads(spark, {1: [(0, 0), (5, 0), (9, 0)], 2: [(5, 0), (5, 7)]}), never)
    assert {(r.road_id, r.i, r.sec, r.ms) for r in net.legs.collect()} == {(1, 0, 0, 5000), (1, 1, 1, 4000), (2, 0, 0, 7000)}


def test_queries_are_dropped_where_no_road_leads(spark):
    """F5, F7, F8: queries between parts of a network that nothing links take no search; roads that none reaches are left alone."""
    chain = {k: [(k, 0), (k + 1, 0)] for k in range(40)}
    other = {100 + k: [(500 + k, 9), (501 + k, 9)] for k in range(25)}
    alone = {200: [(900, 0), (901, 0)]}
    lone = {300 + k: [(700 + k, 3), (701 + k, 3)] for k in range(5)}
    v = spark.createDataFrame([(k, x, y) for g in (chain, other, alone, lone) for k, p in g.items() for x, y in p], "road_id long, x long, y long")
    q = spark.createDataFrame([(1, 0, 39), (2, 3, 110), (3, 124, 100), (4, 200, 200), (5, 200, 0), (6, 300, 7)], "query long, s_road long, e_road long")
    asked, within = routing.linked(q, v)
    assert sorted(r.query for r in asked.collect()) == [1, 3, 4]
    assert sorted(r.road_id for r in within.collect()) == sorted([*chain, *other, *alone])


def test_arcs_meet_restrictions_in_one_join(spark):
    """F16: pairs of states are joined once with all that is said of their roads, not once for each kind of restriction."""
    bans = spark.createDataFrame([(1, 2, None, 1), (1, 3, None, 5), (1, 3, 2, 7)], BANS)
    net = routing.build(roads(spark, {1: [(0, 0), (5, 0)], 2: [(5, 0), (5, 7)], 3: [(5, 0), (9, 0)], 4: [(5, 7), (9, 7)]}), bans)
    arcs = net.arcs_once()
    assert {(r.a.road, r.b.road) for r in arcs.collect() if r.a.road == 1} == {(1, 3)}
    plan = arcs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 3


def test_tasks_grow_with_order_lines(spark, sf_dir, monkeypatch):
    """order lines are dealt once, over as many tasks as their number asks for."""
    import __spark_entry__

    monkeypatch.setattr("meridian.plans.views.ROWS_A_TASK", 2000)
    for name in ("contiguous_merge", "ring_turns"):
        df = __spark_entry__.queries()[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and df.rdd.getNumPartitions() >= 30
