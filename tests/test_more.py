"""Coastlines, labels, terrain, transit, overlay, container, listings and streaming."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.functions import lanes, road, timing
from meridian.operators import coast, graph, labels, overlay, raster, transit, turns
from meridian.plans.views import features
from meridian.sources import container, text_sinks
from meridian.streaming import traces

BOX = (0, 0, 100, 100)


def total(kind, got):
    return sum(abs(coast.signed_area(r)) / 2 for k, r in got if k == kind)


def test_coast_from_edge_to_edge():
    # water to the right of a line that goes down the middle: the west half
    got = coast.polygons([[(50, -10), (50, 110)]], BOX)
    assert [k for k, _ in got] == ["water"] and total("water", got) == 5000
    got = coast.polygons([[(50, 110), (50, 60)], [(50, 60), (50, -10)]], BOX)
    assert total("water", got) == 5000 and all(x >= 50 for _, r in got for x, _ in r)


def test_coast_island_and_two_bays():
    island = [(20, 20), (20, 40), (40, 40), (40, 20), (20, 20)]
    got = coast.polygons([island], BOX)
    assert [k for k, _ in got] == ["water", "land"] and total("land", got) == 400 and total("water", got) == 10_000
    lake = island[::-1]
    assert [k for k, _ in coast.polygons([lake], BOX)] == ["water"]
    got = coast.polygons([[(30, -5), (30, 105)], [(70, 105), (70, -5)]], BOX)
    assert total("water", got) == 6000 and len(got) == 2


def test_label_boxes(spark):
    assert labels.boxes_hit((0, 0, 10, 4, 0), (6, 0, 10, 4, 0)) and not labels.boxes_hit((0, 0, 10, 4, 0), (11, 0, 10, 4, 0))
    assert not labels.boxes_hit((0, 0, 10, 2, 0), (0, 7, 10, 2, 0.3)) and labels.boxes_hit((0, 0, 10, 2, 0), (0, 3, 10, 2, 1.57))
    rng = random.Random(3)
    rows = [(1, i, i % 5, rng.choice("abc"), rng.uniform(0, 300), rng.uniform(0, 300), 30.0, 8.0, rng.uniform(0, 3)) for i in range(120)]
    df = spark.createDataFrame(rows, "tile long, id long, ord int, text string, x double, y double, w double, h double, angle double")
    got = labels.place(df, 50.0).where("placed").collect()
    boxes = [(r.x, r.y, r.w, r.h, r.angle) for r in got]
    assert len(got) > 5 and not any(labels.boxes_hit(a, b) for i, a in enumerate(boxes) for b in boxes[:i])
    assert all(a.text != b.text or np.hypot(a.x - b.x, a.y - b.y) >= 50 for i, a in enumerate(got) for b in got[:i])


def test_wrap():
    assert labels.wrap("one two three four", 9) == ["one two", "three", "four"] and labels.wrap("", 5) == []


def test_terrain():
    plane = np.add.outer(np.zeros(8), np.arange(8) * 10.0)
    s = raster.slope(plane, 10.0)
    assert np.allclose(s[:, 1:-1], 45.0)
    flat = raster.hillshade(np.zeros((4, 4)), 10.0)
    assert (flat == 180).all()
    # light from the north-west: slopes that fall to the west are lit more than those that fall to the east
    assert raster.hillshade(plane, 10.0)[3, 3] > raster.hillshade(plane[:, ::-1], 10.0)[3, 3]
    plane[2, 2] = raster.NODATA
    assert raster.slope(plane, 10.0)[2, 2] == raster.NODATA
    c = raster.relief(np.array([0.0, 5.0, 50.0, raster.NODATA]), [(0, (0, 0, 0, 255)), (10, (100, 200, 0, 255))])
    assert c.tolist() == [[0, 0, 0, 255], [50, 100, 0, 255], [100, 200, 0, 255], [0, 0, 0, 0]]


def test_stitching():
    s = lambda *ids: [(i, i * 100, 0) for i in ids]
    assert transit.stitch([s(3, 4, 5), s(1, 2, 3), s(9, 10)]) == [s(1, 2, 3, 4, 5), s(9, 10)] or len(transit.stitch([s(3, 4, 5), s(1, 2, 3), s(9, 10)])) == 2
    near = transit.stitch([[(1, 0, 0), (2, 10, 0)], [(3, 30, 0), (4, 60, 0)]], 40.0)
    assert [[x[0] for x in p] for p in near] == [[1, 2, 3, 4]]
    assert transit.order_ways([[(30, 0), (20, 0)], [(0, 0), (10, 0)]], [(0, 0), (10, 0), (20, 0), (30, 0)]) == [[(0, 0), (10, 0)], [(20, 0), (30, 0)]]


def test_next_departures(spark):
    calls = spark.createDataFrame([(1, 0, 0, 100), (1, 0, 1, 200)], "route long, seq int, trip int, at long")
    want = spark.createDataFrame([(7, 1, 0, 101), (8, 1, 0, 201), (9, 1, 0, 50)], "wish long, route long, seq int, at long")
    assert {r.wish: r.dep for r in transit.next_departures(calls, want, 120).collect()} == {7: 200, 9: 100}


def test_overlay_equals_direct_search(spark):
    rng = random.Random(9)
    arcs = [(a, b, float(rng.randrange(1, 9))) for a in range(48) for b in rng.sample(range(48), 3) if a != b and (a // 12 == b // 12 or rng.random() < 0.25)]
    e = spark.createDataFrame(arcs, "a long, b long, cost double")
    cells = spark.range(48).select(F.col("id").alias("node"), F.floor(F.col("id") / 12).alias("cell"))
    points, net = overlay.build(e, cells)
    ask = [(i, rng.randrange(48), rng.randrange(48)) for i in range(12)]
    got = {r["query"]: r.cost for r in overlay.route(spark.createDataFrame(ask, "query long, start long, end long"), e, cells, points, net).collect()}
    for i, s, t in ask:
        p = graph.shortest(arcs, s, t)
        assert (p is None and i not in got) or abs(p[0] - got[i]) < 1e-9


def test_alternatives():
    assert [c for c, _ in overlay.alternatives([(3, [1, 2, 3]), (1, [1, 2, 9]), (2, [5, 6, 7])], 0.6)] == [1, 2]


def test_roundabout_turns(spark):
    rows = [("r", 0, 0.0, 0.0, 10.0, False, 1), ("r", 1, 90.0, 30.0, 5.0, True, 1), ("r", 2, 30.0, 0.0, 5.0, True, 1), ("r", 3, 0.0, 0.0, 10.0, False, 0), ("r", 4, 90.0, 90.0, 10.0, False, 0)]
    df = spark.createDataFrame(rows, "route string, seq int, bearing_in double, bearing_out double, length double, roundabout boolean, n_side int")
    assert [r.turn for r in turns.turns(df).orderBy("seq").collect()] == [None, "RNDB2", None, None, None]


def test_lane_words():
    assert lanes.parse_lanes("left;through|right", lanes.CODES["C"]) == [lanes.packed([1, 2]), lanes.packed([5])]
    assert lanes.read("+TL,C|TR") == [lanes.packed([2, 1], True), lanes.packed([5])]
    assert lanes.activate(lanes.read("TL,C|TR"), 1) == lanes.read("+C,TL|TR")
    assert lanes.active_range([0, 0, 0], 0, 1, 1) == (1, 1) and lanes.active_range([0], 0, 1, 1) == (-1, -1)


def test_roads(spark):
    t = lambda *kv: F.array(*[F.struct(F.lit(k).alias("tag"), F.lit(v).alias("value")) for k, v in kv])
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(road.oneway(t(("oneway", "no"), ("oneway", "-1")))) == -1 and one(road.oneway(t(("junction", "roundabout")))) == 1
    assert abs(one(road.max_speed(t(("maxspeed", "50"), ("maxspeed:hgv", "36"), ("maxspeed:backward", "18")), F.lit(False), "hgv")) - 10) < 1e-9
    names = F.create_map(*map(F.lit, ("destination", "A", "destination:forward", "B", "name", "N")))
    assert one(road.destination(names, F.lit(True))) == "B" and one(road.destination(names, F.lit(False), "en")) == "A"
    assert [one(road.movement_allowed(F.lit(w), F.lit(f), F.lit(r))) for w, f, r in ((0, True, False), (1, True, False), (1, False, False), (1, False, True), (-1, True, False))] == [True, True, False, True, False]
    assert one(timing.turn_time(F.lit(2.5), F.lit(20.0), F.lit(8.0), F.lit(False), F.lit(False))) == 20.0


def test_container_round_trip(spark, sf_dir, tmp_path):
    container.register(spark)
    f = features(spark, sf_dir).withColumn("area", F.col("id") % 3 == 0).select("id", "file_ord", F.col("min_zoom").cast("int").alias("min_zoom"), F.col("max_zoom").cast("int").alias("max_zoom"), "area", "points", "tags")
    path = str(tmp_path / "c")
    f.repartition(3).write.format("meridian_container").mode("append").save(path)
    back = spark.read.format("meridian_container").load(path)
    rows = lambda df: sorted(map(repr, df.drop("file_ord").collect()))
    assert rows(back) == rows(f)
    box = (200_000_000, 100_000_000, 900_000_000, 1_200_000_000)
    part = spark.read.format("meridian_container").option("box", ",".join(map(str, box))).option("zoom", 12).load(path)
    from meridian.operators import scan

    want = scan.at_level(scan.in_box(scan.with_bounds(f), *box), 12).select(*f.columns)
    assert rows(part) == rows(want) and 0 < part.count() < back.count()
    assert rows(container.load(spark, path, box, 12)) == rows(want)
    f.limit(5).coalesce(1).write.format("meridian_container").mode("overwrite").save(path)
    assert spark.read.format("meridian_container").load(path).count() == 5


def test_container_passes_over_unknown_fields():
    row = {"id": -5, "min_zoom": 3, "max_zoom": 9, "area": False, "points": [(7, 8), (1, 2)], "tags": [("a", "b"), ("c", "b")]}
    block = container.encode_block([row]) + container.field(77, b"later")
    assert list(container.decode_block(block)) == [row]
    assert list(container.decode_block(block, zoom=10)) == [] == list(container.decode_block(block, box=(50, 50, 60, 60)))


def test_listings(spark):
    p = spark.createDataFrame([(1, 2, 1.5, 2.0), (1, 1, 1.0, 2.0)], "trace long, ind long, lat double, lon double")
    gpx = text_sinks.track(p).first().gpx
    assert gpx.index('lat="1.0000000"') < gpx.index('lat="1.5000000"') and gpx.startswith("<?xml")
    j = text_sinks.json_arrays(p, "trace", "ind", "lat").first().json
    assert j == '[{"ind":1,"lat":1.0},{"ind":2,"lat":1.5}]'
    known = spark.createDataFrame([("a", 1), ("b", 2)], "name string, size int")
    files = spark.createDataFrame([("a", 1), ("b", 3), ("c", 4)], "name string, size int")
    assert sorted(r.name for r in text_sinks.stale(known, files).collect()) == ["b", "c"]


@pytest.mark.parametrize("kind", ["cells", "trips"])
def test_streams(spark, tmp_path, kind):
    rows = spark.sql("select 1L trace, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,i*7) ts, i*10L x, 5L y from (select explode(sequence(0, 9)) i)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = traces.per_cell(stream, 50) if kind == "cells" else traces.trips(stream)
    q = out.writeStream.format("memory").queryName(f"out_{kind}").outputMode("complete" if kind == "cells" else "append").start()
    q.processAllAvailable()
    q.stop()
    assert kind == "trips" or spark.table(f"out_{kind}").agg(F.sum("points")).first()[0] == 10


def test_names_combine_and_glyphs_follow(spark):
    got = labels.combine_lines([[(0, 0), (100, 0)], [(110, 0), (200, 5)], [(0, 50), (-50, 50)], [(600, 0), (700, 0)]])
    assert [(0, 0), (100, 0), (110, 0), (200, 5)] in got and len(got) == 3
    assert labels.combine_lines([[(0, 0), (100, 0)], [(100, 0), (0, 0)]]) == [[(0, 0), (100, 0)], [(100, 0), (0, 0)]]
    p = labels.along_path([(0, 0), (10, 0), (10, 10)], [4, 4, 4], 3)
    assert [(round(x, 6), round(y, 6)) for x, y, _ in p] == [(5, 0), (9, 0), (10, 3)] and labels.along_path([(0, 0), (5, 0)], [4, 4], 0) is None
    rows = [(1, "A", 1, [{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}]), (1, "A", 2, [{"x": 12.0, "y": 0.0}, {"x": 20.0, "y": 0.0}]), (1, "B", 3, [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}])]
    df = spark.createDataFrame(rows, "tile long, text string, id long, points array<struct<x:double,y:double>>")
    assert sorted((r.text, len(r.points)) for r in labels.combine_names(df).collect()) == [("A", 4), ("B", 2)]


def test_endpoints_and_areas():
    from meridian.operators import geometry

    assert geometry.with_endpoint([(0, 0), (10, 0), (20, 0)], (14, 3)) == ([(0, 0), (10, 0), (14, 0), (20, 0)], 2)
    assert geometry.with_endpoint([(0, 0), (10, 0)], (-5, 1)) == ([(0, 0), (10, 0)], 0)
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    assert geometry.across_area(square, [(0, 0), (10, 0), (10, 10)]) == [(0, 0), (10, 10)]
    ell = [(0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10)]
    assert geometry.across_area(ell, [(9, 2), (10, 0), (0, 0), (0, 10), (2, 9)])[0] == (9, 2) and not geometry.sees(ell, (9, 3), (3, 9))
    assert geometry.slice_between([[(0, 0), (10, 0), (20, 0), (30, 0)]], (9, 1), (21, 1)) == [(0, 0), (10, 0), (20, 0), (30, 0)]
    assert geometry.slice_between([], (0, 0), (5, 5)) == [(0, 0), (5, 5)]


def test_route_splits_and_keeps(spark):
    s = spark.createDataFrame([(1, 0, 5, 0, 6), (1, 1, 7, 9, 4)], "route long, seq int, road_id long, i int, j int")
    at = spark.createDataFrame([(5, 2), (5, 2), (5, 6), (5, 8), (7, 5), (7, 7)], "road_id long, at int")
    got = [(r.seq, r.piece, r.i, r.j) for r in turns.split_at_junctions(s, at).orderBy("seq", "piece").collect()]
    assert got == [(0, 0, 0, 2), (0, 1, 2, 6), (1, 0, 9, 7), (1, 1, 7, 5), (1, 2, 5, 4)]
    k = spark.createDataFrame([("C", 0, 1), ("C", 1, 1), ("TL", 0, 1), ("TSLR", 1, 0)], "turn string, n_left int, n_right int")
    assert [r.turn for r in turns.keep_turns(k).collect()] == ["KL", "C", "TL", "KR"]
    stops = spark.createDataFrame([(1, 0, 2), (1, 1, 2), (1, 2, 2)], "route long, seq int, priority int")
    side = spark.createDataFrame([(1, 0, 3), (1, 1, 1)], "route long, seq int, priority int")
    assert sorted(r.seq for r in turns.without_minor_stops(stops, side).collect()) == [1, 2]


def test_conditions_exits_and_signs(spark):
    t = lambda *kv: F.array(*[F.struct(F.lit(k).alias("tag"), F.lit(v).alias("value")) for k, v in kv])
    c = F.array(*[F.struct(F.lit(k).alias("tag"), F.lit(v).alias("value"), F.lit(h).alias("holds")) for k, v, h in (("maxspeed", "30", True), ("maxspeed", "20", False), ("access", "no", True))])
    one = lambda col: spark.range(1).select(col.alias("v")).first().v
    assert [tuple(x) for x in one(road.with_conditions(t(("maxspeed", "50"), ("name", "a")), c))] == [("maxspeed", "30"), ("name", "a"), ("access", "no")]
    pts = F.array(t(("highway", "motorway_junction")), t(("direction", "backward")))
    assert one(road.is_exit(pts, F.lit(0))) and not one(road.is_exit(pts, F.lit(5)))
    assert one(road.applies_in_direction(pts, F.lit(1), F.lit(False), F.lit(9.0), F.lit(9.0))) is True
    assert one(road.applies_in_direction(pts, F.lit(0), F.lit(True), F.lit(9.0), F.lit(900.0))) is False
    assert one(F.size(F.get(road.along_types(pts, F.lit(True)), F.lit(1)))) == 0
    names = F.array(F.create_map(F.lit("ref"), F.lit("12"), F.lit("exit_to"), F.lit("Town")))
    assert one(road.exit_ref(names, F.lit(0))) == "12" and one(road.exit_name(names, F.lit(0))) == "Town" and one(road.exit_ref(names, F.lit(3))) == ""
    assert one(road.clockwise(t(("direction", "clockwise")), F.lit(False))) is True
    assert one(road.arrow(t(("oneway", "-1")), F.lit(17))) == -1 and one(road.arrow(t(("oneway", "-1")), F.lit(12))) == 0
    assert one(road.class_group(t(("highway", "primary_link")))) == "main"


def test_tables_prune_folders_and_row_groups(spark, sf_dir, tmp_path):
    from meridian.operators import scan
    from meridian.sources import tables

    f = features(spark, sf_dir).select("id", "file_ord", "min_zoom", "max_zoom", "points", "tags")
    big = f.where("id <= 30").withColumn("id", F.col("id") + 10_000).withColumn("points", F.transform("points", lambda p: F.struct((p["x"] / 3).cast("long").alias("x"), (p["y"] * 1.01).cast("long").alias("y"))))
    wide = spark.createDataFrame([(99_999, 0, 0, 20, [{"x": 5, "y": 5}, {"x": 2_000_000_000, "y": 2_000_000_000}], [])], f.schema)
    f = f.unionByName(big).unionByName(wide)
    path = str(tmp_path / "t")
    tables.write(f, path)
    for box in ((200_000_000, 100_000_000, 900_000_000, 1_200_000_000), (1_000_000_000, 1_000_000_000, 1_000_100_000, 1_000_100_000), (0, 0, 10, 10)):
        got = tables.read(spark, path, box, 12)
        want = scan.at_level(scan.in_box(scan.with_bounds(f), *box), 12)
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "cell#" in plan.split("PartitionFilters: [")[1][:200] and "PushedFilters" in plan
    assert tables.read(spark, path).count() == f.count()
