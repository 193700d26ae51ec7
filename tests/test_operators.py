"""Table operators against plain Python, and every named query against its SQL."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from meridian.operators import geometry, graph, match, precalculated, rules, scan, spatial, styles
from meridian.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def sql(sf_dir):
    return connected(sf_dir)


#: Queries of many rounds, which here run on the smallest tables.
ROUNDS = {"route_costs", "route_parts", "overlay_routes", "traced_streets", "walked_legs", "time_to_target", "joined_routes"}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, sql, sf_dir, name):
    if name in ROUNDS:
        sf_dir = sf_dir.replace("sf0.01", "sf0.001")
        sql = connected(sf_dir)
    df = catalog.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    got = sql.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    want = sorted(map(repr, got.fetchall()))
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr(tuple(r[n] for n in names)) for r in rows) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def points(rng, n, size, names="id long, x long, y long"):
    return [(i, rng.randrange(size), rng.randrange(size)) for i in range(n)]


def test_nearest_and_within(spark):
    rng = random.Random(4)
    a, b = points(rng, 60, 5000), points(rng, 400, 5000)
    left = spark.createDataFrame(a, "id long, x long, y long")
    right = spark.createDataFrame(b, "other long, x2 long, y2 long")
    dist = F.sqrt(F.pow(F.col("x") - F.col("x2"), F.lit(2)) + F.pow(F.col("y") - F.col("y2"), F.lit(2)))
    got = {(r.id, r["rank"]): r.other for r in spatial.nearest(left, right, "id", dist, "other", 100, k=2).collect()}
    for i, x, y in a:
        order = sorted(b, key=lambda p: (((p[1] - x) ** 2 + (p[2] - y) ** 2) ** 0.5, p[0]))
        assert [got[i, 1], got[i, 2]] == [order[0][0], order[1][0]]
    pairs = {(r.id, r.other) for r in spatial.within(left, right, 150).collect()}
    assert pairs == {(i, j) for i, x, y in a for j, u, v in b if abs(x - u) <= 150 and abs(y - v) <= 150}


def test_boxes_and_ranges(spark):
    rng = random.Random(5)
    box = lambda: (lambda x, y: (x, y, x + rng.randrange(1 << 27), y + rng.randrange(1 << 27)))(rng.randrange(1 << 30), rng.randrange(1 << 30))
    a, b = [(i, *box()) for i in range(50)], [(i, *box()) for i in range(50)]
    left = spark.createDataFrame(a, "i long, left long, top long, right long, bottom long")
    right = spark.createDataFrame(b, "j long, left2 long, top2 long, right2 long, bottom2 long")
    got = [(r.i, r.j) for r in spatial.boxes_meet(left, right, 6).collect()]
    want = {(p[0], q[0]) for p in a for q in b if p[3] >= q[1] and p[1] <= q[3] and p[4] >= q[2] and p[2] <= q[4]}
    assert len(got) == len(set(got)) and set(got) == want


def test_first_of_each_zoom(spark):
    p = lambda *xs: [{"x": x, "y": 0} for x in xs]
    rows = [(1, 0, p(1, 2)), (1, 1, p(1, 2)), (1, 2, p(1, 3)), (0, 0, p(5)), (0, 1, p(5))]
    df = spark.createDataFrame(rows, "id long, file_ord int, points array<struct<x:long,y:long>>")
    assert sorted((r.id, r.file_ord) for r in scan.first_of_each(df, 16).collect()) == [(0, 0), (0, 1), (1, 0)]
    assert sorted((r.id, r.file_ord) for r in scan.first_of_each(df, 12).collect()) == [(0, 0), (0, 1), (1, 0), (1, 2)]


def test_paths(spark):
    rng = random.Random(6)
    arcs = [(rng.randrange(40), rng.randrange(40), float(rng.randrange(1, 20))) for _ in range(160)]
    df = spark.createDataFrame(arcs, "a long, b long, cost double")
    got = {r.node: r.cost for r in graph.one_to_all(df, spark.createDataFrame([(0, 0)], "source long, node long")).collect()}
    for n in range(40):
        p = graph.shortest(arcs, 0, n)
        assert (p is None and n not in got) or abs(p[0] - got[n]) < 1e-9
    q = spark.createDataFrame([(1, 0, 9), (2, 0, 99)], "query long, start long, end long")
    e = spark.createDataFrame([(1, *a) for a in arcs], "query long, a long, b long, cost double")
    ans = {r["query"]: r for r in graph.per_query(q, e).collect()}
    assert ans[2].cost is None and (ans[1].cost == got.get(9))


def test_clip_and_simplify():
    assert geometry.clip_line([(-5, 5), (5, 5), (15, 5)], (0, 0, 10, 10)) == [[(0, 5), (5, 5), (10, 5)]]
    assert geometry.clip_line([(-5, 5), (5, 5), (5, 20), (8, 20), (8, 5)], (0, 0, 10, 10)) == [[(0, 5), (5, 5), (5, 10)], [(8, 10), (8, 5)]]
    assert geometry.clip_line([(-5, -5), (-1, 20)], (0, 0, 10, 10)) == []
    assert sorted(geometry.clip_ring([(-5, -5), (5, -5), (5, 5), (-5, 5)], (0, 0, 10, 10))) == [(0, 0), (0, 5), (5, 0), (5, 5)]
    assert geometry.clip_ring([(20, 20), (30, 20), (30, 30)], (0, 0, 10, 10)) == []
    line = [(i, (i % 2) * 0.1) for i in range(100)]
    assert geometry.simplify(line, 0.5) == [line[0], line[-1]]
    assert (50, 40) in geometry.simplify([(0, 0), (50, 40), (100, 0)], 5)


def test_vector_tile_round_trip():
    rows = [(7, geometry.LINE, [[(0, 0), (10, -5)], [(3, 3), (4, 4)]], {"k": "v"}), (9, geometry.POLYGON, [[(0, 0), (10, 0), (10, 10)]], {}), (1, geometry.POINT, [[(-3, 4)]], {"k": "w", "n": "v"})]
    assert geometry.decode_tile(geometry.encode_tile(rows)) == rows


def test_rules_compile(spark):
    tags = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    c = rules.compile_profile("<p><attribute name='k' value='9'/><way attribute='w'><select value='5' t='a' v='2'/><if t='b'><select value=':k'><gt value1='$b' value2='1'/></select></if></way><way attribute='x'><select value='1' t='zz'/></way></p>", tags)
    assert spark.range(1).select(c["w"].alias("w"), c["x"].alias("x")).first() == (9.0, None)
    c = rules.compile_profile("<p><way attribute='w'><if param='on'><select value='1'/></if><select value='2'/></way></p>", tags, {"on": "true"})
    assert spark.range(1).select(c["w"].alias("w")).first().w == 1.0


def test_positions_are_dense(spark):
    df = spark.range(500).selectExpr("id", "cast(id % 7 as int) as ord")
    got = styles.positions(df).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 501)) and [(r.ord, r.id) for r in got] == sorted((r.ord, r.id) for r in got)


def test_matching_stays_on_a_road(spark):
    roads = spark.createDataFrame([(1, [{"x": x, "y": 0} for x in range(0, 1001, 100)]), (2, [{"x": x, "y": 60} for x in range(0, 1001, 100)])], "road_id long, points array<struct<x:long,y:long>>")
    pts = [(1, i, 50 + i * 100, 10 if i != 4 else 35) for i in range(9)]
    got = match.match(spark.createDataFrame(pts, "trace long, ind long, x long, y long"), match.legs(roads), 100, 200.0).collect()
    assert {r.leg.road_id for r in got} == {1} and len(got) == 9
    snapped = match.snap(spark.createDataFrame(pts, "trace long, ind long, x long, y long"), match.legs(roads), 100).collect()
    assert {r.ind: r.leg.road_id for r in snapped}[4] == 2


def test_nearest_of_far_places(spark):
    """A place far from all others still finds its nearest, and fewer than k are all there is."""
    left = spark.createDataFrame([(1, 0, 0), (2, 10_000_000, 7), (3, 5, 5)], "id int, x long, y long")
    right = spark.createDataFrame([(1, 3, 3), (2, 900, 0), (3, 5_000_000, 0)], "other int, x2 long, y2 long")
    dist = F.sqrt(F.pow((F.col("x") - F.col("x2")).cast("double"), F.lit(2)) + F.pow((F.col("y") - F.col("y2")).cast("double"), F.lit(2)))
    got = {(r.id, r["rank"]): r.other for r in spatial.nearest(left, right, "id", dist, "other", 10, k=2).collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (2, 1): 3, (2, 2): 2, (3, 1): 1, (3, 2): 2}
    assert spatial.nearest(left, right, "id", dist, "other", 10, k=9).count() == 9
    assert spatial.nearest(left, right.limit(0), "id", dist, "other", 10).count() == 0


def test_gaps_end_a_match_and_long_roads_keep_their_legs(spark):
    long = [{"x": 10 * k, "y": 0} for k in range(2_500)]
    roads = spark.createDataFrame([(1, long), (2, [{"x": 20_480, "y": 300}, {"x": 20_490, "y": 300}])], "road_id long, points array<struct<x:long,y:long>>")
    pts = [(1, 0, 20_481, 1), (1, 1, 20_489, 1), (1, 2, 20_485, 150), (1, 3, 20_495, 2)]
    got = match.match(spark.createDataFrame(pts, "trace long, ind long, x long, y long"), match.legs(roads), 20, 50.0).collect()
    assert {r.ind: (r.part, r.leg.road_id, r.leg.i) for r in got} == {0: (0, 1, 2048), 1: (0, 1, 2048), 3: (1, 1, 2049)}


def test_precalculated_direction(spark):
    slices = spark.createDataFrame([(1, 0, [(0, 0), (0, 0), (100, 0)], 100.0, 10.0), (1, 1, [(100, 0), (100, 50)], 0.0, 0.0), (2, 0, [(0, 0), (5, 5)], 1.0, 1.0)], "route int, seq int, points array<struct<x:long,y:long>>, length double, seconds double")
    p = precalculated.of_slices(slices, 25.0)
    assert sorted((r.i, r.x, r.y, r.speed) for r in p.where("route = 1").collect()) == [(0, 0, 0, 10.0), (1, 100, 0, 10.0), (2, 100, 50, 25.0)]
    line = precalculated.direction(p)
    assert {r.i: (r.rest, r.whole) for r in line.where("route = 1").collect()} == {0: (12.0, 12.0), 1: (2.0, 12.0), 2: (0.0, 12.0)}
    ends = spark.createDataFrame([(1, -50, 0, 100, 75)], "route int, sx long, sy long, ex long, ey long")
    own = precalculated.adopted(line, ends, 64, 25.0)
    assert {(r.i, r.start_time, r.end_time) for r in own.collect()} == {(k, 2.0, 1.0) for k in range(3)}
    asked = spark.createDataFrame([(1, 1, 90, -5, False), (2, 1, 90, -5, True), (3, 1, 100, 49, False), (4, 1, 1, 0, True), (5, 7, 0, 0, True)], "id int, route int, x long, y long, to_start boolean")
    got = {r.id: r.seconds for r in precalculated.time_estimate(asked, own, 64, 5.0).collect()}
    assert got == {1: 2.0 + 125**0.5 / 5 + 1.0, 2: 10.0 + 125**0.5 / 5 + 2.0, 3: None, 4: None}
