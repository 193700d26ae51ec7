"""Scalar columns against plain Python."""

from __future__ import annotations

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from meridian.functions import angle, bits, hours, text, tile


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(col.alias("v")).first().v


def many(spark, rows, names, col):
    return [r.v for r in spark.createDataFrame(rows, names).select(col.alias("v")).collect()]


def test_tiles_round_trip(spark):
    rng = random.Random(1)
    pts = [(rng.uniform(-180, 180), rng.uniform(-85, 85)) for _ in range(200)] + [(180.0, 0.0), (-180.0, 85.2), (540.0, -95.0)]
    got = many(spark, pts, "lon double, lat double", F.struct(tile.lon31(tile.x31(F.col("lon"))).alias("lon"), tile.lat31(tile.y31(F.col("lat"))).alias("lat")))
    for (lon, lat), r in list(zip(pts, got))[:200]:
        assert abs(lon - r.lon) < 1e-6 and abs(lat - r.lat) < 1e-6
    assert got[200].lon > 179.99 and abs(got[201].lat - 85.0511) < 1e-3


def test_metrics_agree_over_short_legs(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(1 << 30), rng.randrange(1 << 28, 3 << 29), rng.randrange(-20000, 20000), rng.randrange(-20000, 20000)) for _ in range(100)] + [(100, (1 << 30) - 5000, 700, 9000)]
    x, y = F.col("x"), F.col("y")
    fast = tile.tile_metric(x, y, x + F.col("dx"), y + F.col("dy"))
    slow = tile.distance31(x, y, x + F.col("dx"), y + F.col("dy"))
    for r in many(spark, rows, "x long, y long, dx long, dy long", F.struct(fast.alias("a"), slow.alias("b"))):
        assert abs(r.a - r.b) <= 0.002 * max(r.b, 1)


@pytest.mark.parametrize("v,want", [("50", 50 / 3.6), ("30 mph", 30 / 3.6 * 1.6), ("none", 40.0), ("walk", -1.0), ("5.5", 5.5 / 3.6), ("", -1.0)])
def test_speed(spark, v, want):
    assert abs(one(spark, text.parse_speed(F.col("v0"), -1.0), v0=v) - want) < 1e-9


@pytest.mark.parametrize("v,want", [("10", 10), ("10 ft", 3.048), ("14'10\"", 14 * 0.3048 + 10 * 0.0254), ("3 km", 3000), ("2 mile", 2 * 1609.34), ("x", -1), ("25 cm", 0.25)])
def test_length(spark, v, want):
    assert abs(one(spark, text.parse_length(F.col("v0"), -1.0), v0=v) - want) < 1e-6


def test_intervals_colors_refs(spark):
    assert many(spark, [("20",), ("1:05",), ("0:01:30",), ("",), ("a:2",), ("-9",)], "v0 string", text.interval_seconds(F.col("v0"))) == [1200, 3900, 90, 0, 120, 0]
    assert many(spark, [("#ff0000",), ("#80ffffff",), ("red",)], "v0 string", text.parse_color(F.col("v0"))) == [-65536, -2130706433, None]
    assert many(spark, [("a;;a;b;a",), ("",)], "v0 string", text.split_distinct_runs(F.col("v0"), ";")) == ["a;b;a", ""]
    assert many(spark, [("12:345678901",), ("123456789",), ("N1",)], "v0 string", text.short_ref(F.col("v0"))) == ["12", "12345678…", "N1"]


def test_angles(spark):
    rows = [(float(a), float(b)) for a in range(-720, 721, 90) for b in (-180, 0, 77)]
    for (a, b), v in zip(rows, many(spark, rows, "a double, b double", angle.degrees_diff(F.col("a"), F.col("b")))):
        assert -180 < v <= 180 and abs((a - b - v) % 360) < 1e-9
    names = many(spark, [(float(a),) for a in (-170, -130, -90, -30, 0, 30, 90, 130, 170)], "a double", angle.turn_by_angle(F.col("a")))
    assert names == ["TRU", "TSHR", "TR", "TSLR", "C", "TSLL", "TL", "TSHL", "TU"]


def test_projection_and_area(spark):
    p = angle.project(*(F.lit(v) for v in (5, 9, 0, 0, 10, 0)))
    assert one(spark, F.struct(p["x"].alias("x"), p["y"].alias("y"))) == (5, 0)
    p = angle.project(*(F.lit(v) for v in (-5, 3, 0, 0, 0, 0)))
    assert one(spark, p["x"]) == 0
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3))])
    assert one(spark, angle.ring_area(ring)) == 12.0


def test_lanes(spark):
    lane = bits.pack_lane(F.lit(3), F.lit(7), F.lit(12), F.lit(True))
    assert one(spark, F.array(bits.lane_turn(lane, bits.LANE_PRIMARY), bits.lane_turn(lane, bits.LANE_SECONDARY), bits.lane_turn(lane, bits.LANE_TERTIARY))) == [3, 7, 12]
    assert one(spark, bits.lane_active(lane)) is True


@pytest.mark.parametrize(
    "rule,at,want",
    [
        ("24/7", "2024-01-01 03:00", True),
        ("Mo-Fr 08:00-18:00", "2024-05-06 08:00", True),
        ("Mo-Fr 08:00-18:00", "2024-05-04 09:00", False),
        ("Fr,Sa 20:00-03:00", "2024-05-05 02:59", True),
        ("Fr,Sa 20:00-03:00", "2024-05-06 01:00", False),
        ("Mo 14:00-16:00; Tu off", "2024-05-07 15:00", False),
        ("Mo 14:00-02:00; Tu off", "2024-05-06 15:00", True),
        ("Apr 05-Oct 24: Fr 08:00-16:00", "2024-05-03 09:00", True),
        ("Apr 05-Oct 24: Fr 08:00-16:00", "2024-04-04 09:00", False),
        ("Dec 24-Jan 02 off", "2024-12-30 09:00", False),
        ("2019 Oct - 2024 Dec", "2021-05-05 12:00", True),
        ("2019 Oct - 2024 Dec", "2019-09-05 12:00", False),
        ("Mo-Fr 08:00-12:00,13:00-17:30; Sa 09:00-13:00", "2024-05-06 12:30", False),
        ("Mo-Fr 08:00-12:00,13:00-17:30; Sa 09:00-13:00", "2024-05-04 12:30", True),
        ("17:00+", "2024-05-04 23:30", True),
        ("sunrise-sunset", "2024-05-04 06:59", False),
        ("Su closed", "2024-05-05 12:00", False),
        ('Mo-Fr 08:00-18:00 "ring bell"', "2024-05-06 10:00", True),
        ("Jan,Mar 10:00-12:00", "2024-03-03 11:00", True),
        ("gibberish", "2024-03-03 11:00", None),
    ],
)
def test_hours(rule, at, want):
    assert hours.is_open(rule, datetime.strptime(at, "%Y-%m-%d %H:%M")) is want


def test_hours_column_and_description(spark):
    df = spark.sql("select 'Mo-Fr 08:00-18:00' h, timestamp'2024-05-06 17:00:00' t union all select null, timestamp'2024-05-06 17:00:00' union all select '24/7', null")
    assert sorted(map(str, [r.v for r in df.select(hours.open_at(F.col("h"), F.col("t")).alias("v")).collect()])) == ["None", "None", "True"]
    at = datetime(2024, 5, 6, 17, 0)
    assert hours.describe("Mo-Fr 08:00-18:00", at) == "Will close at 18:00"
    assert hours.describe("24/7", at) == "Open 24/7"
    assert hours.describe("Mo-Fr 08:00-18:00", datetime(2024, 5, 6, 7, 0)) == "Will open at 08:00"


def test_layers(spark):
    t = lambda *kv: F.array(*[F.struct(F.lit(k).alias("tag"), F.lit(v).alias("value")) for k, v in kv])
    assert one(spark, text.simple_layer(t(("layer", "-1"), ("bridge", "yes")))) == -1
    assert one(spark, text.simple_layer(t(("tunnel", "yes"), ("tunnel", "no"), ("bridge", "yes")))) == 1
    assert one(spark, text.first_is(t(("a", "x"), ("a", "y")), "a", "y")) is False
    assert one(spark, text.has_tag(t(("a", "x"), ("a", "y")), "a", "y")) is True
    assert math.isclose(one(spark, tile.pow_zoom(F.lit(3.04))), 8.0)


@pytest.mark.parametrize("rule", ["Mo-Fr 08:00-18:00", "Mo, We, Sa 09:00-13:00; Su off", "Apr 05 - Oct 24: Fr 08:00-16:00", "24/7", "2019 Oct - 2024 Dec", "Sa, Su 20:00-03:00 || Mo 10:00-12:00", "PH off"])
def test_hours_written_anew_mean_the_same(rule):
    again = hours.assemble(rule)
    assert hours.parse(again) == hours.parse(rule)
    assert hours.always_open(rule) == (rule == "24/7")


def test_text_forms(spark):
    assert many(spark, [("3:2_4",)], "v0 string", text.dashes(F.col("v0"), 2.0)) == [[8.0, 8.0]]
    assert one(spark, text.possible_index(F.array(F.lit(1.0), F.lit(2.5)), F.lit(2.5))) == 1
    assert many(spark, [("ÄBc",)], "v0 string", text.lower_ascii(F.col("v0"))) == ["Äbc"]
    p = bits.transit_parts(bits.transit_id(F.lit(12345), F.lit(7), F.lit(9)))
    assert one(spark, F.array(p["route"], p["start"], p["segment"])) == [12345, 7, 9]
    assert one(spark, bits.transit_id(F.lit(1), F.lit(4000), F.lit(1))) is None
