"""GeoTIFF tiles read by Spark, and tiled terrain against the untiled raster."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.operators import raster, terrain
from meridian.operators.raster import NODATA
from meridian.plans.q_terrain import ORACLE_SQL, QUERIES
from meridian.sources import geotiff

SIDE = 8
TILE = "zoom int, x int, y int, heights array<float>"


def tiff(a, *, order="<", block=None, rows=3, deflate=False, predictor=1, bands=1, planar=1, nodata=None, transform=None):
    """A file of an array, put together apart from the library: strips of some rows, or tiles of block x block."""
    a = np.repeat(a[:, :, None], bands, 2) + (np.arange(bands) * 100).astype(a.dtype)
    h, w, size = *a.shape[:2], a.dtype.itemsize
    planes = [a] if planar == 1 else [a[:, :, i : i + 1] for i in range(bands)]
    parts = []
    for p in planes:
        if block:
            cuts = [np.pad(p[y : y + block, x : x + block], ((0, max(0, y + block - h)), (0, max(0, x + block - w)), (0, 0))) for y in range(0, h, block) for x in range(0, w, block)]
        else:
            cuts = [p[y : y + rows] for y in range(0, h, rows)]
        for c in cuts:
            if predictor == 2:
                c = np.concatenate([c[:, :1], np.diff(c, axis=1).astype(c.dtype)], axis=1)
            raw = c.astype(c.dtype.newbyteorder(order)).tobytes()
            if predictor == 3:
                big = np.frombuffer(c.astype(c.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(c.shape[0], -1, size)
                line = big.transpose(0, 2, 1).reshape(c.shape[0], -1).astype(int)
                line[:, c.shape[2] :] = (line[:, c.shape[2] :] - line[:, : -c.shape[2]]) % 256
                raw = line.astype(np.uint8).tobytes()
            parts.append(zlib.compress(raw) if deflate else raw)
    body, offsets = b"", []
    for p in parts:
        offsets.append(8 + len(body))
        body += p
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    t = [(256, "H", [w]), (257, "H", [h]), (258, "H", [size * 8] * bands), (259, "H", [8 if deflate else 1]), (277, "H", [bands]), (284, "H", [planar]), (317, "H", [predictor]), (339, "H", [kind] * bands)]
    counts = [len(p) for p in parts]
    t += [(322, "H", [block]), (323, "H", [block]), (324, "I", offsets), (325, "I", counts)] if block else [(273, "I", offsets), (278, "H", [rows]), (279, "I", counts)]
    if nodata is not None:
        t.append((42113, "s", f"{nodata}\0".encode()))
    if transform:
        t.append((34264, "d", transform))
    ifd = b""
    for tag, f, v in sorted(t):
        raw = v if f == "s" else struct.pack(f"{order}{len(v)}{f}", *v)
        at = raw.ljust(4, b"\0")
        if len(raw) > 4:
            at = struct.pack(order + "I", 8 + len(body))
            body += raw
        ifd += struct.pack(order + "HHI", tag, {"H": 3, "I": 4, "d": 12, "s": 2}[f], len(v)) + at
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8 + len(body))
    return head + body + struct.pack(order + "H", len(t)) + ifd + b"\0" * 4


@pytest.mark.parametrize("dtype", ["i2", "u1", "u2", "i4", "f4", "f8"])
def test_files_of_many_layouts(dtype):
    a = np.random.default_rng(1).integers(0, 100, (11, 13)).astype(dtype)
    for order in "<>":
        for block in (None, 16, 4):
            for how in ({}, {"deflate": True}, {"deflate": True, "predictor": 2 if dtype[0] != "f" else 3}, {"bands": 3}, {"bands": 2, "planar": 2}, {"bands": 2, "deflate": True, "predictor": 2 if dtype[0] != "f" else 3}):
                got, place = geotiff.decode(tiff(a, order=order, block=block, **how))
                assert (got == a).all() and place == (0.0, 0.0, 1.0, 1.0), (order, block, how)
    a[2, 3] = 55
    got, _ = geotiff.decode(tiff(a, nodata=55))
    assert ((got == NODATA) == (a == 55)).all()


def test_round_trip_and_places():
    a = np.random.default_rng(2).normal(size=(5, 7)).astype(np.float32)
    a[0, 0] = NODATA
    got, place = geotiff.decode(geotiff.encode(a, (100.0, 900.0), (30.0, -30.0)))
    assert (got == a).all() and place == (100.0, 900.0, 30.0, -30.0)
    b = a.copy()
    b[1, 1], b[2, 2] = np.nan, np.inf
    got, place = geotiff.decode(tiff(b, transform=[2.0, 0, 0, 50.0, 0, -3.0, 0, 60.0] + [0.0] * 8))
    assert (got[1, 1], got[2, 2]) == (NODATA, NODATA) and place == (50.0, 60.0, 2.0, -3.0)


def test_read_opens_only_the_tiles_asked_for(spark, tmp_path):
    rng = np.random.default_rng(3)
    tiles = {(x, y): rng.normal(size=(4, 4)).astype(np.float32) for x in range(9, 14) for y in range(98, 103)}
    for (x, y), a in tiles.items():
        os.makedirs(tmp_path / "9" / str(x), exist_ok=True)
        (tmp_path / "9" / str(x) / f"{y}.tif").write_bytes(geotiff.encode(a, (x * 10.0, y * 10.0)))
    (tmp_path / "9" / "13" / "102.tif").write_bytes(b"II*\0 no file")
    (tmp_path / "9" / "13" / "101.tif").write_bytes(b"")
    (tmp_path / "9" / "13" / "100.tif").write_bytes(geotiff.encode(tiles[9, 98])[:200])
    # a URI: Python's own open() cannot follow it
    path = tmp_path.as_uri()
    some = geotiff.read(spark, path, (10, 99, 11, 101))
    assert len(some.inputFiles()) == 6
    got = {(r["x"], r["y"]): r for r in some.collect()}
    assert set(got) == {(x, y) for x in (10, 11) for y in (99, 100, 101)}
    for k, r in got.items():
        assert r["zoom"] == 9 and (r["rows"], r["cols"], r["error"]) == (4, 4, None) and (r["origin_x"], r["origin_y"]) == (k[0] * 10.0, k[1] * 10.0)
        assert np.array_equal(np.float32(r["heights"]).reshape(4, 4), tiles[k])
    everything = geotiff.read(spark, path)
    assert everything.count() == 24 and len(everything.inputFiles()) == 25
    bad = everything.where("error is not null").collect()
    assert {(r["x"], r["y"]) for r in bad} == {(13, 100), (13, 102)} and all(r["heights"] is None and r["rows"] is None for r in bad)
    for none in ((0, 0, 5, 5), (11, 99, 10, 99), (-9, -9, -1, -1)):
        assert geotiff.read(spark, path, none).count() == 0
    assert geotiff.read(spark, path, zoom=3).count() == 0


def test_encoded_columns(spark):
    rows = [(1, [float(i) for i in range(16)], "a"), (2, None, "b"), (3, [1.0], "c")]
    d = spark.createDataFrame(rows, "id int, heights array<float>, error string")
    out = geotiff.decoded(d.withColumn("content", geotiff.encoded(F.col("heights"), 4)))
    got = {r["id"]: r for r in out.collect()}
    assert out.columns[0] == "id" and got[1]["heights"] == rows[0][1] and got[1]["error"] is None
    assert got[2]["heights"] is None and "no bytes" in got[3]["error"]


def whole(w, h, seed=4, gaps=True):
    rng = np.random.default_rng(seed)
    a = (rng.normal(size=(h * SIDE, w * SIDE)).cumsum(0).cumsum(1) * 3).astype(np.float32)
    if gaps:
        a[rng.random(a.shape) < 0.03] = NODATA
    return a


def cut(a, zoom=9):
    return [(zoom, x, y, a[y * SIDE : (y + 1) * SIDE, x * SIDE : (x + 1) * SIDE].ravel().tolist()) for y in range(a.shape[0] // SIDE) for x in range(a.shape[1] // SIDE)]


def joined(rows, w, h, what="heights", side=SIDE):
    out = np.full((h * side, w * side), np.nan)
    for r in rows:
        out[r["y"] * side : (r["y"] + 1) * side, r["x"] * side : (r["x"] + 1) * side] = np.reshape(list(r[what]) if what == "shade" else r[what], (side, side))
    return out


def test_seams_are_those_of_the_untiled_raster(spark):
    a = whole(5, 4)
    got = terrain.shaded(spark.createDataFrame(cut(a), TILE), SIDE, 30.0).collect()
    # beyond the border and beside gaps a pixel's own height stands for the missing ones
    ringed = np.pad(a, 1, constant_values=NODATA)
    assert np.allclose(joined(got, 5, 4, "slope"), raster.slope(ringed, 30.0)[1:-1, 1:-1], atol=1e-9)
    assert np.array_equal(joined(got, 5, 4, "shade"), raster.hillshade(ringed, 30.0)[1:-1, 1:-1])


def test_halo_of_every_width(spark):
    a = whole(3, 3)
    d = spark.createDataFrame(cut(a), TILE)
    for width in (0, 1, 3, SIDE):
        ringed = np.pad(a, width, constant_values=NODATA)
        n = SIDE + 2 * width
        for r in terrain.with_halo(d, SIDE, width).collect():
            want = ringed[r["y"] * SIDE : r["y"] * SIDE + n, r["x"] * SIDE : r["x"] * SIDE + n]
            assert np.array_equal(np.float32(r["halo"]).reshape(n, n), want), (width, r["x"], r["y"])
    with pytest.raises(ValueError):
        terrain.with_halo(d, SIDE, SIDE + 1)


def untiled(a, out_h, out_w, kind):
    return terrain.resample(a.astype(float), terrain.weights(a.shape[0], 0, a.shape[0], out_h, kind), terrain.weights(a.shape[1], 0, a.shape[1], out_w, kind))


@pytest.mark.parametrize("kind", ["average", "cubic", "spline"])
def test_other_zooms_equal_the_untiled_raster(spark, kind):
    a = whole(4, 2)
    d = spark.createDataFrame(cut(a), TILE)
    down = terrain.coarser(d, SIDE, kind).collect()
    assert {(r["zoom"], r["x"], r["y"]) for r in down} == {(8, x, 0) for x in range(2)}
    assert np.allclose(joined(down, 2, 1), untiled(a, SIDE, 2 * SIDE, kind), atol=1e-3)
    for levels in (1, 2):
        up = terrain.finer(d.withColumn("name", F.lit("n")), SIDE, levels, kind)
        assert up.columns == ["zoom", "x", "y", "heights", "name"]
        n = 1 << levels
        got = up.collect()
        assert len(got) == 8 * n * n and {r["zoom"] for r in got} == {9 + levels}
        assert np.allclose(joined(got, 4 * n, 2 * n), untiled(a, 2 * n * SIDE, 4 * n * SIDE, kind), atol=1e-3)


def test_weights_against_their_definition():
    w = terrain.weights(6, 0, 6, 3, "average")
    assert np.allclose(w, np.kron(np.eye(3), [0.5, 0.5]))
    # a straight slope stays straight under all kernels away from the ends
    line = np.arange(40.0)
    for kind in ("average", "cubic", "spline"):
        for out in (20, 80):
            m = terrain.weights(40, 0, 40, out, kind)
            v = (m @ line) / m.sum(1)
            at = (np.arange(out) + 0.5) * 40 / out - 0.5
            inner = slice(out // 4, 3 * out // 4)
            assert np.abs(v - at)[inner].max() < (0.3 if kind == "average" else 1e-9), (kind, out)
    with pytest.raises(ValueError):
        terrain.weights(4, 0, 4, 2, "none")


def test_at_zoom_raises_reduced_heights(spark):
    a = whole(4, 4, gaps=False)
    d = spark.createDataFrame(cut(a) + [(8, 0, 0, [0.0] * SIDE * SIDE)], TILE)
    assert terrain.gain(9) == 1.0 and terrain.gain(8) == 1.3 and terrain.gain(2) == terrain.gain(6) == 1.5**3 - 0.2
    got = terrain.at_zoom(d, SIDE, 7).collect()
    want = untiled(untiled(a, 16, 16, "cubic"), SIDE, SIDE, "cubic") * (1.5**2 - 0.2)
    assert len(got) == 1 and np.allclose(joined(got, 1, 1), want, rtol=1e-4, atol=1e-2)
    assert terrain.at_zoom(d, SIDE, 9).count() == 16 and terrain.at_zoom(d, SIDE, 11).count() == 256


def test_odd_rows_have_defined_results(spark):
    flat = [5.0] * (SIDE * SIDE)
    rows = [(9, 0, 0, flat), (9, 0, 0, flat), (9, 1, 0, None), (9, 1, 1, [1.0]), (9, 0, 1, [None, float("nan"), float("inf")] + flat[3:]), (None, 2, 2, flat), (9, -1, 0, flat)]
    d = spark.createDataFrame(rows, TILE).withColumn("slope", F.lit("own"))
    out = terrain.shaded(d, SIDE, 10.0)
    assert out.columns == ["zoom", "x", "y", "heights", "slope", "shade"] and out.count() == 7
    by = {(r["zoom"], r["x"], r["y"]): r["slope"] for r in out.collect()}
    assert set(by[9, 1, 0]) == set(by[9, 1, 1]) == {NODATA}
    assert set(by[9, 0, 0]) == set(by[None, 2, 2]) == {0.0} and by[9, 0, 1][:4] == [NODATA] * 3 + [0.0]
    down = {(r["zoom"], r["x"], r["y"]): r["heights"] for r in terrain.coarser(d, SIDE, "average").collect()}
    assert set(down) == {(8, 0, 0), (8, -1, 0), (None, 1, 1)}
    assert set(down[8, 0, 0]) == {5.0, NODATA} and down[8, -1, 0].count(5.0) == (SIDE // 2) ** 2
    empty = spark.createDataFrame([], TILE)
    assert terrain.shaded(empty, SIDE, 1.0).count() == terrain.coarser(empty, SIDE).count() == terrain.finer(empty, SIDE).count() == 0


def test_tiles_meet_by_equal_keys_only(spark):
    plan = terrain.shaded(spark.createDataFrame(cut(whole(2, 2)), TILE), SIDE, 1.0)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_terrain_queries_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL) == {"terrain_slopes", "terrain_pyramid"}
