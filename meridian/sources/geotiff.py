"""Height tiles in GeoTIFF files, laid out as zoom/x/y.tif under a folder that Spark can read.

Spark lists, opens and retries the files (its binary file source, so any store it knows will
do) and spreads them over tasks by their bytes; a tile range becomes a path pattern, so
other files are neither opened nor, for other x, listed. Only the decoding of one file's
bytes is Python. Files hold one image of one band or more, of which the first is read:
strips or tiles, plain or deflated, with either predictor, integers or floats.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.raster import NODATA

# fixed values: numbers of TIFF tags, field sizes by type, and compressions
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS = 256, 257, 258, 259, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_OFFSETS, TILE_COUNTS, FORMAT = 284, 317, 322, 323, 324, 325, 339
SCALE, TIEPOINT, TRANSFORM, GDAL_NODATA = 33550, 33922, 34264, 42113
FIELDS = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
PLAIN, DEFLATE = 1, (8, 32946)

SCHEMA = "rows int, cols int, origin_x double, origin_y double, cell_x double, cell_y double, heights array<float>, error string"


def _tags(data: bytes) -> tuple[str, dict]:
    """Byte order and the first image's tags; those of unknown types are passed over."""
    e = {b"II": "<", b"MM": ">"}.get(data[:2])
    if e is None or struct.unpack_from(e + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(e + "I", data, 4)[0]
    tags = {}
    for k in range(struct.unpack_from(e + "H", data, at)[0]):
        p = at + 2 + 12 * k
        tag, kind, n = struct.unpack_from(e + "HHI", data, p)
        if kind not in FIELDS:
            continue
        size = struct.calcsize(FIELDS[kind]) * n
        start = p + 8 if size <= 4 else struct.unpack_from(e + "I", data, p + 8)[0]
        tags[tag] = data[start : start + n] if kind == 2 else struct.unpack_from(f"{e}{n}{FIELDS[kind]}", data, start)
    return e, tags


def _block(raw: bytes, tags: dict, e: str, h: int, w: int, bands: int, dtype: np.dtype) -> np.ndarray:
    """The first band of one strip or tile."""
    how = tags.get(COMPRESSION, (PLAIN,))[0]
    if how in DEFLATE:
        raw = zlib.decompress(raw)
    elif how != PLAIN:
        raise ValueError(f"compression {how} is not read")
    predictor = tags.get(PREDICTOR, (1,))[0]
    n = h * w * bands
    if len(raw) < n * dtype.itemsize:
        raise ValueError("a block is too short")
    if predictor == 3:
        # bytes of a row lie by significance, each as its difference from the one before
        b = np.frombuffer(raw, np.uint8, n * dtype.itemsize).reshape(h, -1, bands)
        b = np.cumsum(b, axis=1, dtype=np.uint8).reshape(h, dtype.itemsize, w * bands)
        a = np.ascontiguousarray(b.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(h, w, bands)
    else:
        a = np.frombuffer(raw, dtype.newbyteorder(e), n).reshape(h, w, bands)
        if predictor == 2:
            a = np.cumsum(a, axis=1, dtype=dtype.newbyteorder("="))
        elif predictor != 1:
            raise ValueError(f"predictor {predictor} is not read")
    return a[:, :, 0]


def decode(data: bytes) -> tuple[np.ndarray, tuple[float, float, float, float]]:
    """Heights (float32, NODATA where not known) and (origin_x, origin_y, cell_x, cell_y), zeros and ones if not given.

    Raises ValueError, struct.error or zlib.error for bytes that are not such a file.
    """
    e, t = _tags(data)
    w, h = t[WIDTH][0], t[HEIGHT][0]
    samples = t.get(SAMPLES, (1,))[0]
    kind = {1: "u", 2: "i", 3: "f"}.get(t.get(FORMAT, (1,))[0])
    bits = t.get(BITS, (1,))[0]
    if kind is None or bits not in (8, 16, 32, 64) or (kind == "f" and bits == 8):
        raise ValueError("a pixel format that is not read")
    dtype = np.dtype(f"{kind}{bits // 8}")
    # bands in planes of their own come plane by plane, so the first blocks are the first band's
    bands = samples if t.get(PLANAR, (1,))[0] == 1 else 1
    out = np.empty((h, w), np.float32)
    if TILE_OFFSETS in t:
        tw, th, offsets, counts = t[TILE_W][0], t[TILE_H][0], t[TILE_OFFSETS], t[TILE_COUNTS]
    else:
        tw, th, offsets, counts = w, min(t.get(ROWS, (h,))[0], h), t[OFFSETS], t[COUNTS]
    across = -(-w // tw)
    nodata = float(t[GDAL_NODATA].rstrip(b"\0 ")) if GDAL_NODATA in t else None
    for k in range(across * -(-h // th)):
        y, x = k // across * th, k % across * tw
        rows = th if TILE_OFFSETS in t else min(th, h - y)
        a = _block(data[offsets[k] : offsets[k] + counts[k]], t, e, rows, tw, bands, dtype)[: h - y, : w - x]
        gap = ~np.isfinite(a) if kind == "f" else np.zeros(a.shape, bool)
        if nodata is not None:
            gap |= a == np.float64(nodata).astype(dtype) if np.isfinite(nodata) and kind == "f" else a == nodata
        out[y : y + a.shape[0], x : x + a.shape[1]] = np.where(gap, NODATA, a)
    if TRANSFORM in t:
        m = t[TRANSFORM]
        return out, (m[3], m[7], m[0], m[5])
    if SCALE in t and TIEPOINT in t:
        sx, sy = t[SCALE][:2]
        i, j, _, gx, gy = t[TIEPOINT][:5]
        return out, (gx - i * sx, gy + j * sy, sx, -sy)
    return out, (0.0, 0.0, 1.0, 1.0)


def encode(heights: np.ndarray, origin: tuple[float, float] = (0.0, 0.0), cell: tuple[float, float] = (1.0, -1.0)) -> bytes:
    """A one-band file of float32 heights in one deflated strip."""
    h, w = heights.shape
    strip = zlib.compress(np.ascontiguousarray(heights, dtype="<f4").tobytes(), 6)
    gap = f"{NODATA:g}\0".encode()
    long, short, double = "I", "H", "d"
    entries = [(WIDTH, long, (w,)), (HEIGHT, long, (h,)), (BITS, short, (32,)), (COMPRESSION, short, (DEFLATE[0],)), (262, short, (1,)), (OFFSETS, long, (0,)), (SAMPLES, short, (1,)), (ROWS, long, (h,)), (COUNTS, long, (len(strip),)), (FORMAT, short, (3,)), (SCALE, double, (cell[0], -cell[1], 0.0)), (TIEPOINT, double, (0.0, 0.0, 0.0, *origin, 0.0)), (GDAL_NODATA, "c", gap)]
    number = {v: k for k, v in FIELDS.items()}
    first = 8 + 2 + 12 * len(entries) + 4
    extra, ifd = b"", struct.pack("<H", len(entries))
    sizes = sum(len(v) * struct.calcsize(f) for _, f, v in entries if len(v) * struct.calcsize(f) > 4)
    for tag, f, v in entries:
        v = (first + sizes,) if tag == OFFSETS else v
        raw = v if f == "c" else struct.pack(f"<{len(v)}{f}", *v)
        ifd += struct.pack("<HHI", tag, number[f], len(v))
        if len(raw) <= 4:
            ifd += raw.ljust(4, b"\0")
        else:
            ifd += struct.pack("<I", first + len(extra))
            extra += raw
    return b"II" + struct.pack("<HI", 42, 8) + ifd + b"\0" * 4 + extra + strip


def _decoded(content: pd.Series) -> pd.DataFrame:
    rows = []
    for data in content:
        try:
            if data is None:
                raise ValueError("no bytes")
            a, place = decode(bytes(data))
            rows.append((*a.shape, *place, a.ravel(), None))
        except (ValueError, KeyError, IndexError, struct.error, zlib.error) as ex:
            rows.append((None,) * 7 + (f"{type(ex).__name__}: {ex}",))
    return pd.DataFrame(rows, columns=["rows", "cols", "origin_x", "origin_y", "cell_x", "cell_y", "heights", "error"]).astype({"rows": "Int32", "cols": "Int32"})


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds rows, cols, origin_x, origin_y, cell_x, cell_y, heights (row by row) and error in place of a file's bytes.

    Bytes that are no readable file give nulls and the reason in error; columns of those
    names that the input has are replaced.
    """
    own = [c for c in files.columns if c not in {content, *(f.split()[0] for f in SCHEMA.split(", "))}]
    return files.withColumn("_d", F.pandas_udf(_decoded, SCHEMA)(F.col(content))).select(*own, "_d.*")


def encoded(heights: Column, side: int) -> Column:
    """Square tiles of heights (array) as files' bytes; null where the array is null or of another size."""

    def run(h: pd.Series) -> pd.Series:
        ok = lambda v: v is not None and len(v) == side * side
        return pd.Series([encode(np.asarray(v, np.float32).reshape(side, side)) if ok(v) else None for v in h], dtype=object)

    return F.pandas_udf(run, "binary")(heights)


def read(spark: SparkSession, path: str, tiles: tuple[int, int, int, int] | None = None, zoom: int = 9) -> DataFrame:
    """The tiles of a zoom: zoom, x, y and decoded's columns; tiles is (x0, y0, x1, y1), both ends included.

    A range without files gives no rows; so does a folder that is not there, and a file of no
    bytes, which Spark does not open.
    """
    span = lambda a, b: "{" + ",".join(str(v) for v in range(max(a, 0), b + 1)) + "}"
    none = spark.createDataFrame([], f"zoom int, x int, y int, {SCHEMA}")
    if tiles and (max(tiles[0], 0) > tiles[2] or max(tiles[1], 0) > tiles[3]):
        return none
    at = f"{span(tiles[0], tiles[2])}/{span(tiles[1], tiles[3])}.tif" if tiles else "*/*.tif"
    try:
        files = spark.read.format("binaryFile").load(f"{path.rstrip('/')}/{zoom}/{at}")
    except AnalysisException as ex:
        if ex.getCondition() != "PATH_NOT_FOUND":
            raise
        return none
    part = lambda k: F.element_at(F.split(F.regexp_replace("path", r"\.tif$", ""), "/"), k).cast("int")
    return decoded(files.select(part(-3).alias("zoom"), part(-2).alias("x"), part(-1).alias("y"), "content"))
