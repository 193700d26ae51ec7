"""Height tiles of any extent: strips of neighbours, slopes without seams, and other zooms.

tiles rows: zoom, x, y and heights (array of side x side numbers, row by row). Heights that
are null, not finite or NODATA are not known, and so are all of a tile whose array is null or
of another size. Columns beside these are kept by with_halo, shaded and finer.

A tile never meets its neighbours' arrays, only the strips along their borders; other zooms
are reached two by two, so a tile is made from four whatever the zoom.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import raster
from .raster import NODATA

AROUND = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dx, dy) != (0, 0)]
#: A resampled height needs known ones under this share of its weights.
LEAST = 0.1
#: Source pixels that a kernel reaches over, at its own scale.
REACH = {"average": 0, "cubic": 2, "spline": 2}


def _whole(side: int) -> Column:
    """heights as floats with NODATA for what is not known; null where a tile has another size."""
    known = F.transform("heights", lambda h: F.when(h.isNull() | F.isnan(h.cast("double")) | (F.abs(h) == float("inf")), F.lit(NODATA)).otherwise(h).cast("float"))
    return F.when(F.size("heights") == side * side, known)


def _part(a: Column, side: int, row: int, rows: int, col: int, cols: int) -> Column:
    """A window of a tile's array, row by row."""
    return F.flatten(F.transform(F.sequence(F.lit(row), F.lit(row + rows - 1)), lambda r: F.slice(a, r * side + (col + 1), F.lit(cols))))


def _beside(parts: list[tuple[Column, int]], rows: int) -> Column:
    """Arrays of rows lines of their own widths, side by side, row by row."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.concat(*(F.slice(a, r * w + 1, F.lit(w)) for a, w in parts))))


def _blank(n: int) -> Column:
    return F.array_repeat(F.lit(NODATA).cast("float"), n)


def with_halo(tiles: DataFrame, side: int, width: int) -> DataFrame:
    """Adds halo: heights with width rows and columns of the tiles around, (side + 2 width) squared floats.

    Every tile sends eight strips, which combine before the shuffle; a tile that is not there
    leaves its strip unknown. Rows of one tile that repeat each keep their place and get the same
    strips; where they differ, the greatest strip in array order serves their neighbours.
    width is at most side. A null zoom, x or y has no neighbours.
    """
    if not 0 <= width <= side:
        raise ValueError("width must be from 0 to side")
    t = tiles.withColumn("_h", F.coalesce(_whole(side), _blank(side * side)))
    if width == 0:
        return t.withColumnRenamed("_h", "halo")
    span = {-1: (side - width, width), 0: (0, side), 1: (0, width)}
    # what the tile at (dx, dy) of a place shows it: its border that faces the place
    sent = [F.struct((F.col("x") - dx).alias("_x"), (F.col("y") - dy).alias("_y"), F.lit(i).alias("_k"), _part(F.col("_h"), side, *span[dy], *span[dx]).alias("_s")) for i, (dx, dy) in enumerate(AROUND)]
    s = t.select(F.col("zoom").alias("_z"), F.explode(F.array(*sent)).alias("_e")).select("_z", "_e.*")
    s = s.groupBy("_z", "_x", "_y").agg(*(F.max(F.when(F.col("_k") == i, F.col("_s"))).alias(f"_s{i}") for i in range(8)))
    # the tiles' file is small beside their arrays, which a broadcast would gather on the driver
    t = t.hint("merge").join(s, (t["zoom"] == s["_z"]) & (t["x"] == s["_x"]) & (t["y"] == s["_y"]), "left")
    size = {-1: width, 0: side, 1: width}
    strip = {d: F.coalesce(F.col(f"_s{i}"), _blank(size[d[0]] * size[d[1]])) for i, d in enumerate(AROUND)} | {(0, 0): F.col("_h")}
    rows = [_beside([(strip[dx, dy], size[dx]) for dx in (-1, 0, 1)], size[dy]) for dy in (-1, 0, 1)]
    return t.withColumn("halo", F.concat(*rows)).select(*tiles.columns, "halo")


def _square(v, n: int) -> np.ndarray:
    return np.asarray(v, np.float64).reshape(n, n)


def shaded(tiles: DataFrame, side: int, cell: float, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Adds slope (array of degrees, NODATA where not known) and shade (a byte a pixel), as those of the untiled raster.

    cell is the size of a pixel on the ground. At the border of all tiles, and beside unknown
    heights, a pixel's own height stands for the missing ones.
    """
    crop = slice(1, side + 1)

    def run(halo: pd.Series) -> pd.DataFrame:
        a = [_square(v, side + 2) for v in halo]
        slope = [raster.slope(h, cell)[crop, crop].ravel() for h in a]
        shade = [np.ascontiguousarray(raster.hillshade(h, cell, azimuth, altitude)[crop, crop]).tobytes() for h in a]
        return pd.DataFrame({"slope": pd.Series(slope, dtype=object), "shade": pd.Series(shade, dtype=object)})

    t = with_halo(tiles, side, 1)
    out = F.pandas_udf(run, "slope array<double>, shade binary")(F.col("halo"))
    keep = [c for c in tiles.columns if c not in ("slope", "shade")]
    return t.withColumn("_r", out).select(*keep, "_r.slope", "_r.shade")


def weights(n: int, start: float, stop: float, out: int, kind: str) -> np.ndarray:
    """out x n weights of source pixels for out pixels over [start, stop): by area, cubic convolution or B-spline."""
    step = (stop - start) / out
    lo = start + step * np.arange(out)[:, None]
    at = np.arange(n)[None, :]
    if kind == "average":
        return np.clip(np.minimum(lo + step, at + 1) - np.maximum(lo, at), 0, None) / step
    t = np.abs(at + 0.5 - (lo + step / 2)) / max(step, 1.0)
    if kind == "cubic":
        w = np.where(t < 1, (1.5 * t - 2.5) * t * t + 1, np.where(t < 2, ((-0.5 * t + 2.5) * t - 4) * t + 2, 0))
    elif kind == "spline":
        w = np.where(t < 1, (4 - 6 * t**2 + 3 * t**3) / 6, np.where(t < 2, (2 - t) ** 3 / 6, 0))
    else:
        raise ValueError(f"no kernel {kind}")
    return w / max(step, 1.0)


def resample(a: np.ndarray, wy: np.ndarray, wx: np.ndarray) -> np.ndarray:
    """Heights by weights of rows and columns, over known ones only; NODATA where those weigh too little."""
    known = a != NODATA
    total = wy @ known @ wx.T
    with np.errstate(all="ignore"):
        v = (wy @ np.where(known, a, 0.0) @ wx.T) / total
    return np.where(total >= LEAST, v, NODATA).astype(np.float32)


def coarser(tiles: DataFrame, side: int, kind: str = "cubic") -> DataFrame:
    """Tiles of the zoom before, each from up to four: rows (zoom, x, y, heights); side is even.

    Quarters of missing tiles are not known. Of tiles that repeat and differ, the greatest
    quarter in array order stays.
    """
    if side % 2:
        raise ValueError("side must be even")
    half, reach = side // 2, min(2 * REACH[kind], side)

    def run(halo: pd.Series) -> pd.Series:
        w = weights(side + 2 * reach, reach, side + reach, half, kind)
        return pd.Series([resample(_square(v, side + 2 * reach), w, w).ravel() for v in halo], dtype=object)

    t = with_halo(tiles.select("zoom", "x", "y", "heights"), side, reach)
    up = F.floor(F.col("x") / 2).cast(tiles.schema["x"].dataType), F.floor(F.col("y") / 2).cast(tiles.schema["y"].dataType)
    t = t.select((F.col("zoom") - 1).alias("zoom"), up[0].alias("_x"), up[1].alias("_y"), (F.pmod("y", F.lit(2)) * 2 + F.pmod("x", F.lit(2))).alias("_k"), F.pandas_udf(run, "array<float>")(F.col("halo")).alias("_q"))
    g = t.groupBy("zoom", "_x", "_y").agg(*(F.coalesce(F.max(F.when(F.col("_k") == i, F.col("_q"))), _blank(half * half)).alias(f"_q{i}") for i in range(4)))
    rows = [_beside([(F.col(f"_q{i}"), half), (F.col(f"_q{i + 1}"), half)], half) for i in (0, 2)]
    return g.select("zoom", F.col("_x").alias("x"), F.col("_y").alias("y"), F.concat(*rows).alias("heights"))


def finer(tiles: DataFrame, side: int, levels: int = 1, kind: str = "spline") -> DataFrame:
    """Tiles levels zooms on, 4^levels for each, every one resampled to side x side from its window."""
    n = 1 << levels
    reach = min(REACH[kind], side)

    def run(halo: pd.Series, i: pd.Series, j: pd.Series) -> pd.Series:
        at = [weights(side + 2 * reach, reach + k * side / n, reach + (k + 1) * side / n, side, kind) for k in range(n)]
        return pd.Series([resample(_square(v, side + 2 * reach), at[b], at[a]).ravel() for v, a, b in zip(halo, i, j)], dtype=object)

    t = with_halo(tiles, side, reach)
    k = F.explode(F.sequence(F.lit(0), F.lit(n * n - 1)))
    t = t.withColumn("_k", k).withColumns({"_i": (F.col("_k") % n).cast("int"), "_j": F.floor(F.col("_k") / n).cast("int")})
    new = {"zoom": F.col("zoom") + levels, "x": F.col("x") * n + F.col("_i"), "y": F.col("y") * n + F.col("_j"), "heights": F.pandas_udf(run, "array<float>")("halo", "_i", "_j")}
    return t.select(*(new[c].alias(c) if c in new else F.col(c) for c in tiles.columns))


def gain(zoom: int, native: int = 9) -> float:
    """Factor of heights below the native zoom, against the flattening of much reduced tiles."""
    # fixed values of the drawing
    return 1.5 ** min(native - zoom, 3) - 0.2 if zoom < native else 1.0


def at_zoom(tiles: DataFrame, side: int, zoom: int, native: int = 9, sharp: int = 12) -> DataFrame:
    """The tiles of zoom from those of the native zoom: cubic and raised below it, averages up to sharp, splines beyond.

    Below the native zoom each step halves the tiles before, so a kernel is applied once a
    zoom; beyond it a window is resampled in one step.
    """
    t = tiles.where(F.col("zoom") == native)
    if zoom > native:
        return finer(t, side, zoom - native, "average" if zoom <= sharp else "spline")
    for _ in range(native - zoom):
        t = coarser(t, side, "cubic")
    if zoom == native:
        return t
    f = F.lit(gain(zoom, native)).cast("float")
    return t.withColumn("heights", F.transform("heights", lambda h: F.when(h == NODATA, h).otherwise((h * f).cast("float"))))
