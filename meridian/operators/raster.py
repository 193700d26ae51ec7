"""Terrain rasters: slope, hill shade and colours of height tiles, by numpy in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed value: a height that is not known
NODATA = -32768.0


def gradients(heights: np.ndarray, cell: float) -> tuple[np.ndarray, np.ndarray]:
    """dz/dx and dz/dy by Horn's weights; the border repeats, unknown heights take their cell's own."""
    h = np.pad(heights.astype(np.float64), 1, mode="edge")
    mid = h[1:-1, 1:-1]
    n = {(i, j): np.where(h[1 + i : h.shape[0] - 1 + i, 1 + j : h.shape[1] - 1 + j] == NODATA, mid, h[1 + i : h.shape[0] - 1 + i, 1 + j : h.shape[1] - 1 + j]) for i in (-1, 0, 1) for j in (-1, 0, 1)}
    dx = (n[-1, 1] + 2 * n[0, 1] + n[1, 1] - n[-1, -1] - 2 * n[0, -1] - n[1, -1]) / (8 * cell)
    dy = (n[1, -1] + 2 * n[1, 0] + n[1, 1] - n[-1, -1] - 2 * n[-1, 0] - n[-1, 1]) / (8 * cell)
    return dx, dy


def slope(heights: np.ndarray, cell: float) -> np.ndarray:
    """Degrees; NODATA where the height is not known."""
    dx, dy = gradients(heights, cell)
    return np.where(heights == NODATA, NODATA, np.degrees(np.arctan(np.hypot(dx, dy))))


def hillshade(heights: np.ndarray, cell: float, azimuth: float = 315.0, altitude: float = 45.0, z: float = 1.0) -> np.ndarray:
    """0 to 255; 0 where the height is not known."""
    dx, dy = gradients(heights, cell)
    s = np.arctan(z * np.hypot(dx, dy))
    aspect = np.arctan2(dy, -dx)
    zen, az = np.radians(90 - altitude), np.radians((360 - azimuth + 90) % 360)
    v = np.cos(zen) * np.cos(s) + np.sin(zen) * np.sin(s) * np.cos(az - aspect)
    return np.where(heights == NODATA, 0, np.clip(np.rint(255 * v), 0, 255)).astype(np.uint8)


def relief(values: np.ndarray, stops: list[tuple[float, tuple[int, int, int, int]]]) -> np.ndarray:
    """RGBA between the colour stops around each value, those at the ends beyond them; clear where not known."""
    at = np.array([v for v, _ in stops])
    rgba = np.stack([np.interp(values, at, [c[k] for _, c in stops]) for k in range(4)], axis=-1)
    rgba[values == NODATA] = 0
    return np.rint(rgba).astype(np.uint8)


def blend(shade: np.ndarray, slopes: np.ndarray) -> np.ndarray:
    """Shade times the slope's darkness, both 0 to 255."""
    return (shade.astype(np.uint16) * slopes.astype(np.uint16) // 255).astype(np.uint8)


def shaded(tiles: DataFrame, side: int, cell: float) -> DataFrame:
    """Adds slope_mean and shade (bytes) to tiles with heights (array of side x side floats, row by row).

    A tile whose array has another size gets nulls.
    """

    def run(h: pd.Series) -> pd.DataFrame:
        mean, shade = [], []
        for v in h:
            a = np.asarray(v, dtype=np.float64) if v is not None else np.empty(0)
            if a.size != side * side:
                mean.append(None), shade.append(None)
                continue
            a = a.reshape(side, side)
            s = slope(a, cell)
            known = s[s != NODATA]
            mean.append(float(known.mean()) if len(known) else None)
            shade.append(hillshade(a, cell).tobytes())
        return pd.DataFrame({"slope_mean": pd.Series(mean, dtype=object), "shade": pd.Series(shade, dtype=object)})

    return tiles.withColumn("_r", F.pandas_udf(run, "slope_mean double, shade binary")(F.col("heights"))).select(*tiles.columns, "_r.slope_mean", "_r.shade")
