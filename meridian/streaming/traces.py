"""Streaming fronts over trace points (trace, ts, x, y): an extension on top of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_cell(points: DataFrame, cell: int, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Points and distinct traces (approximate) for each window and grid cell; late points count until the watermark passes."""
    c = points.withWatermark("ts", late).withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    return c.groupBy(F.window("ts", window), "cx", "cy").agg(F.count("*").alias("points"), F.approx_count_distinct("trace").alias("traces"))


def trips(points: DataFrame, gap: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """Trips of each trace: runs of points with no gap between: (session, trace, points, box)."""
    t = points.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "trace")
    return t.agg(F.count("*").alias("points"), F.min("x").alias("left"), F.max("x").alias("right"), F.min("y").alias("top"), F.max("y").alias("bottom"))
