"""Feature scans: box and level filters, first-writer and live-update merges.

A feature row: id, file_ord (order of the source it came from), min_zoom, max_zoom,
points (array of struct x, y, 31 bit), tags (array of struct tag, value). Box bounds kept
as plain columns (see with_bounds) let the filters reach the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: From this zoom on, an id that was seen before is always dropped.
DETAIL_ZOOM = 15


def with_bounds(features: DataFrame) -> DataFrame:
    """Adds left, top, right, bottom of the points; write them out so that scans can prune by them."""
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    return features.withColumns({"left": F.array_min(xs), "top": F.array_min(ys), "right": F.array_max(xs), "bottom": F.array_max(ys)})


def overlaps(left, top, right, bottom, other: tuple[int, int, int, int] | None = None) -> Column:
    """Inclusive overlap of the row's bounds with a box."""
    return (F.col("right") >= left) & (F.col("left") <= right) & (F.col("bottom") >= top) & (F.col("top") <= bottom)


def in_box(features: DataFrame, left: int, top: int, right: int, bottom: int) -> DataFrame:
    return features.where(overlaps(left, top, right, bottom))


def at_level(features: DataFrame, zoom: int) -> DataFrame:
    return features.where((F.col("min_zoom") <= zoom) & (F.col("max_zoom") >= zoom))


def tile_box(z: int, x: int, y: int) -> tuple[int, int, int, int]:
    size = 1 << (31 - z)
    return x * size, y * size, (x + 1) * size - 1, (y + 1) * size - 1


def out_code(x: Column, y: Column, left, top, right, bottom) -> Column:
    """Bits for the sides of a box that a point lies beyond: 1 left, 2 right, 4 above, 8 below."""
    b = lambda c, v: F.when(c, v).otherwise(0)
    return b(x < left, 1) + b(x > right, 2) + b(y < top, 4) + b(y > bottom, 8)


def crosses_box(points: Column, left, top, right, bottom) -> Column:
    """Whether any leg may touch the box: its ends share no side. One point alone is no leg."""
    n = F.size(points)
    code = lambda p: out_code(p["x"], p["y"], left, top, right, bottom)
    legs = F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: code(a).bitwiseAND(code(b)) == 0)
    return F.exists(legs, lambda v: v)


def first_of_each(rows: DataFrame, zoom: int, order: str = "file_ord") -> DataFrame:
    """One row an id, the first by order; ids of 0 and below are never merged.

    Below DETAIL_ZOOM only rows of one id that also start and end at the same points are
    copies of each other. Rows that tie in order are told apart by their number of points.
    """
    keys = [F.col("id")]
    if zoom < DETAIL_ZOOM:
        keys += [F.get("points", F.lit(0)), F.get("points", F.size("points") - 1)]
    w = W.partitionBy(*keys).orderBy(order, F.size("points").desc())
    named = rows.where("id > 0").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return named.unionByName(rows.where("id <= 0 or id is null"))


def without_deleted(rows: DataFrame, deleted: DataFrame, order: str = "file_ord") -> DataFrame:
    """Rows whose id is not deleted by a source at or before their own: deleted has id and order."""
    gone = deleted.groupBy("id").agg(F.min(order).alias("_gone"))
    return rows.join(gone, "id", "left").where(F.col("_gone").isNull() | (F.col("_gone") > F.col(order))).drop("_gone")


def ocean_share(cells: DataFrame, ocean: str = "ocean") -> Column:
    """Share of ocean cells; a tile without coast is water from one half on."""
    return F.avg(F.col(ocean).cast("int"))


def union_first(*sources: DataFrame) -> DataFrame:
    """Union in which the first source that has an id keeps it; ids of 0 and below all stay."""
    out = None
    for k, s in enumerate(sources):
        s = s.withColumn("_src", F.lit(k))
        out = s if out is None else out.unionByName(s)
    least = out.where("id > 0").groupBy("id").agg(F.min("_src").alias("_least"))
    return out.join(least, "id", "left").where("_least is null or _src = _least").drop("_src", "_least")
