"""Features as Parquet laid out for box queries: folders by coarse tile, rows by fine tile, bounds as columns.

A query lists the coarse tiles its box touches, so other folders are never opened
(partition filters), and compares the bounds, so row groups outside are passed over (pushed
filters). A feature that spans coarse tiles lies in the folder of its own upper left tile at
the zoom where it fits one tile and its neighbours, given by level: few large ones lie in
the folders of low levels, which every query looks at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan

#: Zooms of the folders, coarse to fine.
LEVELS = (0, 4, 8)
#: Rows are sorted by the tile of this zoom inside a folder.
FINE = 14


def keyed(features: DataFrame) -> DataFrame:
    """features with bounds, level (the finest whose tile is as large as the feature), cell (its tile there) and fine."""
    f = scan.with_bounds(features)
    size = F.greatest(F.col("right") - F.col("left"), F.col("bottom") - F.col("top"))
    level = None
    for z in reversed(LEVELS):
        fits = size < (1 << (31 - z))
        level = F.when(fits, z) if level is None else level.when(fits, z)
    f = f.withColumn("level", level.otherwise(LEVELS[0]))
    cell = F.lit(0).cast("bigint")
    for z in LEVELS:
        tile = F.shiftright("left", 31 - z) * (1 << z) + F.shiftright("top", 31 - z)
        cell = F.when(F.col("level") == z, tile).otherwise(cell)
    fine = F.shiftright("left", 31 - FINE) * (1 << FINE) + F.shiftright("top", 31 - FINE)
    return f.withColumns({"cell": cell, "fine": fine})


def write(features: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Features without points are left out, as no box holds them.

    Rows are dealt by folder and fine tile: a crowded folder is written by several tasks,
    each with a range of its tiles.
    """
    f = keyed(features.where("size(points) > 0"))
    n = int(f.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = f.repartitionByRange(n, "level", "cell", "fine").sortWithinPartitions("level", "cell", "fine", "id")
    dealt.write.mode(mode).partitionBy("level", "cell").parquet(path)


def cells_of(box: tuple[int, int, int, int], level: int) -> list[int]:
    """Tiles of a level in which a feature that meets the box may start: those it touches and the ones before them."""
    shift = 31 - level
    x0, y0 = max(0, (box[0] >> shift) - 1), max(0, (box[1] >> shift) - 1)
    return [x * (1 << level) + y for x in range(x0, (box[2] >> shift) + 1) for y in range(y0, (box[3] >> shift) + 1)]


def read(spark: SparkSession, path: str, box: tuple[int, int, int, int] | None = None, zoom: int | None = None) -> DataFrame:
    """The features of a folder that meet a box and have a zoom."""
    f = spark.read.parquet(path)
    if box is not None:
        where = None
        for z in LEVELS:
            cells = cells_of(box, z)
            here = (F.col("level") == z) & (F.col("cell").isin(cells) if len(cells) <= 10_000 else F.lit(True))
            where = here if where is None else where | here
        f = scan.in_box(f.where(where), *box)
    if zoom is not None:
        f = scan.at_level(f, zoom)
    return f.drop("level", "cell", "fine")
