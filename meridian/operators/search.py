"""A whole map search: sources in order, deletions, levels, coast, background where detail is missing.

sources: (features, order) pairs of DataFrames with id, min_zoom, max_zoom, points, tags;
classes are told by tags (natural=coastline, change=delete) and by the basemap flag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_tag
from . import scan

#: From this zoom on the background map is only drawn where nothing else is.
DETAIL_FROM = 11


def map_search(features: DataFrame, box: tuple[int, int, int, int], zoom: int) -> DataFrame:
    """Rows of features (with file_ord and is_base) for a box and zoom, one an id, with kind: coast, base or detail.

    A source's deletions take out coastlines of sources at or after its own place; other
    objects are only replaced by the first source that has their id. Base rows come at low
    zooms, or at any zoom when there is no detail at all (a choice of the whole answer, so
    it costs one look for a detail row).
    """
    f = scan.in_box(scan.at_level(scan.with_bounds(features), zoom), *box)
    tags = F.col("tags")
    f = f.withColumns({"_delete": has_tag(tags, "change", "delete"), "_coast": has_tag(tags, "natural", "coastline")})
    dead = f.where("_delete").select("id", "file_ord")
    coast = scan.without_deleted(f.where("_coast and not _delete"), dead).withColumn("kind", F.lit("coast"))
    rest = f.where("not _coast and not _delete")
    detail = rest.where("not is_base").withColumn("kind", F.lit("detail"))
    base = rest.where("is_base").withColumn("kind", F.lit("base"))
    out = coast.unionByName(detail)
    if zoom < DETAIL_FROM or detail.limit(1).isEmpty():
        out = out.unionByName(base)
    return scan.first_of_each(out, zoom).drop("_delete", "_coast")


def class_counts(found: DataFrame) -> DataFrame:
    """How many objects of each kind, and the box they fill."""
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))
