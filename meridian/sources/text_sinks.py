"""Text forms of results (JSON of features, track and segment listings) and a catalogue of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_json(*cols: str) -> Column:
    """A row's columns as a JSON object; missing ones are left out."""
    return F.to_json(F.struct(*cols))


def json_arrays(rows: DataFrame, key: str, *cols: str) -> DataFrame:
    """Rows (key, json): an array of objects for each key, in the order of the first column."""
    return rows.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*cols)))).alias("json"))


def track_lines(points: DataFrame, key: str = "trace", order: str = "ind") -> DataFrame:
    """Rows (key, order, line): a GPX track point for each row, values to seven decimals."""
    line = F.format_string('<trkpt lat="%.7f" lon="%.7f"/>', F.col("lat"), F.col("lon"))
    return points.select(key, order, line.alias("line"))


def track(points: DataFrame, key: str = "trace", order: str = "ind") -> DataFrame:
    """Rows (key, gpx): a whole document for each trace."""
    lines = track_lines(points, key, order).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "line"))).alias("l"))
    body = F.array_join(F.transform("l", lambda r: r["line"]), "\n")
    return lines.select(key, F.concat(F.lit('<?xml version="1.0"?>\n<gpx version="1.1"><trk><trkseg>\n'), body, F.lit("\n</trkseg></trk></gpx>")).alias("gpx"))


def segment_lines(route: DataFrame) -> Column:
    """<segment .../> of a route row with road_id, i, j, seconds, length and turn."""
    return F.format_string('<segment id="%d" start="%d" end="%d" time="%.2f" distance="%.1f" turn="%s"/>', F.col("road_id"), F.col("i"), F.col("j"), F.col("seconds"), F.col("length"), F.coalesce("turn", F.lit("")))


def dictionary(rows: DataFrame, col: str) -> DataFrame:
    """Rows (value, code) of the distinct values of a column, codes 0, 1, ... by value within the distinct set."""
    from ..operators.styles import positions

    d = rows.select(F.col(col).alias("value")).where(F.col(col).isNotNull()).distinct()
    return positions(d, "value", "value", "code").withColumn("code", F.col("code") - 1)


def merge_catalog(known: DataFrame, new: DataFrame) -> DataFrame:
    """Catalogue rows (name, size, ...): a file listed anew replaces its old row."""
    return known.join(new.select("name"), "name", "left_anti").unionByName(new)


def stale(known: DataFrame, files: DataFrame) -> DataFrame:
    """Files (name, size) that the catalogue has not, or has with another size."""
    return files.join(known.select("name", "size"), ["name", "size"], "left_anti")


def bundle(types: Column) -> Column:
    """Types (array of tag, value) as 'tag=value' texts joined by semicolons."""
    return F.array_join(F.transform(types, lambda t: F.concat_ws("=", t["tag"], t["value"])), ";")


def unbundle(text: Column) -> Column:
    """bundle() undone; a value may hold equals signs."""
    part = lambda s: F.struct(F.regexp_extract(s, "^([^=]*)=", 1).alias("tag"), F.regexp_extract(s, "(?s)^[^=]*=(.*)$", 1).alias("value"))
    return F.transform(F.filter(F.split(text, ";"), lambda s: s != ""), part)
