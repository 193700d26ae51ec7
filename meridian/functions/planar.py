"""Planar predicates and measures on columns; points are structs x, y, boxes four columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cross(ax, ay, bx, by, cx, cy) -> Column:
    """Above 0 if c lies to the left of a to b (y growing up)."""
    return (bx - ax).cast("double") * (cy - ay) - (by - ay).cast("double") * (cx - ax)


def segments_meet(a, b, c, d) -> Column:
    """Whether two closed segments touch, also along a common line; each end a struct column."""
    o = lambda p, q, r: F.signum(cross(p["x"], p["y"], q["x"], q["y"], r["x"], r["y"]))
    within = lambda p, q, r: (r["x"] >= F.least(p["x"], q["x"])) & (r["x"] <= F.greatest(p["x"], q["x"])) & (r["y"] >= F.least(p["y"], q["y"])) & (r["y"] <= F.greatest(p["y"], q["y"]))
    o1, o2, o3, o4 = o(a, b, c), o(a, b, d), o(c, d, a), o(c, d, b)
    return ((o1 != o2) & (o3 != o4)) | ((o1 == 0) & within(a, b, c)) | ((o2 == 0) & within(a, b, d)) | ((o3 == 0) & within(c, d, a)) | ((o4 == 0) & within(c, d, b))


def ring_contains(points: Column, x: Column, y: Column) -> Column:
    """Whether a ring holds a point: an odd number of its sides cross the ray to the east."""
    n = F.size(points)
    nxt = F.concat(F.slice(points, 2, F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1))

    def crosses(a, b):
        spans = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + (y - a["y"]).cast("double") * (b["x"] - a["x"]) / F.nullif((b["y"] - a["y"]).cast("double"), F.lit(0.0))
        return F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(F.zip_with(points, nxt, crosses), F.lit(0), lambda s, v: s + v) % 2 == 1


def clockwise(points: Column) -> Column:
    """Whether a ring runs clockwise as drawn with y growing south."""
    n = F.size(points)
    nxt = F.concat(F.slice(points, 2, F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1))
    twice = F.aggregate(F.zip_with(points, nxt, lambda a, b: a["x"].cast("double") * b["y"] - b["x"].cast("double") * a["y"]), F.lit(0.0), lambda s, v: s + v)
    return twice > 0


def overlap_area(a: tuple, b: tuple) -> Column:
    """Area that two boxes (left, top, right, bottom) share, 0 if none."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0)).cast("double") * F.greatest(h, F.lit(0))


def bearing(ax, ay, bx, by) -> Column:
    """Degrees clockwise from north, y growing south; 0 for one point."""
    return F.pmod(F.degrees(F.atan2((bx - ax).cast("double"), (ay - by).cast("double"))), F.lit(360.0))


def heading(points: Column, at: Column, forward: bool, least: float) -> Column:
    """Bearing from a point of a line to the first later (or earlier) one at least so far off; to the last if none is."""
    start = F.get(points, at)
    rest = F.slice(points, at + 2, F.greatest(F.size(points) - at - 1, F.lit(0))) if forward else F.reverse(F.slice(points, 1, at))
    far = F.filter(rest, lambda p: F.hypot((p["x"] - start["x"]).cast("double"), (p["y"] - start["y"]).cast("double")) >= least)
    end = F.coalesce(F.get(far, F.lit(0)), F.get(rest, F.size(rest) - 1))
    return bearing(start["x"], start["y"], end["x"], end["y"])


def screen_point(x: Column, y: Column, left: Column, top: Column, per_pixel: Column, angle: float = 0.0) -> dict[str, Column]:
    """31-bit to pixels of a view turned by an angle in degrees."""
    u, v = (x - left) / per_pixel, (y - top) / per_pixel
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    return {"x": u * c - v * s, "y": u * s + v * c}


def outlier_free(points: Column, most: float) -> Column:
    """Points without those that repeat the one before within most units."""
    keep = lambda p, i: (i == 0) | (F.hypot((p["x"] - F.get(points, i - 1)["x"]).cast("double"), (p["y"] - F.get(points, i - 1)["y"]).cast("double")) > most)
    return F.filter(points, keep)
