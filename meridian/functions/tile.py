"""Web-Mercator tile arithmetic on columns. x31, y31: 31-bit tile numbers, y growing south."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: limits of the projection and the sphere of the distance formula
MAX_LATITUDE = 85.0511
EARTH_KM = 6372.8
EQUATOR31 = 1 << 30
ROW_ZOOM = 14
ROW_SIZE = 1 << (31 - ROW_ZOOM)


def rad(degrees: Column) -> Column:
    """Degrees to radians, dividing before multiplying."""
    return degrees / 180.0 * math.pi


def pow_zoom(zoom: Column) -> Column:
    """2^zoom; a fraction under 0.05 counts as none."""
    whole = (zoom >= 0) & (zoom - F.floor(zoom) < 0.05)
    return F.when(whole, F.pow(F.lit(2.0), F.floor(zoom))).otherwise(F.pow(F.lit(2.0), zoom))


def check_longitude(lon: Column) -> Column:
    """Wrapped by whole turns into -180 .. 180, both ends kept."""
    over = F.ceil((lon - 180) / 360)
    under = F.ceil((-180 - lon) / 360)
    return F.when(lon > 180, lon - 360 * over).when(lon < -180, lon + 360 * under).otherwise(lon)


def check_latitude(lat: Column) -> Column:
    """Moved by half turns into -90 .. 90, then cut at the projection's edge."""
    over = F.ceil((lat - 90) / 180)
    under = F.ceil((-90 - lat) / 180)
    inside = F.when(lat > 90, lat - 180 * over).when(lat < -90, lat + 180 * under).otherwise(lat)
    return F.greatest(F.lit(-MAX_LATITUDE), F.least(F.lit(MAX_LATITUDE), inside))


def mercator(lat: Column) -> Column:
    r = rad(lat)
    return F.ln(F.tan(r) + 1 / F.cos(r))


def tile_x(zoom: Column, lon: Column) -> Column:
    """Fractional tile column; the antimeridian itself is the last one."""
    return F.when(lon == 180, pow_zoom(zoom) - 1).otherwise((check_longitude(lon) + 180) / 360 * pow_zoom(zoom))


def tile_y(zoom: Column, lat: Column) -> Column:
    """Fractional tile row."""
    return (1 - mercator(check_latitude(lat)) / math.pi) / 2 * pow_zoom(zoom)


def x31(lon: Column) -> Column:
    """31-bit column of a longitude, truncated, at most 2^31 - 1."""
    n = (check_longitude(lon) + 180) / 360 * float(1 << 31)
    return F.least(n, F.lit(float((1 << 31) - 1))).cast("bigint")


def y31(lat: Column) -> Column:
    """31-bit row of a latitude, truncated, at most 2^31 - 1."""
    n = (1 - F.least(mercator(check_latitude(lat)), F.lit(math.pi)) / math.pi) / 2 * float(1 << 31)
    return F.least(n, F.lit(float((1 << 31) - 1))).cast("bigint")


def tile_longitude(zoom: Column, x: Column) -> Column:
    return x / pow_zoom(zoom) * 360.0 - 180.0


def tile_latitude(zoom: Column, y: Column) -> Column:
    """Latitude of a tile row; rows above the map (negative) mirror."""
    sign = F.when(y < 0, -1.0).otherwise(1.0)
    return F.atan(sign * F.sinh(math.pi * (1 - 2 * y / pow_zoom(zoom)))) * 180.0 / math.pi


def lon31(x: Column) -> Column:
    return tile_longitude(F.lit(21.0), x / 1024.0)


def lat31(y: Column) -> Column:
    return tile_latitude(F.lit(21.0), y / 1024.0)


def tile_id(x: Column, y: Column, zoom: int) -> Column:
    """One number for the zoom's tile that holds a 31-bit point; the key of grid joins."""
    shift = 31 - zoom
    return F.shiftright(x, shift) * (1 << zoom) + F.shiftright(y, shift)


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine metres."""
    a = F.sin(rad(lat2 - lat1) / 2)
    b = F.sin(rad(lon2 - lon1) / 2)
    h = a * a + F.cos(rad(lat1)) * F.cos(rad(lat2)) * b * b
    return EARTH_KM * (2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))) * 1000


def distance31(xa: Column, ya: Column, xb: Column, yb: Column) -> Column:
    return distance(lat31(ya), lon31(xa), lat31(yb), lon31(xb))


def tile_distance_width(lat: Column, zoom: Column) -> Column:
    """Metres across one tile at a latitude."""
    return distance(lat, tile_longitude(zoom, F.lit(0.0)), lat, tile_longitude(zoom, F.lit(1.0)))


def unit_width(y: Column) -> Column:
    """Metres of one 31-bit unit at a row: linear between the edges of its zoom-14 row.

    The two edges depend on the row alone, so they are plain expressions and need no table.
    """
    row = F.floor(y / float(ROW_SIZE))
    part = y / float(ROW_SIZE) - row

    def edge(r: Column) -> Column:
        return tile_distance_width(lat31((r * ROW_SIZE).cast("double")), F.lit(float(ROW_ZOOM))) / float(ROW_SIZE)

    return part * edge(row + 1) + (1 - part) * edge(row)


def tile_metric(xa: Column, ya: Column, xb: Column, yb: Column) -> Column:
    """Fast metres between 31-bit points: flat at the middle row, split where a leg crosses the equator.

    Legs are a short array, so the width of a unit is written and worked out once a leg.
    """

    def leg(x1, y1, x2, y2):
        middle = F.floor(y1 / 2) + F.floor(y2 / 2)
        return F.struct(F.hypot((x2 - x1).cast("double"), (y1 - y2).cast("double")).alias("units"), middle.cast("double").alias("row"))

    eq = F.lit(EQUATOR31).cast("bigint")
    crosses = ((ya > eq) != (yb > eq)) & (ya != eq) & (yb != eq)
    mid = xa + ((xb - xa) * (eq - ya).cast("double") / (yb - ya)).cast("bigint")
    legs = F.when(crosses, F.array(leg(mid, eq, xb, yb), leg(mid, eq, xa, ya))).otherwise(F.array(leg(xa, ya, xb, yb)))
    return F.aggregate(legs, F.lit(0.0), lambda s, v: s + v["units"] * unit_width(v["row"]))


def metres3857(v31: Column) -> Column:
    """EPSG:3857 metres of a 31-bit coordinate measured from the west or north edge."""
    half = 20037508.342789244
    return v31 / float(1 << 31) * 2 * half - half


def scale_to_tile(coord: Column, start: Column, shift: int) -> Column:
    """A 31-bit coordinate in units of a tile that starts at start: shifted with rounding, symmetric about zero."""
    d = coord - start
    half = 1 << (shift - 1) if shift else 0
    return F.when(d >= 0, F.shiftright(d + half, shift)).otherwise(-F.shiftright(-d + half, shift))
