"""Packed integers: road points, map ids, lanes, transport segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: bit places of the packed forms
RELATION_BIT = 1 << 42
SPLIT_BIT = 1 << 40
LANE_PRIMARY, LANE_SECONDARY, LANE_TERTIARY = (1, 4), (5, 5), (10, 5)


def point_id(road: Column, segment: Column, forward: Column) -> Column:
    """A directed road segment as one number: road, place, direction."""
    return F.shiftleft(road.cast("bigint"), 11) + F.shiftleft(segment.cast("bigint"), 1) + forward.cast("bigint")


def is_split(i: Column) -> Column:
    return (i > 0) & (i.bitwiseAND(SPLIT_BIT) == SPLIT_BIT)


def is_relation(i: Column) -> Column:
    return (i > 0) & (i.bitwiseAND(RELATION_BIT) == RELATION_BIT)


def source_id(i: Column) -> Column:
    """The id in the source data of a packed map id."""
    clear = i.bitwiseAND(~(RELATION_BIT | SPLIT_BIT))
    return F.shiftright(F.when(is_split(i) | is_relation(i), F.shiftright(clear, 5)).otherwise(i), 6)


def lane_active(lane: Column) -> Column:
    return lane.bitwiseAND(1) == 1


def lane_turn(lane: Column, place: tuple[int, int]) -> Column:
    """One of a lane's turns: place is LANE_PRIMARY, LANE_SECONDARY or LANE_TERTIARY."""
    at, bits = place
    return F.shiftright(lane, at).bitwiseAND((1 << bits) - 1)


def pack_lane(primary: Column, secondary: Column, tertiary: Column, active: Column) -> Column:
    return F.shiftleft(primary, LANE_PRIMARY[0]) + F.shiftleft(secondary, LANE_SECONDARY[0]) + F.shiftleft(tertiary, LANE_TERTIARY[0]) + active.cast("int")


def transit_id(route: Column, start: Column, segment: Column) -> Column:
    """A boarding of a public-transport route as one number; null where a part does not fit its bits."""
    fits = route.between(0, (1 << 39) - 1) & start.between(0, (1 << 11) - 1) & segment.between(0, (1 << 11) - 1)
    return F.when(fits, F.shiftleft(route.cast("bigint"), 22) + F.shiftleft(start.cast("bigint"), 11) + segment)


def transit_parts(packed: Column) -> dict[str, Column]:
    """transit_id() undone."""
    low = (1 << 11) - 1
    return {"route": F.shiftright(packed, 22), "start": F.shiftright(packed, 11).bitwiseAND(low), "segment": packed.bitwiseAND(low)}


def match_state(segment: Column, point: Column) -> Column:
    """A map-matching state: a directed segment and the trace point it was reached at."""
    return F.shiftleft(segment.cast("bigint"), 30) + point


def saturating_add(a: Column, b: Column) -> Column:
    """32-bit sum that stays at the ends of its range."""
    return F.greatest(F.lit(-(1 << 31)), F.least(F.lit((1 << 31) - 1), a.cast("bigint") + b)).cast("int")


def blend_bytes(a: Column, b: Column) -> Column:
    """Two colours of four bytes multiplied byte by byte, 255 standing for one."""
    part = lambda c, k: F.shiftright(c, k).bitwiseAND(255)
    out = F.lit(0).cast("bigint")
    for k in (0, 8, 16, 24):
        out = out + F.shiftleft((part(a.cast("bigint"), k) * part(b.cast("bigint"), k) / 255).cast("bigint"), k)
    return out
