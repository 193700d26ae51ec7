"""Costs of road segments and turns on columns: seconds, metres, metres a second, radians."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: damping and ascent of the time model
DAMP_FROM = 15.0
ASCENT_HIKE, ASCENT_BIKE = 7.92, 8.2


def segment_cost(distance: Column, speed: Column, priority: Column, max_speed: Column) -> Column:
    """Distance over the speed weighed by priority, which is at most the largest speed."""
    return distance / F.least(speed * priority, max_speed)


def segment_time(distance: Column, speed: Column, priority: Column, max_speed: Column, obstacle: Column, height: Column) -> Column:
    """With obstacles and height on top; null if an obstacle blocks (below 0)."""
    return F.when((obstacle >= 0) & (height >= 0), segment_cost(distance, speed, priority, max_speed) + obstacle + height)


def estimate(distance: Column, max_speed: Column) -> Column:
    """Least time to go a straight distance: the search's heuristic."""
    return distance / max_speed


def clamped_speed(speed: Column, least: Column, most: Column) -> Column:
    return F.least(F.greatest(speed, least), most)


def turn_time(angle: Column, sharp: Column, slight: Column, roundabout: Column, was_roundabout: Column, priority_change: Column | None = None) -> Column:
    """Seconds lost in a turn by its angle (radians, either way): none on a roundabout, half its price when entering or leaving one."""
    a = F.abs(angle)
    by_angle = F.when(a > 2 * math.pi / 3, sharp).when(a > math.pi / 3, slight).when(a > math.pi / 6, slight / 2).otherwise(0.0)
    out = F.when(roundabout & was_roundabout, 0.0).when(roundabout != was_roundabout, slight / 2).otherwise(by_angle)
    return out if priority_change is None else out + F.abs(priority_change) / 2


def damped(distance: Column, speed: Column, cap: float = DAMP_FROM) -> Column:
    """Seconds over a distance; above the cap speed counts half, as fast roads are rarely driven at their limit."""
    return distance / F.when(speed > cap, cap + (speed - cap) / 2).otherwise(speed)


def ascent_time(climb: Column, per_metre: float = ASCENT_HIKE) -> Column:
    """Extra flat metres that a climb is worth, times a walker's second per metre."""
    return F.greatest(climb, F.lit(0.0)) * per_metre


def slope_bucket(rise: Column, run: Column) -> Column:
    """Per cent of slope in steps of three, centred: 1, 4, 7, ...; negative downhill; 0 within one per cent."""
    s = F.when(run > 0, rise / run * 100).otherwise(0.0)
    b = (F.floor((F.abs(s) + 2) / 3).cast("int") * 3 - 2)
    return F.when(F.abs(s) < 1, 0).otherwise(F.signum(s).cast("int") * b)
