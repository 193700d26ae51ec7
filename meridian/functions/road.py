"""Attributes of a road row: types (array of tag, value), point_types (array of such arrays), names (map)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_value, has_tag, parse_speed

_TYPE_TAGS = ("highway", "route", "railway", "aeroway", "aerialway")


def value(types: Column, names: Column, tag: str) -> Column:
    """The first type's value for a tag, else the name under it, else empty."""
    return F.coalesce(first_value(types, tag), F.element_at(names, tag), F.lit(""))


def highway(types: Column) -> Column:
    return F.coalesce(first_value(types, "highway"), first_value(types, "route"))


def _oneway(t: Column) -> Column:
    return F.when(t["tag"] == "oneway", F.when(t["value"].isin("-1", "reverse"), -1).when(t["value"].isin("1", "yes", "true"), 1).otherwise(0)).when((t["tag"] == "junction") & t["value"].isin("roundabout"), 1).otherwise(0)


def oneway(types: Column) -> Column:
    """-1 against, 1 along, 0 both: the first oneway tag that says a way, else 1 on a roundabout."""
    said = F.get(F.filter(F.transform(F.filter(types, lambda t: t["tag"] == "oneway"), _oneway), lambda v: v != 0), F.lit(0))
    return F.coalesce(said, F.when(roundabout(types), 1), F.lit(0))


def roundabout(types: Column) -> Column:
    return F.exists(types, lambda t: (t["tag"].isin("junction") & (t["value"] == "roundabout")) | ((t["tag"] == "roundabout")))


def tunnel(types: Column) -> Column:
    return has_tag(types, "tunnel", "yes") | has_tag(types, "layer", "-1")


def lanes(types: Column) -> Column:
    """The first positive number of lanes, else -1."""
    n = F.transform(F.filter(types, lambda t: t["tag"] == "lanes"), lambda t: F.coalesce(t["value"].try_cast("int"), F.lit(0)))
    return F.coalesce(F.get(F.filter(n, lambda v: v > 0), F.lit(0)), F.lit(-1))


def name(names: Column, lang: str = "", tag: str = "name") -> Column:
    """The name in a language, else the plain one, else empty."""
    plain = F.element_at(names, tag)
    return F.coalesce(F.element_at(names, f"{tag}:{lang}"), plain, F.lit("")) if lang else F.coalesce(plain, F.lit(""))


def ref(names: Column, lang: str = "") -> Column:
    return name(names, lang, "ref")


def destination(names: Column, forward: Column, lang: str = "", tag: str = "destination") -> Column:
    """Where a road leads: in the language and direction first, then the direction, the language, the plain tag."""

    def ways(suffix: str) -> list[Column]:
        return [F.element_at(names, f"{tag}:{suffix}:{lang}"), F.element_at(names, f"{tag}:{suffix}")] if lang else [F.element_at(names, f"{tag}:{suffix}")]

    either = [F.element_at(names, f"{tag}:{lang}")] if lang else []
    along = F.coalesce(*ways("forward"), *either, F.element_at(names, tag))
    against = F.coalesce(*ways("backward"), *either, F.element_at(names, tag))
    return F.coalesce(F.when(forward, along).otherwise(against), F.lit(""))


def max_speed(types: Column, forward: Column, profile: str = "") -> Column:
    """Metres a second, the last tag that fits: for the profile over the generic one; 0 if none.

    Tags: maxspeed, maxspeed:forward, maxspeed:backward, and each with the profile before the direction.
    """

    def fits(stem: str) -> Column:
        tags = F.filter(types, lambda t: (t["tag"] == stem) | ((t["tag"] == f"{stem}:forward") & forward) | ((t["tag"] == f"{stem}:backward") & ~forward))
        return F.get(F.reverse(F.transform(tags, lambda t: parse_speed(t["value"]))), F.lit(0))

    return F.coalesce(*([fits(f"maxspeed:{profile}")] if profile else []), fits("maxspeed"), F.lit(0.0))


def private_access(types: Column, *modes: str) -> Column:
    return F.exists(types, lambda t: t["tag"].isin("access", *modes) & t["value"].isin("private"))


def platform(types: Column) -> Column:
    return F.exists(types, lambda t: (t["tag"].isin("railway", "public_transport", "highway")) & (t["value"] == "platform"))


def deleted(types: Column) -> Column:
    return has_tag(types, "change", "delete")


def point_has(point_types: Column, i: Column, tag: str, prefix: str) -> Column:
    """Whether point i has a tag whose value starts with a prefix; a point without types has none."""
    return F.coalesce(F.exists(F.get(point_types, i), lambda t: (t["tag"] == tag) & t["value"].startswith(prefix)), F.lit(False))


def traffic_light(point_types: Column, i: Column) -> Column:
    return point_has(point_types, i, "highway", "traffic_signals")


def as_feature(types: Column) -> dict[str, Column]:
    """types split into what names the kind of a way and the rest: columns types and additional."""
    return {"types": F.filter(types, lambda t: t["tag"].isin(*_TYPE_TAGS)), "additional": F.filter(types, lambda t: ~t["tag"].isin(*_TYPE_TAGS))}


def movement_allowed(way: Column, forward: Column, reverse: Column) -> Column:
    """Whether a search may move along a road: its oneway (-1, 0, 1), the direction on the road, and if the search runs backward."""
    along = forward != reverse
    return (way == 0) | F.when(along, way > 0).otherwise(way < 0)


def insert_point(arrays: dict[str, Column], at: Column, values: dict[str, Column]) -> dict[str, Column]:
    """Parallel arrays with one element more at a place (0: first), each kept in step."""
    return {k: F.array_insert(c, at + 1, values[k]) for k, c in arrays.items()}


def label_point(points: Column, dx: Column, dy: Column) -> dict[str, Column]:
    """Where a label stands: the mean of the points moved by an offset given five bits coarser."""
    n = F.size(points)
    mean = lambda k: F.floor(F.aggregate(points, F.lit(0).cast("bigint"), lambda s, p: s + p[k]) / n)
    return {"x": mean("x") + F.shiftleft(dx, 5), "y": mean("y") + F.shiftleft(dy, 5)}


def clockwise(types: Column, left_hand: Column) -> Column:
    """Whether a roundabout is driven clockwise: by its direction tag, else where traffic keeps to the left."""
    said = first_value(types, "direction")
    return F.coalesce(F.when(said == "clockwise", True).when(said.isin("counterclockwise", "anticlockwise"), False), left_hand)


def applies_in_direction(point_types: Column, i: Column, forward: Column, to_start: Column, to_end: Column, near: float = 50.0) -> Column:
    """Whether a sign at point i counts in a direction: by its direction tag, else unless it stands within near of where one comes from.

    to_start, to_end: metres along the road from the point to its ends.
    """
    types = F.coalesce(F.get(point_types, i), F.array().cast("array<struct<tag:string,value:string>>"))
    said = F.coalesce(first_value(types, "direction"), first_value(types, "traffic_signals:direction"))
    by_tag = F.when(said == "forward", forward).when(said == "backward", ~forward).when(said == "both", F.lit(True))
    behind = F.when(forward, to_start).otherwise(to_end)
    ahead = F.when(forward, to_end).otherwise(to_start)
    return F.coalesce(by_tag, ~((behind < near) & (ahead > near)))


def along_types(point_types: Column, forward: Column) -> Column:
    """Point types without those whose value or key names the other direction."""
    other = F.when(forward, "backward").otherwise("forward")
    keep = lambda t: ~(((t["tag"] == "direction") & (t["value"] == other)) | F.endswith(t["tag"], F.concat(F.lit(":"), other)))
    return F.transform(point_types, lambda ts: F.filter(ts, keep))


def exit_ref(point_names: Column, i: Column) -> Column:
    """The number of a motorway exit at point i: its junction reference, else its own; empty if it is none."""
    names = F.get(point_names, i)
    return F.coalesce(F.element_at(names, "junction:ref"), F.element_at(names, "ref"), F.lit(""))


def exit_name(point_names: Column, i: Column) -> Column:
    names = F.get(point_names, i)
    return F.coalesce(F.element_at(names, "exit_to"), F.element_at(names, "name"), F.lit(""))


def is_exit(point_types: Column, i: Column) -> Column:
    return F.coalesce(F.exists(F.get(point_types, i), lambda t: (t["tag"] == "highway") & (t["value"] == "motorway_junction")), F.lit(False))


def with_conditions(types: Column, conditions: Column) -> Column:
    """Types with what conditions (array of tag, value, holds) say where they hold: replaced in place, or added at the end.

    The last condition of a tag that holds counts.
    """
    live = F.filter(conditions, lambda c: c["holds"])
    new = lambda tag: F.get(F.reverse(F.filter(live, lambda c: c["tag"] == tag)), F.lit(0))["value"]
    kept = F.transform(types, lambda t: F.struct(t["tag"].alias("tag"), F.coalesce(new(t["tag"]), t["value"]).alias("value")))
    extra = F.array_distinct(F.transform(F.filter(live, lambda c: ~F.exists(types, lambda t: t["tag"] == c["tag"])), lambda c: F.struct(c["tag"].alias("tag"), new(c["tag"]).alias("value"))))
    return F.concat(kept, extra)


def arrow(types: Column, zoom: Column, least: int = 16) -> Column:
    """Oneway arrow on a map: 1 along, -1 against, 0 none; none below a zoom and on roundabouts."""
    return F.when((zoom >= least) & ~roundabout(types), oneway(types)).otherwise(0)


def class_group(types: Column) -> Column:
    """Rough classes of roads for filters by parameters: motorway, main, minor or other."""
    h = highway(types)
    return F.when(h.startswith("motorway") | h.startswith("trunk"), "motorway").when(h.rlike("^(primary|secondary|tertiary)"), "main").when(h.rlike("^(residential|unclassified|service|living_street|road)"), "minor").otherwise("other")
