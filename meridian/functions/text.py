"""Strings, units and tag values on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number at the start of a value: a sign, digits, and decimals only if a digit follows the point.
NUMBER = r"^(-?[0-9]+(?:\.[0-9]+)?)"


def leading_number(v: Column) -> Column:
    """The number a value starts with, null if it starts with none."""
    s = F.regexp_extract(v, NUMBER, 1)
    return F.when(s != "", s.cast("double"))


def parse_speed(v: Column, default: float = 0.0) -> Column:
    """Metres a second; 'none' is 40, km/h unless 'mph' is named."""
    n = leading_number(v) / 3.6
    return F.when(v == "none", 40.0).otherwise(F.coalesce(F.when(F.contains(v, F.lit("mph")), n * 1.6).otherwise(n), F.lit(default)))


def parse_weight(v: Column, default: float = 0.0) -> Column:
    """Tonnes; pounds when 'lbs' or a double quote is named."""
    n = leading_number(v)
    pounds = F.contains(v, F.lit("lbs")) | F.contains(v, F.lit('"'))
    return F.coalesce(F.when(pounds, n * 0.4535 / 1000.0).otherwise(n), F.lit(default))


def _metres(number: Column, unit: Column) -> Column:
    has = lambda *names: unit.rlike("|".join(names))
    f = F.when(has("km"), number * 1000).otherwise(number)
    return F.when(has("in", '"'), f * 0.0254).when(has("'", "ft", "feet"), f * 0.3048).when(has("cm"), f * 0.01).when(has("mile"), f * 1609.34).otherwise(f)


def parse_length(v: Column, default: float = 0.0) -> Column:
    """Metres, each number with the unit after it, e.g. 14'10": parts are found in one pass and summed."""
    part = r"(-?[0-9]+(?:\.[0-9]+)?)([^0-9.-]*)"
    numbers = F.regexp_extract_all(v, F.lit(part), F.lit(1))
    units = F.regexp_extract_all(v, F.lit(part), F.lit(2))
    total = F.aggregate(F.zip_with(numbers, units, lambda n, u: _metres(n.cast("double"), u)), F.lit(0.0), lambda s, x: s + x)
    return F.when(leading_number(v).isNotNull(), total).otherwise(F.lit(default))


def interval_seconds(v: Column) -> Column:
    """Minutes, h:m, or h:m:s as seconds; parts that are no number count as 0, a negative sum as 0."""
    p = F.split(v, ":")
    num = lambda i: F.coalesce(F.get(p, F.lit(i)).try_cast("int"), F.lit(0))
    n = F.size(p)
    total = F.when(n == 1, num(0) * 60).when(n == 2, num(0) * 3600 + num(1) * 60).otherwise(num(0) * 3600 + num(1) * 60 + num(2))
    return F.when(v.isNull() | (v == ""), 0).otherwise(F.greatest(F.lit(0), total))


def split_distinct_runs(v: Column, sep: str) -> Column:
    """Parts joined again without empty ones and without one that equals the part kept before it."""
    parts = F.filter(F.split(v, "\\Q" + sep + "\\E", -1), lambda s: s != "")
    return F.array_join(F.filter(parts, lambda s, i: (i == 0) | (F.get(parts, i - 1) != s)), sep)


def parse_color(v: Column) -> Column:
    """#RRGGBB (opaque) or #AARRGGBB as a signed 32-bit number, null otherwise."""
    hex_ = F.when(v.rlike("^#[0-9a-fA-F]{6}$"), F.concat(F.lit("ff"), F.substring(v, 2, 6))).when(v.rlike("^#[0-9a-fA-F]{8}$"), F.substring(v, 2, 8))
    n = F.conv(hex_, 16, 10).cast("bigint")
    return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n)


def color_text(c: Column) -> Column:
    """#RRGGBB if opaque, else #AARRGGBB, lower case."""
    h = F.lower(F.lpad(F.hex(F.when(c < 0, c + (1 << 32)).otherwise(c)), 8, "0"))
    return F.when(h.startswith("ff"), F.concat(F.lit("#"), F.substring(h, 3, 6))).otherwise(F.concat(F.lit("#"), h))


def trim_blank(v: Column) -> Column:
    return F.regexp_replace(v, r"^[ \t\n\r\x0b\f]+|[ \t\n\r\x0b\f]+$", "")


def trim_marks(v: Column) -> Column:
    """Without bidirectional marks at either end."""
    return F.regexp_replace(v, "^[‎‏‪-‮]+|[‎‏‪-‮]+$", "")


def file_name(v: Column) -> Column:
    return F.regexp_extract(v, r"([^/\\]*)$", 1)


def short_ref(ref: Column, small: bool = False) -> Column:
    """A route reference cut at its last colon and to 5 (small) or 8 characters with an ellipsis."""
    head = F.when(F.instr(ref, ":") > 0, F.regexp_extract(ref, r"(?s)^(.*):[^:]*$", 1)).otherwise(ref)
    most = 5 if small else 8
    return F.when(F.length(head) > most, F.concat(F.substring(head, 1, most), F.lit("…"))).otherwise(head)


def first_value(tags: Column, key: str) -> Column:
    """The value of the first entry with a key in an array of (tag, value); null if there is none."""
    return F.get(F.filter(tags, lambda t: t["tag"] == key), F.lit(0))["value"]


def has_tag(tags: Column, key: str, value: str | None = None) -> Column:
    """Whether any entry has the key (and value)."""
    return F.exists(tags, lambda t: (t["tag"] == key) & (F.lit(True) if value is None else t["value"] == value))


def first_is(tags: Column, key: str, value: str) -> Column:
    """Whether the first entry with the key has the value."""
    return F.coalesce(first_value(tags, key) == value, F.lit(False))


def simple_layer(tags: Column) -> Column:
    """-1, 0 or 1: the first non-empty layer tag decides, else the last tunnel, else the last bridge tag."""
    layer = F.get(F.filter(tags, lambda t: (t["tag"] == "layer") & (t["value"] != "")), F.lit(0))["value"]
    last = lambda key: F.get(F.reverse(F.filter(tags, lambda t: t["tag"] == key)), F.lit(0))["value"]
    by_layer = F.when(layer.startswith("-"), -1).when(layer.startswith("0"), 0).otherwise(1)
    return F.when(layer.isNotNull(), by_layer).when(last("tunnel") == "yes", -1).when(last("bridge") == "yes", 1).otherwise(0)


def number_text(v: Column) -> Column:
    """A number as rule values are written: one decimal."""
    return F.format_string("%.1f", v.cast("double"))


def possible_index(values: Column, v: Column) -> Column:
    """Place of a number among possible values by its text, 0 if it is not there."""
    return F.greatest(F.coalesce(F.array_position(F.transform(values, number_text), number_text(v)).cast("int"), F.lit(0)) - 1, F.lit(0))


def parameters_text(params: Column) -> Column:
    """A map of parameters as 'key' (value true) or 'key=value', by key, joined by commas; false ones are left out."""
    entries = F.filter(F.array_sort(F.map_entries(params)), lambda e: e["value"] != "false")
    return F.array_join(F.transform(entries, lambda e: F.when(e["value"] == "true", e["key"]).otherwise(F.concat_ws("=", e["key"], e["value"]))), ",")


def scaled_value(v: Column, density: float) -> Column:
    """A drawing size 'a' or 'a:b': a scaled by the density and b pixels on top."""
    p = F.split(v, ":")
    num = lambda i: F.coalesce(F.get(p, F.lit(i)).try_cast("double"), F.lit(0.0))
    return num(0) * density + num(1)


def dashes(v: Column, density: float) -> Column:
    """A dash pattern 'a:b_c:d' as sizes."""
    return F.transform(F.split(v, "_"), lambda s: scaled_value(s, density))


def icon_name(v: Column, tags: Column) -> Column:
    """An icon's name 'prefix?tag?suffix' with the tag's value in it; empty if the tag is missing."""
    parts = F.split(v, "\\?")
    value = F.get(F.filter(tags, lambda t: t["tag"] == F.get(parts, F.lit(1))), F.lit(0))["value"]
    return F.when(F.size(parts) < 3, v).otherwise(F.coalesce(F.concat(F.get(parts, F.lit(0)), value, F.get(parts, F.lit(2))), F.lit("")))


def lower_ascii(v: Column) -> Column:
    """A to Z in lower case, all else as it is."""
    return F.translate(v, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without_version(v: Column) -> Column:
    """A file's name without the version digits at its end."""
    return F.regexp_replace(v, "[_0-8]+$", "")
