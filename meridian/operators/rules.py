"""Routing rule lists: XML compiled to one column expression per attribute.

<profile><way attribute="speed">
  <if param="winter"><select value="20" t="highway" v="track"/></if>
  <select value=":default"/> <select value="$maxspeed" t="maxspeed"> <gt value1="$lanes" value2="1"/> </select>
</way></profile>

Within a way the first select whose conditions all hold gives the value; a select has the
conditions of every element around it. Conditions: t (and v) a tag, if / ifnot the same for
what they hold (param: known when compiled), gt ge lt le eq two values. A value is a
constant, $tag or :parameter. Values that are missing never compare and never select.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text

READERS: dict[str, Callable[[Column], Column]] = {
    "": text.leading_number,
    "speed": lambda v: F.when((v == "none") | text.leading_number(v).isNotNull(), text.parse_speed(v)),
    "weight": lambda v: F.when(text.leading_number(v).isNotNull(), text.parse_weight(v)),
    "length": lambda v: F.when(text.leading_number(v).isNotNull(), text.parse_length(v)),
}
COMPARE = {"gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "eq": lambda a, b: a == b}


def _value(v: str, kind: str, tags: Column, params: dict[str, str]) -> Column:
    read = READERS[kind]
    if v.startswith("$"):
        return read(F.element_at(tags, v[1:]) if tags is not None else F.lit(None))
    if v.startswith(":"):
        return read(F.lit(params.get(v[1:])).cast("string"))
    return read(F.lit(v))


def _own(e: ET.Element, tags: Column, params: dict[str, str]) -> Column:
    """The conditions an element states itself."""
    out = F.lit(True)
    if e.get("param"):
        out = F.lit(str(params.get(e.get("param"), "")).lower() not in ("", "false", "0"))
    if e.get("t"):
        have = F.element_at(tags, e.get("t"))
        out = out & F.coalesce(have == e.get("v") if e.get("v") is not None else have.isNotNull(), F.lit(False))
    return out


def compile_way(way: ET.Element, tags: Column, params: dict[str, str] | None = None) -> Column:
    """The column of one <way>: null where no select applies. tags: map of tag to value."""
    params = params or {}
    branches: list[tuple[Column, Column]] = []

    def compared(e: ET.Element) -> Column:
        out = F.lit(True)
        for c in e:
            if c.tag in COMPARE:
                a, b = (_value(c.get(k, ""), c.get("type", ""), tags, params) for k in ("value1", "value2"))
                out = out & F.coalesce(COMPARE[c.tag](a, b), F.lit(False))
        return out

    def walk(e: ET.Element, around: Column) -> None:
        for c in e:
            if c.tag == "select":
                inner = around & _own(c, tags, params) & compared(c)
                for n in c:
                    if n.tag in ("if", "ifnot"):
                        inner = inner & (_own(n, tags, params) if n.tag == "if" else ~_own(n, tags, params))
                branches.append((inner, _value(c.get("value", ""), c.get("type") or way.get("type", ""), tags, params)))
            elif c.tag in ("if", "ifnot"):
                own = _own(c, tags, params) & compared(c)
                walk(c, around & (own if c.tag == "if" else ~own))

    walk(way, F.lit(True))
    return F.coalesce(*[F.when(cond, value) for cond, value in branches], F.lit(None).cast("double"))


def compile_profile(xml: str, tags: Column, params: dict[str, str] | None = None) -> dict[str, Column]:
    """A column for each attribute of a profile; parameters default to the profile's <attribute> elements."""
    root = ET.fromstring(xml)
    known = {a.get("name"): a.get("value") for a in root.iter("attribute")} | (params or {})
    return {w.get("attribute"): compile_way(w, tags, known) for w in root.iter("way")}
