"""Style sheets: XML rules over tag, value, zoom and properties, compiled to columns.

<style name="s" depends="base">
  <group minzoom="10">                          what holds for all rules inside
    <rule tag="highway" value="primary" color="#f00" width="3">   first that matches, in order
      <also nightMode="true" color="#800"/>     applied on top, all that match
    </rule>
    <rule tag="highway" color="#ccc"/>          without a value: any value of the tag
  </group>
</style>

Conditions are tag, value, minzoom, maxzoom, additional ("k", "k=v", "!k") and declared
properties; every other attribute is an output. A sheet that depends on another has its
rules first and the other's after.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

CONDITIONS = ("tag", "value", "minzoom", "maxzoom", "additional")


@dataclass
class Rule:
    when: dict[str, str]
    then: dict[str, str]
    also: list[Rule] = field(default_factory=list)
    around: list[dict[str, str]] = field(default_factory=list)


def _split(e: ET.Element, properties: set[str]) -> tuple[dict[str, str], dict[str, str]]:
    cond = {k: v for k, v in e.attrib.items() if k in CONDITIONS or k in properties}
    return cond, {k: v for k, v in e.attrib.items() if k not in cond}


def read(xml: str, resolve: Callable[[str], str] | None = None) -> tuple[list[Rule], set[str], dict[str, str]]:
    """(rules in order, declared properties, constants) of a sheet and those it depends on.

    Properties are <property name="..."/>, constants <constant name="..." value="..."/>
    and stand for $name in outputs. resolve gives the text of a sheet by its name.
    """
    root = ET.fromstring(xml)
    rules, properties, constants = [], set(), {}
    if root.get("depends") and resolve:
        base, properties, constants = read(resolve(root.get("depends")), resolve)
    else:
        base = []
    properties = properties | {p.get("name") for p in root.iter("property")}
    constants = constants | {c.get("name"): c.get("value") for c in root.iter("constant")}

    def also(e: ET.Element) -> list[Rule]:
        return [Rule(*_split(c, properties), also(c)) for c in e if c.tag == "also"]

    def walk(e: ET.Element, around: list[dict], shared: dict[str, str]) -> None:
        for c in e:
            if c.tag == "group":
                cond, out = _split(c, properties)
                walk(c, [*around, cond], shared | out)
            elif c.tag == "rule":
                cond, out = _split(c, properties)
                rules.append(Rule(cond, shared | out, also(c), around))

    walk(root, [], {})
    return rules + base, properties, constants


def _holds(cond: dict[str, str], tags: Column, zoom: Column, given: dict[str, str]) -> Column:
    out = F.lit(True)
    for k, v in cond.items():
        if k == "minzoom":
            out = out & (zoom >= int(v))
        elif k == "maxzoom":
            out = out & (zoom <= int(v))
        elif k == "tag":
            want = cond.get("value")
            out = out & F.exists(tags, lambda t: (t["tag"] == v) & (F.lit(True) if want is None else t["value"] == want))  # noqa: B023
        elif k == "additional":
            name, _, value = v.lstrip("!").partition("=")
            hit = F.exists(tags, lambda t: (t["tag"] == name) & (t["value"] == value if value else F.lit(True)))  # noqa: B023
            out = out & (~hit if v.startswith("!") else hit)
        elif k != "value":
            out = out & F.lit(str(given.get(k, "")) == v)
    return out


def compile_sheet(xml: str, tags: Column, zoom: Column, given: dict[str, str] | None = None, resolve: Callable[[str], str] | None = None) -> dict[str, Column]:
    """A text column for each output: of the first rule that holds (one with a value before one with the tag alone), with what it adds on top.

    given: the properties' values, known when compiled. Outputs that no rule sets are null.
    """
    rules, _, constants = read(xml, resolve)
    given = given or {}
    exact = [r for r in rules if "value" in r.when or "tag" not in r.when]
    order = exact + [r for r in rules if r not in exact]
    names = []

    def collect(r: Rule) -> None:
        names.extend(k for k in r.then if k not in names)
        for a in r.also:
            collect(a)

    for r in order:
        collect(r)

    def text(v: str) -> Column:
        return F.lit(constants.get(v[1:], v) if v.startswith("$") else v)

    def output(r: Rule, name: str) -> Column:
        out = text(r.then[name]) if name in r.then else F.lit(None).cast("string")
        for a in r.also:
            inner = output(a, name)
            out = F.when(_holds(a.when, tags, zoom, given) & inner.isNotNull(), inner).otherwise(out)
        return out

    holds = []
    for r in order:
        c = _holds(r.when, tags, zoom, given)
        for g in r.around:
            c = c & _holds(g, tags, zoom, given)
        holds.append(c)
    which = None
    for i, c in enumerate(holds):
        which = F.when(c, i) if which is None else which.when(c, i)
    out = {}
    for name in names:
        col = None
        for i, r in enumerate(order):
            v = output(r, name)
            col = F.when(which == i, v) if col is None else col.when(which == i, v)
        out[name] = col
    return out
