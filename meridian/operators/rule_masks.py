"""Routing rule lists on interned tags: rules as bit masks, tested by one expression whatever their number.

The pairs and tags that a profile names are numbered; a row's tags become the bits of a few
longs, the numbers that rules compare become places of one array. A rule is a row of
data: the bits it needs, the bits it must not find, its comparisons and its value. An
attribute is the value of the first rule that holds. The language is that of rules.py.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import READERS

SEP = "\x1f"
RULE = "array<struct<need:array<bigint>,never:array<bigint>,tests:array<struct<op:string,a:int,b:int>>,value:int>>"
#: What an attribute is where no rule of it holds; of the others it is null.
DEFAULTS = {"obstacle": 0.0, "obstacle_srchpath": 0.0, "penalty_transition": 0.0, "speed_priority": 1.0, "destination_priority": 1.0}


@dataclass
class Interned:
    """bits: tag, or tag and value, to its number; slots: (source, reader) of each number compared; rules: attribute to its rules in order."""

    bits: dict[str, int] = field(default_factory=dict)
    slots: list[tuple[str, str]] = field(default_factory=list)
    rules: dict[str, list[dict]] = field(default_factory=dict)
    params: dict[str, str] = field(default_factory=dict)

    def bit(self, tag: str, value: str | None) -> int:
        return self.bits.setdefault(tag if value is None else tag + SEP + value, len(self.bits))

    def slot(self, source: str, kind: str) -> int:
        if (source, kind) not in self.slots:
            self.slots.append((source, kind))
        return self.slots.index((source, kind))

    @property
    def words(self) -> int:
        return max(1, -(-len(self.bits) // 64))


def intern(xml: str, params: dict[str, str] | None = None) -> Interned:
    """The rules of a profile as data. A condition that is excluded (ifnot) is a tag, a pair or a parameter; excluded comparisons belong to rules.compile_profile()."""
    root = ET.fromstring(xml)
    out = Interned(params={a.get("name"): a.get("value") for a in root.iter("attribute")} | (params or {}))

    def stated(e: ET.Element, never: bool, around: dict) -> dict | None:
        """around and what an element states itself; None if that can never hold."""
        got = {k: list(v) for k, v in around.items()}
        tests = [c for c in e if c.tag in ("gt", "ge", "lt", "le", "eq")]
        known = str(out.params.get(e.get("param"), "")).lower() not in ("", "false", "0") if e.get("param") else True
        if never and (tests or (e.get("param") and e.get("t"))):
            raise ValueError("an excluded condition must be one tag, pair or parameter")
        if e.get("param") and known == never:
            return None
        if e.get("t"):
            got["never" if never else "need"].append(out.bit(e.get("t"), e.get("v")))
        elif never and not e.get("param"):
            return None
        got["tests"] += [(c.tag, *(out.slot(c.get(k, ""), c.get("type", "")) for k in ("value1", "value2"))) for c in tests]
        return got

    def walk(e: ET.Element, around: dict | None, way: ET.Element) -> None:
        for c in e:
            if c.tag == "select":
                rule = around and stated(c, False, around)
                for n in c:
                    if n.tag in ("if", "ifnot") and rule is not None:
                        rule = stated(ET.Element(n.tag, n.attrib), n.tag == "ifnot", rule)
                if rule is not None:
                    rules.append(rule | {"value": out.slot(c.get("value", ""), c.get("type") or way.get("type", ""))})
            elif c.tag in ("if", "ifnot"):
                walk(c, around and stated(c, c.tag == "ifnot", around), way)

    for way in root.iter("way"):
        rules: list[dict] = []
        walk(way, {"need": [], "never": [], "tests": []}, way)
        out.rules[way.get("attribute")] = rules
    return out


def words_of(known: Interned, tags: Column) -> Column:
    """The bits of a map of tags, as longs."""
    place = F.from_json(F.lit(json.dumps(known.bits)), "map<string,int>")
    each = F.flatten(F.transform(F.map_entries(tags), lambda e: F.array(place[e["key"]], place[F.concat(e["key"], F.lit(SEP), e["value"])])))
    bits = F.array_compact(F.coalesce(each, F.array().cast("array<int>")))
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(b, F.lit(64)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(known.words - 1)), lambda w: F.aggregate(F.filter(bits, lambda b: F.floor(b / 64) == w), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(one(b))))


def numbers_of(known: Interned, tags: Column) -> Column:
    """The numbers that rules compare or give, null where missing."""

    def read(source: str, kind: str) -> Column:
        if source.startswith("$"):
            return READERS[kind](F.element_at(tags, source[1:]))
        return READERS[kind](F.lit(known.params.get(source[1:]) if source.startswith(":") else source).cast("string"))

    return F.array(*(read(*s).cast("double") for s in known.slots)) if known.slots else F.array().cast("array<double>")


def _mask(bits: list[int], words: int) -> list[int]:
    out = [0] * words
    for b in bits:
        out[b // 64] |= 1 << (b % 64)
    return [v - (1 << 64) if v >> 63 else v for v in out]


def value_of(known: Interned, attribute: str, words: Column, numbers: Column) -> Column:
    """The value of the first rule of an attribute that holds and has one, else its default."""
    rows = [{"need": _mask(r["need"], known.words), "never": _mask(r["never"], known.words), "tests": [{"op": o, "a": a, "b": b} for o, a, b in r["tests"]], "value": r["value"]} for r in known.rules.get(attribute, [])]
    rules = F.from_json(F.lit(json.dumps(rows)), RULE)

    def compares(t: Column) -> Column:
        a, b = numbers[t["a"]], numbers[t["b"]]
        out = F.when(t["op"] == "gt", a > b).when(t["op"] == "ge", a >= b).when(t["op"] == "lt", a < b).when(t["op"] == "le", a <= b).otherwise(a == b)
        return F.coalesce(out, F.lit(False))

    def holds(r: Column) -> Column:
        bits = F.forall(F.zip_with(words, r["need"], lambda a, b: a.bitwiseAND(b) == b), lambda v: v) & F.forall(F.zip_with(words, r["never"], lambda a, b: a.bitwiseAND(b) == 0), lambda v: v)
        return bits & F.forall(r["tests"], compares) & numbers[r["value"]].isNotNull()

    first = F.get(F.filter(rules, holds), F.lit(0))
    return F.coalesce(numbers[first["value"]], F.lit(DEFAULTS.get(attribute)).cast("double"))


def with_attributes(df, xml: str, tags: str = "tags", params: dict[str, str] | None = None, names: list[str] | None = None):
    """df with a column for each attribute of a profile (or those named). The rows' bits and numbers are made once for all of them."""
    known = intern(xml, params)
    take = list(known.rules) if names is None else names
    packed = df.select("*", words_of(known, F.col(tags)).alias("_words"), numbers_of(known, F.col(tags)).alias("_numbers"))
    return packed.select("*", *(value_of(known, a, F.col("_words"), F.col("_numbers")).alias(a) for a in take)).drop("_words", "_numbers")


def point_values(xml: str, attribute: str, point_tags: Column, params: dict[str, str] | None = None) -> Column:
    """The attribute at every point of a road (an array of maps of tags, null for points without any): its default there."""
    known = intern(xml, params)
    none = F.lit(DEFAULTS.get(attribute)).cast("double")
    return F.transform(point_tags, lambda t: F.when(t.isNull() | (F.size(t) == 0), none).otherwise(value_of(known, attribute, words_of(known, t), numbers_of(known, t))))
