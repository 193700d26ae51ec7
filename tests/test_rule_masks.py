"""Rules as bit masks against the same rules compiled to one condition each."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from meridian.operators import rule_masks, rules
from meridian.plans.q_maps import PROFILE

MANY = (
    '<profile><attribute name="tall" value="3.5"/><attribute name="fast" value="true"/><way attribute="speed" type="speed">'
    + "".join(f'<select value="{k + 1}" t="t{k % 9}" v="v{k}"/>' for k in range(90))
    + '<if t="t1"><ifnot t="t2" v="v2"><select value="$maxspeed" t="maxspeed"/><if param="fast"><select value="99" t="t3"><le value1="$w" value2="7"/></select></if></ifnot></if>'
    '<select value=":missing" t="t4"/><select value="5" t="t5"><ifnot t="t6"/><if t="t7"/></select></way>'
    '<way attribute="obstacle"><select value="-1" t="barrier" v="gate"/><select value="$h" t="h" type="length"><gt value1="$h" value2=":tall" type="length"/></select></way>'
    '<way attribute="speed_priority"><if param="slow"><select value="0.1"/></if><ifnot param="fast"><select value="0.2"/></ifnot><select value="0.5" t="t8"/></way></profile>'
)


def tags(spark, rng, n=400):
    def one():
        out = {}
        for _ in range(rng.randrange(0, 6)):
            k = rng.randrange(95)
            out[f"t{k % 9}"] = f"v{k}"
        for name, values in (("maxspeed", ("30", "none", "50 mph", "x")), ("w", ("5", "7", "8", "?")), ("barrier", ("gate", "bollard")), ("h", ("2", "4", "3.5", "12'")), ("limit", ("20", "40")), ("type", ("ECONOMY", "SMALL")), ("brand", ("Brand#11", "Brand#12")), ("wide", ("yes",)), ("closed", ("yes", "no"))):
            if rng.random() < 0.4:
                out[name] = rng.choice(values)
        return out

    return spark.createDataFrame([(k, None if k == 0 else one()) for k in range(n)], "id int, tags map<string,string>")


@pytest.mark.parametrize("xml,params", [(MANY, {}), (MANY, {"fast": "false", "slow": "yes"}), (PROFILE, {}), (PROFILE, {"winter": "false"})])
def test_masks_equal_conditions(spark, xml, params):
    df = tags(spark, random.Random(len(xml) + len(params)))
    plain = rules.compile_profile(xml, F.col("tags"), params)
    want = {r.id: r.asDict() for r in df.select("id", *(c.cast("double").alias(a) for a, c in plain.items())).collect()}
    got = {r.id: r.asDict() for r in rule_masks.with_attributes(df, xml, params=params).drop("tags").collect()}
    assert len({repr(v) for v in want.values()}) > 4
    for k, row in want.items():
        assert got[k] == {a: rule_masks.DEFAULTS.get(a) if v is None and a != "id" else v for a, v in row.items()}, k


def test_bits_of_many_words(spark):
    known = rule_masks.intern(MANY)
    assert known.words == 2
    df = tags(spark, random.Random(2), 50)
    for r in df.select("tags", rule_masks.words_of(known, F.col("tags")).alias("w")).collect():
        have = {b for k, b in known.bits.items() if r.tags and (k in r.tags or any(k == t + rule_masks.SEP + v for t, v in r.tags.items()))}
        assert {b for b in range(128) if (r.w[b // 64] & ((1 << 64) - 1)) >> (b % 64) & 1} == have


def test_points(spark):
    df = spark.createDataFrame([(1, [{"barrier": "gate"}, None, {}, {"h": "4", "x": "y"}, {"h": "2"}])], "id int, p array<map<string,string>>")
    assert df.select(rule_masks.point_values(MANY, "obstacle", F.col("p")).alias("v")).first().v == [-1.0, 0.0, 0.0, 4.0, 0.0]


def test_plan_does_not_grow(spark):
    df = tags(spark, random.Random(1), 5)
    size = lambda n: len(rule_masks.with_attributes(df, '<profile><way attribute="speed">' + "".join(f'<select value="1" t="a{k}"/>' for k in range(n)) + "</way></profile>")._jdf.queryExecution().analyzed().treeString().split("("))
    assert size(5) == size(500)


def test_excluded_comparisons_are_refused():
    with pytest.raises(ValueError):
        rule_masks.intern('<profile><way attribute="speed"><ifnot t="a"><gt value1="$b" value2="1"/><select value="1"/></ifnot></way></profile>')
