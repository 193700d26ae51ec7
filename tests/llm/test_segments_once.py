"""Segments are counted by anchor and found again in one shuffle."""

from __future__ import annotations

from meridian.llm import substring_dedup


def test_segments_are_shuffled_once(spark):
    rows = [(7, 1, 300), (7, 2, 301), (8, 1, 900), (9, 3, 5), (9, 3, 600)]
    met = substring_dedup._met(spark.createDataFrame(rows, "anchor long, key long, spot long"))
    got = {r[0]: sorted((s.anchor, s.spot) for s in r.segs) for r in met.collect()}
    assert got == {1: [(7, 300)], 2: [(7, 301)], 3: [(9, 5), (9, 600)]}
    plan = met._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan
