"""The vocabulary is fitted on distinct terms; their repeats go beside them."""

from __future__ import annotations

from meridian.llm import divergence


def test_terms_once_and_their_repeats(spark):
    d = spark.createDataFrame([("b A b b a c", "x", "s"), ("a", "x", "s"), ("1 2", None, "s"), (None, "x", "t")], "text string, lang string, source string")
    got = [(r.terms and sorted(r.terms.split(" ")), r.more and sorted(r.more.split(" "))) for r in divergence.tokens(d).collect()]
    assert got == [(["x/a", "x/b", "x/c"], ["x/a", "x/b", "x/b"]), (["x/a"], None), (None, None), (None, None)]
