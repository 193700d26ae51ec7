"""Nulls, empty and very long texts, repeated rows, empty tables and clashing extra columns, for every operator."""

from __future__ import annotations

import pytest

from meridian.llm import decontaminate, embedding_dedup, html_extract, language_id, lm_score, packing, quality, secret_scan, simhash, substring_dedup

LONG = "lorem ipsum dolor sit amet " * 30_000
TEXTS = [(1, None), (2, ""), (3, "   \n\t"), (4, LONG), (5, "a b c d e f g"), (6, "a b c d e f g"), (6, "a b c d e f g"), (7, "x"), (8, "ÄÖ 東京 \U0001f600 word"), (None, "no id here")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id long, h string, n int, _m string, key long, anchor long, spans string, base string, _gone string, _new string, _quality double, _digest string, _row_key string, _md5 string, least long, rep long, slots string, trainer long, piece int, length long, rank long, score double, kept boolean, _owner string"


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, None if i == 1 else "en", None if i == 2 else "s", 0, 1, 2, "h", 3, "m", 4, 5, "sp", "b", "g", "w", 0.5, "d", "k", "5", 8, 9, "sl", 10, 6, 7, 8, 0.5, None, "o") for i, t in rows], DOCS)


def empty(spark):
    return docs(spark).limit(0)


BENCH = "item_id long, text string, doc_id long, n int, raw string"


def bench(spark):
    return spark.createDataFrame([(1, "a b c d e f g", 5, 1, ""), (2, None, 6, 1, ""), (3, "", 7, 2, ""), (3, "", 7, 2, ""), (4, "x", None, 0, "")], BENCH)


def ratings(spark):
    return spark.createDataFrame([(5, 2, "t"), (6, 0, "t"), (7, None, "t"), (None, 1, "t"), (4, 1, "t")], "doc_id long, grade int, text string")


OPS = {
    "language_id": lambda s, d: language_id.identify(d, language_id.vocabulary_path()),
    "decontaminate": lambda s, d: decontaminate.without_leaks(d, bench(s)),
    "packing": lambda s, d: packing.pack(d, packing.tokenizer_path()),
    "html": lambda s, d: html_extract.main_text(d.withColumnRenamed("text", "html")),
    "secrets": lambda s, d: secret_scan.report(d),
    "redact": lambda s, d: secret_scan.redacted(d),
    "substrings": lambda s, d: substring_dedup.remove_repeats(d),
    "lm": lambda s, d: lm_score.score(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "one_of_each": lambda s, d: simhash.one_of_each(d),
    "quality": lambda s, d: quality.classify(d, ratings(s)),
    "keep_best": lambda s, d: quality.keep_best(d, ratings(s)),
}


@pytest.mark.parametrize("name", OPS)
def test_edges(spark, name):
    rows = OPS[name](spark, docs(spark)).collect()
    if name == "one_of_each":
        assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 4, 5, 7, 8]
    elif name == "decontaminate":
        assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 2, 3, 4, 8]
    elif name == "packing":
        assert len({r.doc_id for r in rows}) == 9 and sum(r.length == 1 for r in rows) >= 2
    elif name == "keep_best":
        assert all(r._quality == 0.5 for r in rows)
    else:
        assert len(rows) == len(TEXTS)


@pytest.mark.parametrize("name", OPS)
def test_empty_table(spark, name):
    assert OPS[name](spark, empty(spark)).count() == 0


def test_empty_other_side(spark):
    d = docs(spark)
    assert decontaminate.leaks(d, bench(spark).limit(0)).count() == 0
    assert {r.p_top for r in quality.classify(d, ratings(spark).limit(0)).collect()} != set()


def test_language_edges(spark):
    got = {r.doc_id: r for r in language_id.identify(docs(spark), language_id.vocabulary_path()).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 5)] == ["und", "und", "und", "en"] and got[1].score == 0.0


def test_lm_edges(spark):
    got = {r.doc_id: r for r in lm_score.score(docs(spark)).collect()}
    assert got[1].n_tokens == got[3].n_tokens == 0 and got[2].mean_log_likelihood is None
    assert got[5].log_likelihood == got[6].log_likelihood < 0 and got[4].n_tokens == 150_000


def test_embedding_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 1), (12, [1.0, 0.0], 1), (13, [0.0, 1.0], 1), (14, [1e300, 1e-300], 1)]
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], "vec_id long, embedding array<double>, label int, node long, weight string")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).orderBy("vec_id").collect()]
    linked = {1, 2, 12, 14}
    for i, n, c, kept in got:
        assert (n, c, kept) == ((4, 1, i == 1) if i in linked else (0, i, True))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
