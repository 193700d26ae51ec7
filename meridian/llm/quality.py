"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds
cut its score: P(grade >= k) = sigmoid(score - threshold_k). It is fitted in numpy on the
driver from a bounded sample of rated documents (FIT_ROWS, drawn by a hash of the id),
and every document's whole text is then scored where it lies.

Features are presence, not counts, so one telling word weighs the same in a long text as
in a short one: each distinct word (case folded, outer punctuation off) and its first four and
five letters, each word ending in symbols, and buckets of whole-text measures (share of distinct words, of words in
capitals, of words with symbols at the end, mean word length, length).
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, table

DIMS = 1 << 22
#: Rated documents used at most to fit; the bound is on the classifier's sample only.
FIT_ROWS = 12_000
#: A document is kept when the probability of the top grade is at least this.
KEEP_AT = 0.8
#: Standard errors by which the mean grade of a feature's rows must stand off to be used.
TELLING = 4.0
#: Standard deviations of the grade by which it must.
STRONG = 0.5
_CACHE_WORDS = 400_000
_EDGES = re.compile(r"^\W+|[\W_]+$")
_words: dict[str, tuple[int, ...]] = {}


def _index(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & (DIMS - 1)


def _of_word(w: str) -> tuple[int, ...]:
    core = _EDGES.sub("", w).lower()
    tail = re.search(r"[^\w\s]*$", w)[0]
    out = [_index("w:" + core)] if core else []
    out += [_index(f"p:{core[:k]}") for k in (4, 5) if len(core) > k]
    if tail:
        out.append(_index("t:" + tail))
    return tuple(out)


def features(text: str | None) -> list[int]:
    """Sorted distinct feature numbers of a whole text; null counts as empty."""
    words = (text or "").split()
    n = len(words)
    distinct = set(words)
    out: set[int] = set()
    if len(_words) > _CACHE_WORDS:
        _words.clear()
    for w in distinct:
        f = _words.get(w)
        if f is None:
            f = _words[w] = _of_word(w)
        out.update(f)
    measures = {
        "n": int(math.log2(n + 1)),
        "u": int(10 * len(distinct) / n) if n else -1,
        # few distinct words among many says little, as the share falls with length
        "v": int(2 * math.log2((len(distinct) + 1) / math.sqrt(n + 1))),
        "c": int(10 * sum(map(str.isupper, words)) / n) if n else -1,
        "s": int(10 * sum(1 for w in words if not w[-1].isalnum() and not w[-1] in ".,") / n) if n else -1,
        "l": int(2 * sum(map(len, words)) / n) if n else -1,
        "r": int(10 * sum(1 for a, b in zip(words, words[1:]) if a == b) / n) if n else -1,
    }
    out.update(_index(f"m:{k}:{v}") for k, v in measures.items())
    return sorted(out)


@dataclass
class OrdinalModel:
    """index: sorted feature numbers; weight: theirs; cuts: ascending thresholds of grades 1, 2, ..."""

    index: np.ndarray
    weight: np.ndarray
    cuts: np.ndarray

    def tails(self, rows: list[list[int]]) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: one row a document."""
        flat = np.fromiter((i for r in rows for i in r), dtype=np.int64)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        if len(self.index):
            at = np.minimum(np.searchsorted(self.index, flat), len(self.index) - 1)
            w = np.where(self.index[at] == flat, self.weight[at], 0.0)
        else:
            w = np.zeros(len(flat))
        s = np.bincount(owner, weights=w, minlength=len(rows))
        return 1 / (1 + np.exp(-np.clip(s[:, None] - self.cuts[None, :], -40, 40)))


def fit(rows: list[np.ndarray], grade: np.ndarray, steps: int = 200, l2: float = 1e-5, rate: float = 0.1) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty, by Adam on the whole sample.

    A feature takes part if it is in three rows or more and the mean grade of its rows is
    TELLING standard errors, and STRONG standard deviations, away from that of all; the
    many rare words would else learn the mistakes in the ratings by heart. One grade only, or no rows: no weights,
    thresholds from the shares of the grades.
    """
    grade = np.asarray(grade, dtype=np.int64)
    top = max(1, int(grade.max(initial=1)))
    n = len(rows)
    share = np.array([((grade >= k).sum() + 0.5) / (n + 1) for k in range(1, top + 1)])
    cuts = np.maximum.accumulate(np.log((1 - share) / share) + 1e-3 * np.arange(top))
    if n == 0 or len(set(grade.tolist())) < 2:
        return OrdinalModel(np.empty(0, np.int64), np.empty(0), cuts)
    # a thousand rows at a time: the driver never holds the whole sample at eight bytes a feature
    parts = [(k, np.concatenate(rows[k : k + 1024]), [len(r) for r in rows[k : k + 1024]]) for k in range(0, n, 1024)]
    dims = 1 + max(int(f.max(initial=0)) for _, f, _ in parts)
    count, away = np.zeros(dims, np.int64), np.zeros(dims)
    for k, f, sizes in parts:
        count += np.bincount(f, minlength=dims)
        away += np.bincount(f, weights=np.repeat(grade[k : k + 1024] - grade.mean(), sizes), minlength=dims)
    away /= np.sqrt(np.maximum(count, 1) * grade.var())
    ok = (count >= 3) & (count < n) & (np.abs(away) >= TELLING) & (np.abs(away) >= STRONG * np.sqrt(count))
    index, new = np.flatnonzero(ok), np.cumsum(ok, dtype=np.int32) - 1
    col = np.concatenate([new[f[ok[f]]] for _, f, _ in parts])
    owner = np.concatenate([np.repeat(np.arange(k, k + len(sizes), dtype=np.int32), sizes)[ok[f]] for k, f, sizes in parts])
    del count, away, parts
    w, m, v = np.zeros(len(index)), 0.0, 0.0
    gaps = np.r_[cuts[0], np.log(np.maximum(np.diff(cuts), 1e-3))]  # cuts = first, then positive steps
    gm, gv = 0.0, 0.0
    eps = 1e-12
    for t in range(1, steps + 1):
        cuts = np.cumsum(np.r_[gaps[0], np.exp(gaps[1:])])
        s = np.bincount(owner, weights=w[col], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(s[:, None] - cuts[None, :], -40, 40)))
        p = np.c_[np.ones(n), p, np.zeros(n)]
        hi, lo = p[np.arange(n), grade], p[np.arange(n), grade + 1]
        like = np.maximum(hi - lo, eps)
        dhi, dlo = hi * (1 - hi) / like, lo * (1 - lo) / like
        ds = -(dhi - dlo) / n
        dc = np.zeros(top + 2)
        np.add.at(dc, grade, dhi / n)
        np.add.at(dc, grade + 1, -dlo / n)
        dc = dc[1:-1]
        after = np.cumsum(dc[::-1])[::-1]
        dg = np.r_[after[0], after[1:] * np.exp(gaps[1:])]
        g = np.bincount(col, weights=ds[owner], minlength=len(index)) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        gm, gv = 0.9 * gm + 0.1 * dg, 0.99 * gv + 0.01 * dg * dg
        step = rate * math.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w = w - step * m / (np.sqrt(v) + 1e-8)
        gaps = gaps - step * gm / (np.sqrt(gv) + 1e-8)
    return OrdinalModel(index, w, np.cumsum(np.r_[gaps[0], np.exp(gaps[1:])]))


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", fit_rows: int = FIT_ROWS) -> OrdinalModel:
    """Fit on rated documents, fit_rows of them at most (drawn by a hash of the id when there are more).

    Rows of ratings with a null id or grade are left out; ids rated twice count twice.
    """
    rated = ratings.select(F.col(id_col), F.col(grade_col).cast("int").alias("_grade")).where(f"{id_col} is not null and _grade >= 0")
    n = rated.count()
    if n > fit_rows:
        part = int(fit_rows / n * (1 << 30))
        rated = rated.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < part)
    get = F.pandas_udf(lambda t: t.map(features), "array<int>")
    got = rated.join(docs.select(id_col, text_col), id_col).select("_grade", get(F.col(text_col)).alias("f")).toArrow()
    f = got.column("f").combine_chunks()
    flat, ends = f.values.to_numpy(), f.offsets.to_numpy()
    grade = got.column("_grade").to_numpy()
    return fit([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], grade)


def with_scores(docs: DataFrame, model: OrdinalModel, text_col: str = "text", out: str = "_quality") -> DataFrame:
    """docs with a struct column out: expected_grade and p_top (the probability of the top grade)."""

    def score(text: pd.Series) -> pd.DataFrame:
        tails = [model.tails([features(t) for t in text.iloc[k : k + 512]]) for k in range(0, len(text), 512)]
        p = np.concatenate(tails) if tails else np.empty((0, len(model.cuts)))
        return pd.DataFrame({"expected_grade": p.sum(axis=1), "p_top": p[:, -1]})

    return docs.withColumn(out, F.pandas_udf(score, "expected_grade double, p_top double")(F.col(text_col)))


def grades(labels: DataFrame) -> DataFrame:
    """The three grades of the labels table: one point for quality, one for not being toxic."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))


def classify(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """Rows (id_col, expected_grade, p_top, kept), one for each document.

    Null and empty texts are scored by their measures alone. Without any ratings the
    score rests on the prior and every document has the same one. Copies get the same
    score. Further columns are not read.
    """
    model = train(docs, ratings, id_col, text_col)
    scored = with_scores(docs.select(id_col, text_col), model, text_col)
    return scored.select(id_col, "_quality.expected_grade", "_quality.p_top", (F.col("_quality.p_top") >= keep_at).alias("kept"))


def keep_best(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The documents that classify() keeps, with all their columns.

    Rows with null ids or texts are judged as any other, and repeated rows alike. Without
    ratings the prior decides for all.
    """
    model = train(docs, ratings, id_col, text_col)
    col = fresh(docs, "_quality")
    return with_scores(docs, model, text_col, col).where(F.col(f"{col}.p_top") >= keep_at).select(*docs.columns)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), grades(table(spark, sf_dir, "labels")))


QUERIES = {"op10_quality": op10_quality}
