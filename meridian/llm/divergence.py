"""Source divergence audit: how far the sources of a language lie apart in their use of terms.

One CountVectorizer serves every language: a term carries its language before it, so
document frequencies, the least number of documents and the vocabulary are each language's
own, and the vocabulary is never cut (vocabSize is the largest integer). Its sparse vectors
are summed by (language, source) as a Summarizer would, but entry by entry, so a sum needs
no dense array and combines before it is shuffled. A vocabulary beyond SHARD_TERMS is
built in shards of terms by hash, each with its own CountVectorizer, so what the driver
and a broadcast hold of it is bounded.

Pairs of sources are evaluated on blocks of terms, from the stored entries alone: a term that
a source lacks has the share of a count of zero, the same for all such terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, durable, stored, table

MIN_DOCS = 30
SMOOTHING = 5
UNIT = 1_000_000_000
TOP_TERMS = 50

#: Terms of one CountVectorizer at most (on average of the shards).
SHARD_TERMS = 1 << 19
#: Entries (sources x terms) of a block, and sources that a task compares with all of their language.
BLOCK, TILE = 1 << 20, 64
#: One term in so many is counted to size the shards.
ESTIMATE = 64
#: Entries of vectors that a task holds before it sums them.
HELD = 1 << 21

#: ASCII letters in lower case, all other ASCII a blank; bytes of other characters stay.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(128)) + bytes(range(128, 256))


def tokens(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows (lang, source, terms, more), one a document: its distinct terms, and its repeats of them, with a blank between, each with its language (percent-encoded) and a slash before it."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        out, more = [], []
        for body, tag in zip(b.column(0), b.column(1), strict=True):
            head = quote(tag.as_py(), safe="").encode() + b"/"
            count = Counter(body.as_py().encode().translate(_FOLD).split())
            again = [w for w, n in count.items() if n > 1 for _ in range(n - 1)]
            for to, words in ((out, count), (more, again)):
                to.append(head + (b" " + head).join(words) if words else None)
        return pa.record_batch([b.column(1), b.column(2), pa.array(out, pa.string()), pa.array(more, pa.string())], names=["lang", "source", "terms", "more"])

    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))))
    return batches(plain, "lang string, source string, terms string, more string", batch)


def vocabulary_size(words: DataFrame, min_docs: int) -> int:
    """About how many terms are in at least min_docs documents, by counting one term in ESTIMATE of them. It decides on the number of shards alone."""
    some = words.select(F.explode(F.split("terms", " ")).alias("term")).where(F.pmod(F.xxhash64("term"), F.lit(ESTIMATE)) == 0)
    each = some.groupBy("term").count()
    return each.where(F.col("count") >= min_docs).count() * ESTIMATE


def group_sums(vectors: DataFrame) -> DataFrame:
    """Rows (lang, source, i, n): vectors (lang, source, i, v as parallel arrays) summed by group, first in each task and then over all."""

    def task(it):
        held: dict[tuple, list] = defaultdict(list)
        n = 0

        def summed() -> int:
            for key, parts in held.items():
                total = np.bincount(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                at = np.flatnonzero(total).astype(np.int32)
                held[key] = [(at, total[at])]
            return sum(len(p[0][0]) for p in held.values())

        def flush():
            for (lang, source), [(at, total)] in held.items():
                yield pa.record_batch([pa.array([lang]), pa.array([source]), pa.array([at], pa.list_(pa.int32())), pa.array([total.astype(np.int64)], pa.list_(pa.int64()))], names=["lang", "source", "i", "n"])
            held.clear()

        for b in it:
            i, v = b.column(2), b.column(3)
            ends, start = i.offsets.to_numpy(), v.offsets.to_numpy()
            at, value = i.values.to_numpy(), v.values.to_numpy()
            for k, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                held[key].append((at[ends[k] : ends[k + 1]].copy(), value[start[k] : start[k + 1]].copy()))
            n += len(at)
            if n >= HELD:
                n = summed()
                if n >= HELD // 2:
                    yield from flush()
                    n = 0
        summed()
        yield from flush()

    parts = vectors.mapInArrow(task, "lang string, source string, i array<int>, n array<bigint>")
    return parts.select("lang", "source", F.inline(F.arrays_zip("i", "n"))).groupBy("lang", "source", "i").agg(F.sum("n").alias("n"))


def term_counts(words: DataFrame, min_docs: int, shard_terms: int) -> DataFrame:
    """Rows (lang, source, tid, term, n): occurrences of each kept term in each group that has it. tid numbers (lang, term)."""
    spark = words.sparkSession
    shards = max(1, -(-vocabulary_size(words, min_docs) // shard_terms))
    # CountVectorizer refuses an empty vocabulary: an empty term, which no text has, is always in it
    filler = spark.range(min_docs, numPartitions=1).select(F.array(F.lit("")).alias("terms"))
    words = words.where("terms is not null").withColumn("all", F.split(F.concat_ws(" ", "terms", "more"), " ")).withColumn("terms", F.split("terms", " "))
    out = None
    for s in range(shards):
        part = words if shards == 1 else words.withColumns({c: F.filter(c, lambda t, s=s: F.pmod(F.xxhash64(t), F.lit(shards)) == s) for c in ("terms", "all")})
        # the number of documents that have a term needs its repeats in none of them
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=(1 << 31) - 1).fit(part.select("terms").union(filler)).setInputCol("all")
        vector = F.unwrap_udt("vector")
        sums = group_sums(model.transform(part).select("lang", "source", vector["indices"].alias("i"), vector["values"].alias("v")))
        vocabulary = model.vocabulary
        names = pa.table({"i": pa.array(range(len(vocabulary)), pa.int32()), "term": pa.array([t.rpartition("/")[2] for t in vocabulary], pa.string())})
        tid = (F.lit(s).cast("long") * (1 << 31) + F.col("i")).alias("tid")
        got = stored(sums.join(F.broadcast(spark.createDataFrame(names)), "i").select("lang", "source", tid, "term", "n"), "term-counts")
        out = got if out is None else out.union(got)
    return out


def share(n, total, terms):
    """1 + floor(UNIT (n + SMOOTHING) / (total + SMOOTHING terms)), exact."""
    top = ((n + SMOOTHING).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(11,0)")).cast("decimal(38,0)")
    return F.call_function("div", top, (total + terms * SMOOTHING).cast("decimal(38,0)")) + 1


def _block_pairs(key: tuple, rows: pd.DataFrame, size: int) -> pd.DataFrame:
    """Of one block: summed differences of each source of the tile with every source of its language. Rows without tid give each source's share of a count of zero."""
    lang, _, tile = key
    base = rows[rows.tid.isna()].sort_values("code")
    zero = base.p.to_numpy(np.int64)
    e = rows[rows.tid.notna()].sort_values("code", kind="stable")
    src, p = e.code.to_numpy(np.int64), e.p.to_numpy(np.int64)
    ids, term = np.unique(e.tid.to_numpy(np.int64), return_inverse=True)
    lo, hi = np.searchsorted(src, np.arange(len(zero))), np.searchsorted(src, np.arange(len(zero)), "right")
    out = []
    for g in range(tile * size, min(len(zero), (tile + 1) * size)):
        own = p[lo[g] : hi[g]]
        mine = np.full(len(ids), zero[g])
        mine[term[lo[g] : hi[g]]] = own
        there = mine[term]
        more = np.r_[0, np.cumsum(np.abs(there - p) - np.abs(there - zero[src]))]
        value = (len(ids) - len(own)) * np.abs(zero[g] - zero) + np.abs(own[:, None] - zero[None, :]).sum(axis=0) + more[hi] - more[lo]
        out.append(pd.DataFrame({"lang": lang, "g": g, "h": np.arange(len(zero)), "value": value}))
    return pd.concat(out)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS, shard_terms: int = SHARD_TERMS, block: int = BLOCK) -> DataFrame:
    """Rows (lang, source, part, item, value, rank).

    Part `pair`: every other source of the language and the summed difference of shares over
    the language's kept terms. Part `term`: the first `top` kept terms that the source uses
    more than its language does. Nulls count as ''; repeated rows are documents of their
    own; a language without kept terms has pairs of value 0; ties go by item in byte order;
    an empty table gives no rows. Other columns are not read.
    """
    words = stored(tokens(docs, text, lang, source), "terms")
    counts = term_counts(words, min_docs, shard_terms)
    wholes = stored(counts.groupBy("lang", "tid", "term").agg(F.sum("n").alias("in_lang")), "lang-terms")
    langs = wholes.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = W.partitionBy("lang")
    groups = words.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "terms", "lang_total"]).withColumn("code", F.row_number().over(by_lang.orderBy("source")) - 1).withColumn("sources", F.count("*").over(by_lang))
    groups = durable(groups)

    shares = counts.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    blocks = F.ceil(F.col("terms") * F.col("sources") / block).cast("long")
    tiles = F.explode(F.sequence(F.lit(0), F.ceil(F.col("sources") / TILE).cast("int") - 1)).alias("tile")
    cells = shares.select("lang", F.pmod(F.xxhash64("tid"), blocks).alias("block"), tiles, "code", "tid", "p")
    bases = groups.where("terms > 0").select("lang", "code", "sources", share(F.lit(0), F.col("total"), F.col("terms")).alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    bases = bases.select("lang", "block", tiles, "code", F.lit(None).cast("long").alias("tid"), "p")
    size = TILE

    def pairs_of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _block_pairs(key, rows, size)

    apart = cells.union(bases).groupBy("lang", "block", "tile").applyInPandas(pairs_of, "lang string, g int, h int, value long")
    apart = apart.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    one, other = groups.select("lang", "source", F.col("code").alias("g")), groups.select("lang", F.col("source").alias("item"), F.col("code").alias("h"))
    pairs = one.join(other, "lang").where("g <> h").join(apart, ["lang", "g", "h"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    over = shares.join(wholes.drop("term"), ["lang", "tid"]).withColumn("value", F.col("p") - share(F.col("in_lang"), F.col("lang_total"), F.col("terms"))).where("value > 0")
    marked = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", rank).union(marked.select("*", rank).where(F.col("rank") <= top))


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
o AS (SELECT r, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS terms FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (({UNIT}::HUGEINT * (coalesce(c.n, 0) + {SMOOTHING})) // (g.total + {SMOOTHING} * v.terms)) AS p
    FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT lang, term, 1 + (({UNIT}::HUGEINT * (sum(n) + {SMOOTHING})) // (sum(sum(n)) OVER (PARTITION BY lang) + {SMOOTHING} * any_value(terms))) AS q FROM c JOIN v USING (lang) GROUP BY lang, term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
rows AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b USING (lang) LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source WHERE a.source <> b.source
    UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows
QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
"""

QUERIES = {"op12_divergence": op12_divergence}
ORACLE_SQL = {"op12_divergence": _SQL}
