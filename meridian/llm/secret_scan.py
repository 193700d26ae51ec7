"""Secret scans by corpus-wide ownership, in DataFrame operations only.

Patterns give each document's candidates with their places. Hashes of candidate values
are counted over distinct repositories and owners of the whole corpus: a value that many
owners carry is a copied example, one that few carry looks live. Shape-only patterns
(mixed tokens, key headers, passwords in addresses) are too loose alone and count as
secrets only when their value is owner-specific; the strict base kinds always stay and
carry the verdict beside them. A value is shared when both its owners and its repositories
are many: one owner's key in many of its repositories, or in one repository of many
owners, stays live. Where a table names one origin only, that is owner and repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, table

ASSIGN, ACCESS, HEX = "assign", "access", "hex"
#: Fixed patterns: kind, expression, group of the value, least characters of the value.
#: A run of one class that is too short has no part that is long enough, so those two
#: expressions ask for the length themselves; a short value of an assignment uses up its match.
BASE = (
    (ASSIGN, r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    (ACCESS, r"AKIA[A-Z0-9]{16,}", 0, 20),
    (HEX, r"[0-9a-f]{24,}", 0, 24),
)
#: Loose patterns, added where owner-specific. A cheap test first, then the expression.
LOOSE = (
    ("mixed", r"[A-Za-z0-9_-]{24}", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[a-z0-9_-]*[A-Z])(?=[A-Z0-9_-]*[a-z])[A-Za-z0-9_-]{24,}", 0, 24),
    ("pem", r"-----BEGIN ", r"-----BEGIN [A-Z ]*PRIVATE KEY-----\s*([A-Za-z0-9+/=]{16,})", 1, 16),
    ("address", r"://[^\s/]+@", r"[a-z][a-z0-9+.-]*://[^\s:/@]+:([^\s:/@]+)@", 1, 4),
)
#: Owners, and repositories, from which a value counts as a copied example.
SHARED_OWNERS = 3
REDACTED = "[redacted]"

_SPAN = "array<struct<start:bigint,ord:int,kind:string,end:bigint,value:string>>"


def _spans(text: Column, order: int, kind: str, test: str | None, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches of one pattern with their code point places; short values are dropped."""
    whole = f"(?s)\\G(.*?)({pattern})"  # \\G: after the last match the rest is searched once, not from each place
    gaps, hits = (F.regexp_extract_all(text, F.lit(whole), F.lit(k)) for k in (1, 2))
    values = F.regexp_extract_all(text, F.lit(whole), F.lit(2 + group))
    found = F.arrays_zip(gaps.alias("g"), hits.alias("m"), values.alias("v"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc, x):
        lo = acc["at"] + F.length(x["g"])
        hi = lo + F.length(x["m"])
        span = F.struct(lo.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), hi.alias("end"), x["v"].alias("value"))
        return F.struct(hi.alias("at"), F.when(F.length(x["v"]) >= least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(test or pattern), F.aggregate(found, start, step)["out"]).otherwise(F.array().cast(_SPAN))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """Rows (_row, id_col, _owner, _repo, base, loose), one a document; kept in the shared folder."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col), text.alias("_t"), F.col(owner_col).cast("string").alias("_owner"), F.col(repo_col).cast("string").alias("_repo"))
    base = [_spans(F.col("_t"), i, k, None, p, g, n) for i, (k, p, g, n) in enumerate(BASE)]
    loose = [_spans(F.col("_t"), len(BASE) + i, k, t, p, g, n) for i, (k, t, p, g, n) in enumerate(LOOSE)]
    d = d.select(id_col, "_owner", "_repo", F.concat(*base).alias("base"), F.concat(*loose).alias("loose"))
    d = d.withColumn("loose", F.filter("loose", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))
    return durable(d.withColumn("_row", F.monotonically_increasing_id()))


def verdicts(cands: DataFrame, shared_owners: int = SHARED_OWNERS) -> DataFrame:
    """Rows (h, n_owners, n_repos, n_docs, shared): ownership of each candidate value over the corpus.

    A missing owner or repository counts as one of its own.
    """
    each = cands.where("size(base) + size(loose) > 0").select("_owner", "_repo", F.explode(F.array_distinct(F.transform(F.concat("base", "loose"), lambda s: F.xxhash64(s["value"])))).alias("h"))
    each = each.groupBy("h", "_owner", "_repo").agg(F.count("*").alias("k")).select("h", F.coalesce("_owner", F.lit("")).alias("o"), F.coalesce("_repo", F.lit("")).alias("r"), "k")
    got = each.groupBy("h").agg(F.countDistinct("o").alias("n_owners"), F.countDistinct("r").alias("n_repos"), F.sum("k").alias("n_docs"))
    return got.withColumn("shared", (F.col("n_owners") >= shared_owners) & (F.col("n_repos") >= shared_owners))


def _judged(cands: DataFrame, shared_owners: int) -> DataFrame:
    """Rows (_row, spans) for documents with candidates; spans carry their verdict."""
    known = durable(verdicts(cands, shared_owners))
    each = cands.where("size(base) + size(loose) > 0").select("_row", F.explode(F.concat("base", "loose")).alias("s"))
    each = each.select("_row", "s", F.xxhash64("s.value").alias("h")).join(known.select("h", "shared"), "h")
    span = F.struct("s.start", "s.ord", "s.kind", "s.end", "s.value", "shared")
    return each.where((F.col("s.ord") < len(BASE)) | ~F.col("shared")).groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "source", shared_owners: int = SHARED_OWNERS) -> DataFrame:
    """Rows (id_col, spans), one a document: array of (start, ord, kind, end, value, shared), by start and kind.

    A null or empty text has no spans; rows that repeat an id are scanned each for itself
    and count once each; an empty table gives no rows. Columns not named are not read.
    """
    cands = candidates(docs, id_col, text_col, owner_col, repo_col)
    out = cands.select("_row", id_col).join(_judged(cands, shared_owners), "_row", "left")
    none = F.array().cast("array<struct<start:bigint,ord:int,kind:string,end:bigint,value:string,shared:boolean>>")
    return out.select(id_col, F.coalesce("spans", none).alias("spans"))


def report(docs: DataFrame, **kw) -> DataFrame:
    """scan() as counts and digests."""
    found = scan(docs, **kw)
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    n = [F.size(F.filter("spans", _is(i))).cast("bigint").alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)]
    id_col = kw.get("id_col", "doc_id")
    live = F.size(F.filter("spans", lambda s: ~s["shared"])).cast("bigint").alias("n_live")
    return found.select(id_col, *n, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), live)


def _is(order: int):
    return lambda s: s["ord"] == order


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "source", length_col: str | None = "n_chars", shared_owners: int = SHARED_OWNERS) -> DataFrame:
    """docs, all rows and columns, with owner-specific values taken out of their texts.

    Every place of such a value in its document is replaced; values that many owners
    carry stay. A value of an assignment or address that is letters only may be a plain
    word, so it goes where it stands as a whole word. length_col, if given, follows the
    new text. What goes from a row depends on its text alone, so rows meet their values
    by id and text, and rows without an id are redacted as any other.
    """
    key = F.concat(F.md5(F.coalesce(F.col(text_col), F.lit(""))), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    row, gone_, new_ = (fresh(docs, n) for n in ("_row_key", "_gone", "_new"))
    docs_ = docs.withColumn(row, key)
    gone = scan(docs_, row, text_col, owner_col, repo_col, shared_owners).select(row, F.explode(F.filter("spans", lambda s: ~s["shared"])).alias("_s"))
    word = F.col("_s.kind").isin(ASSIGN, "address") & F.col("_s.value").rlike("^[A-Za-z]+$")
    gone = gone.groupBy(row).agg(F.array_sort(F.collect_set(F.struct("_s.value", word.alias("word"))), lambda a, b: F.length(b["value"]) - F.length(a["value"])).alias(gone_))
    whole = lambda v: F.concat(F.lit("(?<![A-Za-z0-9])"), v, F.lit("(?![A-Za-z0-9])"))
    new = F.aggregate(gone_, F.col(text_col), lambda t, v: F.when(v["word"], F.regexp_replace(t, whole(v["value"]), F.lit(REDACTED))).otherwise(F.replace(t, v["value"], F.lit(REDACTED))))
    out = docs_.join(gone, row, "left").withColumn(new_, F.when(F.col(gone_).isNull(), F.col(text_col)).otherwise(new))
    cols = [F.col(new_).alias(c) if c == text_col else F.when(F.col(gone_).isNull(), F.col(c)).otherwise(F.length(new_)).cast(docs.schema[c].dataType).alias(c) if c == length_col else F.col(c) for c in docs.columns]
    return out.select(*cols)


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


QUERIES = {"op5_secrets": op5_secrets}

def _listed(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    take = lambda k: f"unnest(regexp_extract_all(t, '(?s)(.*?)({quoted})', {k}))"
    return f"select doc_id, source, '{kind}' as kind, {order} as ord, {take(1)} as gap, {take(2)} as hit, {take(2 + group)} as val, unnest(range(0, len(regexp_extract_all(t, '{quoted}')))) as i, {least} as least from d"


#: The base kinds; the loose ones need looks to both sides of a match, which SQL's expressions lack.
ORACLE_SQL = {
    "op5_secrets": f"""with d as (select doc_id, source, coalesce(text, '') as t from documents),
m as ({' union all '.join(_listed(i, k, p.replace('(?i)(?:', '(?i:'), g, n) for i, (k, p, g, n) in enumerate(BASE))}),
s as (select *, sum(length(gap) + length(hit)) over (partition by doc_id, ord order by i) as fin from m),
k as (select doc_id, source, kind, ord, val, cast(fin - length(hit) as bigint) as st, cast(fin as bigint) as fin from s where length(val) >= least),
o as (select val, count(distinct coalesce(source, '')) as owners from k group by val), j as (select k.*, owners from k join o using (val)),
r as (select doc_id, count(*) filter (ord = 0) as n_assign, count(*) filter (ord = 1) as n_access, count(*) filter (ord = 2) as n_hex, string_agg(kind || ':' || st || ':' || fin, ',' order by st, ord) as spans, count(*) filter (owners < {SHARED_OWNERS}) as n_live from j group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live from documents left join r using (doc_id)"""
}
