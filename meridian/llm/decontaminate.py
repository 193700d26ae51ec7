"""Benchmark decontamination by template windows, in DataFrame operations only.

A text becomes a sequence of template tokens: case folded words, with names (capitalised
inside a sentence), numbers and units of measure replaced by typed placeholders. Windows
of WINDOW template tokens of the benchmark are hash-joined with those of every document.
Matches of one item at one offset of a document are aligned word by word; there the
values that fill the placeholders must map consistently (one value of the item always to
the same value of the document), which tells a question with new parameters from chance.
An item leaks into a document when consistent windows cover COVERAGE of the item's.

A window of fewer plain words than LEAST_WORDS is no evidence as a template and is matched
on its very words instead; such windows count where an item consists mostly of them (sums,
lists of names or figures), so that copies of these are found as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, table

WINDOW = 5
COVERAGE = 0.8
#: Words other than placeholders that a window needs to be matched as a template.
LEAST_WORDS = 2
#: Rows of benchmark windows, of about 130 bytes (26 MB in all), up to which that side is
#: broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 200_000

NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0003"
UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|miles?|feet|ft|inch(?:es)?|yards?|l|ml|lit(?:er|re)s?|gallons?|hours?|hrs?|min(?:ute)?s?|sec(?:ond)?s?|days?|weeks?|months?|years?|mph|kmh|dollars?|cents?|euros?|pounds?|percent|degrees?|watts?|volts?|kwh"


def marked(text: Column) -> Column:
    """Words parted by single spaces; a word that fills a placeholder starts with its mark."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x01-\\x03]", " ")
    t = F.regexp_replace(t, "(?<=[\\p{Ll}\\p{Nd},;:] )(?=\\p{Lu}\\p{Ll})", NAME)
    n = F.regexp_replace(t, "(?<=\\p{Nd})[.,:/](?=\\p{Nd})", "_")
    n = F.regexp_replace(n, "(?<![\\p{L}\\p{Nd}_\\x01])(?=\\p{Nd}[\\p{Nd}_]*(?![\\p{L}\\p{Nd}_]))", NUMBER)
    n = F.regexp_replace(n, f"(?i)(?<=\\p{{Nd}} )(?=(?:{UNITS})(?!\\p{{L}}))", UNIT)
    t = F.when(text.rlike("\\p{Nd}"), n).otherwise(t)
    return F.trim(F.regexp_replace(F.lower(t), "[^\\p{L}\\p{M}\\p{Nd}_\\x01-\\x03]+", " "))


def _is_slot(word: Column) -> Column:
    return F.ascii(word).between(1, 3)


def _coded(word: Column) -> Column:
    """A word as a long: odd for plain ones; of one that fills a placeholder the low three bits are the placeholder's."""
    h = F.xxhash64(word)
    slot = h.bitwiseAND(~7).bitwiseOR(F.shiftleft(F.ascii(word), 1).cast("long"))
    return F.when(word < "\u0004", F.when(word == "", h.bitwiseOR(1)).otherwise(slot)).otherwise(h.bitwiseOR(1))


def _plain(code: Column) -> Column:
    return code.bitwiseAND(1)


def _tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, words): the coded words, position by position; a text without words has one, which is empty."""
    return df.select(id_col, F.transform(F.split(marked(F.col(text_col)), " "), _coded).alias("words"))


def _windows(tokens: DataFrame, keep: list, lengths: list[int]) -> DataFrame:
    """One row a window: keep, n (its length), pos, weak, h, words (its own, so a row does not grow with its text).

    h is the hash of its template or, with few plain words, of the words themselves.
    Places are exploded and the rest is computed from the words' array in generated code,
    where a join that follows drops a window before its own words are made.
    """
    parts = []
    for n in lengths:
        starts = F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n)).otherwise(F.array().cast("array<int>"))
        placed = tokens.select(*keep, "words", F.explode(starts).alias("pos"))
        code = [F.get("words", F.col("pos") + k) for k in range(n)]
        n_plain = sum((_plain(c) for c in code[1:]), _plain(code[0]))
        weak = n_plain < min(LEAST_WORDS, n)
        template = F.xxhash64(*[F.when(_plain(c) == 1, c).otherwise(c.bitwiseAND(7)) for c in code])
        h = F.when(weak, F.xxhash64(F.lit("words"), *code)).otherwise(template)
        parts.append(placed.select(*keep, F.lit(n).alias("n"), "pos", weak.alias("weak"), h.alias("h"), F.slice("words", F.col("pos") + 1, n).alias("words")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """Rows (id_col, item_col, n_windows, n_matched, coverage, n_slots, n_changed, kind), one a leak.

    kind is 'exact' if no placeholder's value differs and 'reparameterised' otherwise;
    n_slots and n_changed count distinct values of the item in placeholders. An item of
    fewer words than a window is one window of all its words. Items and documents with
    null, empty or wordless texts leak nowhere, and documents without an id have no rows
    (without_leaks() judges them all the same); rows that repeat an id count as one; an
    empty table on either side gives no rows. Other columns are not read.
    """
    items = _tokens(benchmark.where(F.col(item_col).isNotNull() & (marked(F.col(item_text)) != "")), item_col, item_text).withColumnRenamed(item_col, "_item").dropDuplicates(["_item", "words"])
    lengths = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(window)).alias("n")).distinct().collect()) or [window]
    own = _windows(items.withColumn("size", F.size("words")), ["_item", "size"], lengths).where(F.col("n") == F.least("size", F.lit(window)))
    mostly = own.groupBy("_item").agg((2 * F.count_if("weak") > F.count("*")).alias("mostly_weak"))
    own = own.join(mostly, "_item").where("mostly_weak or not weak").select("_item", "n", "h", F.col("pos").alias("item_pos"), F.col("words").alias("item_words"))
    totals = own.groupBy("_item").agg(F.countDistinct("item_pos").alias("n_windows"))
    n_own = own.count()
    if n_own <= BROADCAST_ROWS:
        own, totals = F.broadcast(own), F.broadcast(totals)
    theirs = _windows(_tokens(docs.where(F.col(id_col).isNotNull()), id_col, text_col).withColumnRenamed(id_col, "_doc"), ["_doc"], lengths)
    met = theirs.join(own, ["n", "h"])
    pairs = F.zip_with("item_words", "words", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    slots = F.filter(pairs, lambda p: _plain(p["a"]) == 0)
    met = met.select("_doc", "_item", "item_pos", (F.col("pos") - F.col("item_pos")).alias("offset"), slots.alias("slots"))
    aligned = met.groupBy("_doc", "_item", "offset").agg(F.collect_set("item_pos").alias("at"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    consistent = F.size(F.array_distinct(F.transform("slots", lambda p: p["a"]))) == F.size("slots")
    whole = aligned.where(consistent).groupBy("_doc", "_item").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("at"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    found = whole.join(totals, "_item").withColumn("n_matched", F.size("at")).withColumn("coverage", F.col("n_matched") / F.col("n_windows")).where(F.col("coverage") >= coverage)
    changed = F.size(F.array_distinct(F.transform(F.filter("slots", lambda p: p["a"] != p["b"]), lambda p: p["a"])))
    n_slots = F.size(F.array_distinct(F.transform("slots", lambda p: p["a"])))
    found = found.select(F.col("_doc").alias(id_col), F.col("_item").alias(item_col), "n_windows", "n_matched", "coverage", n_slots.alias("n_slots"), changed.alias("n_changed"))
    return found.withColumn("kind", F.when(F.col("n_changed") == 0, "exact").otherwise("reparameterised"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents into which no item leaks, with all their columns.

    What leaks into a row depends on its text alone, so rows are told by a digest of their
    text: those without an id or with a repeated one go or stay as any other. An empty
    table on either side leaves the documents as they are.
    """
    key = fresh(docs, "_digest")
    keyed = docs.withColumn(key, F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    gone = leaks(keyed.select(key, text_col), benchmark, key, text_col, **kw).select(key).distinct()
    return keyed.join(gone, key, "left_anti").select(*docs.columns)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontaminate": op2_decontaminate}
