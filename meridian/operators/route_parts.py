"""Transport routes whose parts come from several sources: put together in rounds until no two parts of a route share a stop.

In a round the parts at each stop are matched two by two, a part keeps one match that both
sides like best, and matched parts become one. So rounds grow with the logarithm of a route's
parts, not with the number of routes, and no route is one task's; parts that meet no other
leave the rounds. Ends that a source lacks (missing stops) are then joined with missing ends near by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import checkpointed


def segments(parts: DataFrame) -> DataFrame:
    """parts (route, part, stops (id, x, y)) cut behind missing stops (ids below 1): rows (route, piece, stops), those of one stop left out."""
    p = parts.select("route", "part", F.posexplode("stops").alias("k", "s"))
    w = W.partitionBy("route", "part").orderBy("k")
    gone = F.col("s.id") < 1
    p = p.withColumn("_had", F.sum(F.when(gone, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    # of missing stops in a row the first ends a piece and the second begins one, but at the start of a part the first begins it
    nth = F.sum(F.when(gone, 1).otherwise(0)).over(W.partitionBy("route", "part", "_had").orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    p = p.withColumn("_ends", F.when(gone & ((nth + F.when(F.col("_had") == 0, 1).otherwise(0)) % 2 == 1), 1).otherwise(0))
    cut = F.coalesce(F.sum("_ends").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    got = p.withColumn("_c", cut).groupBy("route", "part", "_c").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("_s"))
    got = got.where(F.size("_s") > 1).select("route", "part", "_c", F.transform("_s", lambda v: v["s"]).alias("stops"))
    return got.withColumn("piece", F.row_number().over(W.partitionBy("route").orderBy("part", "_c")).cast("long")).select("route", "piece", "stops")


def merged_at_stop(a: Column, b: Column) -> Column:
    """Two lists of stops put together at the first stop of a that b has too: the longer beginning and the longer end, a's of equals unless it is missing."""
    ids = F.transform(b, lambda s: s["id"])
    i = F.array_position(F.transform(a, lambda s: (s["id"] > 0) & F.array_contains(ids, s["id"])), True).cast("int") - 1
    j = F.array_position(ids, F.get(a, i)["id"]).cast("int") - 1
    rest_a, rest_b = F.size(a) - i, F.size(b) - j
    end = F.when((rest_a < rest_b) | ((rest_a == rest_b) & (F.element_at(a, -1)["id"] < 1)), F.slice(b, j + 1, rest_b)).otherwise(F.slice(a, i + 1, rest_a))
    start = F.when((i < j) | ((i == j) & (a[0]["id"] < 1)), F.slice(b, F.lit(1), j)).otherwise(F.slice(a, F.lit(1), i))
    return F.concat(start, end)


def merged_at_gap(a: Column, b: Column) -> Column:
    """a's end and b's beginning, both missing, left out, and the rest in order."""
    return F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(b, F.lit(2), F.size(b) - 1))


def _round(pieces: DataFrame, open_: DataFrame, edges: DataFrame, merge, k: int) -> tuple[DataFrame, DataFrame]:
    """(pieces that are done, the others after one round of matching). open_: (route, piece), those that may still meet another; edges: (route, a, b), pieces that may become one, a's stops first.

    An edge is taken if both its pieces like it best, so every route with edges gets one shorter at least.
    """
    e = edges.distinct().withColumn("_e", F.struct(F.xxhash64("route", "a", "b", F.lit(k)).alias("h"), "a", "b"))
    e = e.select("route", "_e", F.explode(F.array("a", "b")).alias("piece"))
    best = e.groupBy("route", "piece").agg(F.min("_e").alias("_e")).select("route", "_e.a", "_e.b")
    pair = checkpointed(best.groupBy("route", "a", "b").count().where("count = 2").select("route", "a", "b"))
    tag = open_.select("route", "piece", F.lit(None).cast("long").alias("a")).union(pair.select("route", F.col("a").alias("piece"), "a")).union(pair.select("route", "b", "a"))
    tag = tag.groupBy("route", "piece").agg(F.max("a").alias("a"), F.lit(True).alias("_open"))
    marked = checkpointed(pieces.join(tag, ["route", "piece"], "left"))
    one = marked.where("a = piece").select("route", "a", F.col("stops").alias("_a"))
    two = marked.where("a <> piece").select("route", "a", F.col("stops").alias("_b"))
    new = one.join(two, ["route", "a"]).select("route", F.col("a").alias("piece"), merge(F.col("_a"), F.col("_b")).alias("stops"))
    cols = ("route", "piece", "stops")
    return marked.where("_open is null").select(*cols), checkpointed(marked.where("_open and a is null").select(*cols).unionByName(new))


def join_parts(parts: DataFrame, reach: int) -> DataFrame:
    """Rows (route, piece, stops): parts (route, part, stops) of all sources put together; what shares no stop and has no missing end within reach of another stays apart.

    Repeated parts and stops of overlapping parts are there once. A part of one stop is left
    out. Merging adds no stops or ends to a route, so a piece that meets no other now never
    will, and is left out of the rounds that follow.
    """
    pieces, k, done = checkpointed(segments(parts)), 0, []
    while True:
        ids = F.array_distinct(F.transform(F.filter("stops", lambda s: s["id"] > 0), lambda s: s["id"]))
        stops = pieces.select("route", "piece", F.explode(ids).alias("id"))
        shared = checkpointed(stops.withColumn("_n", F.count("*").over(W.partitionBy("route", "id"))).where("_n > 1").drop("_n"))
        if shared.isEmpty():
            break
        # at each stop the first goes with the second, the third with the fourth
        order = W.partitionBy("route", "id").orderBy(F.xxhash64("piece", F.lit(k)), "piece")
        two = shared.withColumns({"_n": F.row_number().over(order), "b": F.lead("piece").over(order)}).where("_n % 2 = 1 and b is not null")
        (out, pieces), k = _round(pieces, shared.select("route", "piece"), two.select("route", F.col("piece").alias("a"), "b"), merged_at_stop, k), k + 1
        done.append(out)
    for out in done:
        pieces = pieces.unionByName(out)
    done = []
    while True:
        last, first = F.element_at("stops", -1), F.col("stops")[0]
        cell = lambda v: F.floor(v / reach)
        ends = pieces.select("route", "piece", last.alias("s")).where("s.id < 1").withColumns({"cx": cell(F.col("s.x")), "cy": cell(F.col("s.y"))})
        begins = pieces.select("route", F.col("piece").alias("b"), first.alias("t")).where("t.id < 1")
        around = F.explode(F.array(*[F.struct((cell(F.col("t.x")) + i).alias("cx"), (cell(F.col("t.y")) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("c")
        far = F.sqrt(F.pow((F.col("s.x") - F.col("t.x")).cast("double"), F.lit(2)) + F.pow((F.col("s.y") - F.col("t.y")).cast("double"), F.lit(2)))
        near = ends.join(begins.select("route", "b", "t", around).select("route", "b", "t", "c.cx", "c.cy"), ["route", "cx", "cy"]).where((F.col("piece") != F.col("b")) & (far < reach))
        near = checkpointed(near.select("route", "piece", "b", far.alias("d")))
        if near.isEmpty():
            for out in done:
                pieces = pieces.unionByName(out)
            return pieces
        # each end takes its nearest beginning, each beginning the nearest end of those
        best = near.groupBy("route", "piece").agg(F.min(F.struct("d", "b")).alias("m")).groupBy("route", F.col("m.b").alias("b")).agg(F.min(F.struct("m.d", "piece")).alias("m"))
        link = best.select("route", F.col("m.piece").alias("a"), "b")
        (out, pieces), k = _round(pieces, near.select("route", "piece").union(near.select("route", "b")), link, merged_at_gap, k), k + 1
        done.append(out)
