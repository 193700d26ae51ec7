"""Shortest paths, over edges (a, b, cost) of any size or over one small network a query.

one_to_all relaxes a frontier with joins until nothing gets cheaper: only rows that
improved go on, and each round is cut loose as a table in the shared checkpoint folder.
per_query runs a heap search inside a group, for many queries over extracted subgraphs.
"""

from __future__ import annotations

import heapq
import os
import tempfile
import uuid
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Checkpointed rows from which joins merge them: as packed files they look small enough to send to the driver.
MERGED_FROM = 200_000


def checkpointed(df: DataFrame) -> DataFrame:
    """A round's rows, as Parquet in spark.checkpoint.dir; in a folder of our own where none is set, on a local master only.

    Not checkpoint(), which keeps its plan's size estimate: a product over all joins before
    it, whose digits double every round and fill the driver.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = os.path.join(tempfile.gettempdir(), f"meridian-{os.getpid()}")
    path = f"{root.rstrip('/')}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out.hint("merge") if out.count() >= MERGED_FROM else out


def one_to_all(edges: DataFrame, starts: DataFrame, limit: float | None = None, most_rounds: int | None = None) -> DataFrame:
    """Rows (source, node, cost, hops): the least cost from each start (source, node) to every node in reach.

    edges: (a, b, cost), costs at least 0, rows repeated at will. Ties in cost go to fewer
    hops. limit leaves out what is farther; most_rounds bounds the hops of a path, else rounds
    go on until no cost improves.
    """
    e = edges.groupBy("a", "b").agg(F.min("cost").alias("cost"))
    best = checkpointed(starts.select("source", "node").distinct().withColumn("cost", F.lit(0).cast(e.schema["cost"].dataType)).withColumn("hops", F.lit(0)))
    front = best
    for _ in count() if most_rounds is None else range(most_rounds):
        new = front.withColumnRenamed("cost", "_c").join(e, F.col("node") == F.col("a")).select("source", F.col("b").alias("node"), (F.col("_c") + F.col("cost")).alias("cost"), (F.col("hops") + 1).alias("hops"))
        if limit is not None:
            new = new.where(F.col("cost") <= limit)
        new = new.groupBy("source", "node").agg(F.min(F.struct("cost", "hops")).alias("n")).select("source", "node", "n.*")
        old = best.select("source", "node", F.col("cost").alias("_oc"), F.col("hops").alias("_oh"))
        better = F.col("_oc").isNull() | (F.col("cost") < F.col("_oc")) | ((F.col("cost") == F.col("_oc")) & (F.col("hops") < F.col("_oh")))
        front = checkpointed(new.join(old, ["source", "node"], "left").where(better).select("source", "node", "cost", "hops"))
        if front.isEmpty():
            return best
        best = checkpointed(best.join(front.select("source", "node"), ["source", "node"], "left_anti").unionByName(front))
    return best


def within_hops(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """Least cost of a path of at most so many edges: rows (source, node, cost)."""
    return one_to_all(edges, starts, most_rounds=hops).select("source", "node", "cost")


def shortest(edges: list[tuple], start, end, heuristic=None) -> tuple[float, list] | None:
    """Cost and nodes of a least path by a heap search (A* with a heuristic that never overestimates); None if there is none."""
    out: dict = {}
    for a, b, c in edges:
        out.setdefault(a, []).append((b, c))
    h = heuristic or (lambda n: 0.0)
    cost, came = {start: 0.0}, {}
    heap = [(h(start), 0, start)]
    done, ticket = set(), 0
    while heap:
        _, _, n = heapq.heappop(heap)
        if n in done:
            continue
        if n == end:
            path = [n]
            while n in came:
                n = came[n]
                path.append(n)
            return cost[end], path[::-1]
        done.add(n)
        for m, c in out.get(n, ()):
            d = cost[n] + c
            if d < cost.get(m, float("inf")):
                cost[m], came[m] = d, n
                ticket += 1
                heapq.heappush(heap, (d + h(m), ticket, m))
    return None


def per_query(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (query, cost, path) for queries (query, start, end) over edges (query, a, b, cost): one small network a query.

    A query without a path has a null cost. Networks are groups of their own; large ones
    belong to one_to_all.
    """

    def solve(key: tuple, q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        rows = []
        arcs = list(zip(e.a, e.b, e.cost))
        for s, t in zip(q.start, q.end):
            got = shortest(arcs, s, t)
            rows.append((key[0], got[0] if got else None, [int(v) for v in got[1]] if got else []))
        return pd.DataFrame(rows, columns=["query", "cost", "path"])

    return queries.groupBy("query").cogroup(edges.groupBy("query")).applyInPandas(solve, "query long, cost double, path array<long>")


def transit_rounds(calls: DataFrame, starts: DataFrame, changes: int, change_time: int = 0) -> DataFrame:
    """Earliest arrivals by public transport: rows (source, stop, at, boardings).

    calls: (route, seq, stop, at), one timetabled run a route; starts: (source, stop, at). A
    round boards every run that calls at a reached stop not before the arrival (plus
    change_time after the first ride) and rides it on; changes + 1 rounds at most.
    """
    best = checkpointed(starts.select("source", "stop", F.col("at").cast("long").alias("at"), F.lit(0).alias("boardings")))
    front = best
    on = calls.select("route", "seq", "stop", F.col("at").alias("dep"))
    off = calls.select("route", F.col("seq").alias("_s"), F.col("stop").alias("to"), F.col("at").alias("arr"))
    for k in range(changes + 1):
        wait = change_time if k else 0
        board = front.join(on, "stop").where(F.col("dep") >= F.col("at") + wait).groupBy("source", "route").agg(F.min("seq").alias("seq"))
        ride = board.join(off, "route").where(F.col("_s") > F.col("seq")).groupBy("source", F.col("to").alias("stop")).agg(F.min("arr").alias("at"))
        old = best.select("source", "stop", F.col("at").alias("_old"))
        front = checkpointed(ride.join(old, ["source", "stop"], "left").where("_old is null or at < _old").select("source", "stop", "at", F.lit(k + 1).alias("boardings")))
        if front.isEmpty():
            break
        best = checkpointed(best.join(front.select("source", "stop"), ["source", "stop"], "left_anti").unionByName(front))
    return best
