"""Two-level routing: an overlay of border points between tiles, built once and searched many times.

build() cuts the network into tiles; a node with an arc into another tile is a border
point, and inside each tile the least costs between its border points become overlay arcs
(one tile a group). A query then needs its two end tiles in detail and the overlay between.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import one_to_all


def _reach(arcs: dict, start, inside: set | None = None) -> dict:
    cost, heap, done = {start: 0.0}, [(0.0, start)], set()
    while heap:
        c, n = heapq.heappop(heap)
        if n in done:
            continue
        done.add(n)
        for m, d in arcs.get(n, ()):
            if (inside is None or m in inside) and c + d < cost.get(m, float("inf")):
                cost[m] = c + d
                heapq.heappush(heap, (c + d, m))
    return cost


def _per_tile(key: tuple, nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    arcs: dict = {}
    for a, b, c in zip(edges.a, edges.b, edges.cost):
        arcs.setdefault(a, []).append((b, c))
    ends = set(nodes.node)
    rows = []
    for s in sorted(ends):
        rows += [(s, t, c) for t, c in _reach(arcs, s).items() if t in ends and t != s]
    return pd.DataFrame(rows, columns=["a", "b", "cost"]).astype({"a": "int64", "b": "int64", "cost": "float64"})


def build(edges: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, arcs) of the overlay. edges: (a, b, cost); cells: (node, cell), one a node.

    points: (node, cell); arcs: (a, b, cost), inside tiles and between them. The least cost
    between two border points over the overlay is that over the whole network.
    """
    e = edges.join(cells.toDF("a", "ca"), "a").join(cells.toDF("b", "cb"), "b")
    over = e.where("ca <> cb")
    points = over.select(F.col("a").alias("node"), F.col("ca").alias("cell")).union(over.select("b", "cb")).distinct()
    inner = e.where("ca = cb").select("a", "b", "cost", F.col("ca").alias("cell"))
    short = points.groupBy("cell").cogroup(inner.groupBy("cell")).applyInPandas(_per_tile, "a long, b long, cost double")
    return points, short.unionByName(over.select("a", "b", F.col("cost").cast("double").alias("cost")))


def route(queries: DataFrame, edges: DataFrame, cells: DataFrame, points: DataFrame, arcs: DataFrame) -> DataFrame:
    """Rows (query, cost) of least costs for queries (query, start, end); queries without a way are left out.

    Both end tiles are searched in detail, the overlay in rounds of joins. A route inside
    one tile may leave it and come back, so both ways are compared.
    """
    at = lambda c, n: queries.select("query", F.col(c).alias("node")).join(cells, "node").select("query", "node", F.col("cell").alias(n))
    e = edges.join(cells.toDF("a", "ca"), "a").join(cells.toDF("b", "cb"), "b").where("ca = cb").select("a", "b", F.col("cost").cast("double").alias("cost"), F.col("ca").alias("cell"))

    def local(side: str, turn: bool) -> DataFrame:
        q = at(side, "cell")
        net = e.select(F.col("b").alias("a"), F.col("a").alias("b"), "cost", "cell") if turn else e

        def solve(key: tuple, qs: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
            g: dict = {}
            for a, b, c in zip(es.a, es.b, es.cost):
                g.setdefault(a, []).append((b, c))
            rows = [(k, n, c) for k, s in zip(qs["query"], qs.node) for n, c in _reach(g, s).items()]
            return pd.DataFrame(rows, columns=["query", "node", "cost"]).astype({"query": "int64", "node": "int64", "cost": "float64"})

        return q.groupBy("cell").cogroup(net.groupBy("cell")).applyInPandas(solve, "query long, node long, cost double")

    first, last = local("start", False), local("end", True)
    inside = first.join(queries.select("query", F.col("end").alias("node")), ["query", "node"]).select("query", "cost")
    border = points.select("node")
    out = first.join(border, "node")
    seeds = out.select(F.col("query").alias("source"), "node", "cost")
    # the way to each seed is an arc from a node of the query's own, numbered below all others
    own = -F.col("source") - 1
    starts = seeds.select("source", own.alias("node")).distinct()
    net = arcs.unionByName(seeds.select(own.alias("a"), F.col("node").alias("b"), "cost"))
    best = one_to_all(net, starts).select(F.col("source").alias("query"), "node", F.col("cost").alias("c1"))
    over = best.join(last.withColumnRenamed("cost", "c2"), ["query", "node"]).select("query", (F.col("c1") + F.col("c2")).alias("cost"))
    return inside.unionByName(over).groupBy("query").agg(F.min("cost").alias("cost"))


def alternatives(costs: list[tuple[float, list]], share: float = 0.7, most: int = 3) -> list[tuple[float, list]]:
    """Routes by cost of which none shares that part of its places with one taken before."""
    out: list[tuple[float, list]] = []
    for c, path in sorted(costs, key=lambda t: t[0]):
        if all(len(set(path) & set(p)) < share * len(set(path)) for _, p in out):
            out.append((c, path))
        if len(out) == most:
            break
    return out


def choose_network(candidates: DataFrame, box: tuple[int, int, int, int], profile: str, params: list[str]) -> DataFrame:
    """The one group (edition, params) of networks of a profile that meets a box best: more asked parameters, fewer others, larger overlap, later edition."""
    l, t, r, b = box
    meet = (F.col("right") >= l) & (F.col("left") <= r) & (F.col("bottom") >= t) & (F.col("top") <= b)
    area = (F.least("right", F.lit(r)) - F.greatest("left", F.lit(l))).cast("double") * (F.least("bottom", F.lit(b)) - F.greatest("top", F.lit(t)))
    want = F.array(*map(F.lit, params)) if params else F.array().cast("array<string>")
    g = candidates.where(meet & (F.col("profile") == profile)).groupBy("edition", "params").agg(F.sum(area).alias("area"), F.collect_list("file").alias("files"))
    g = g.withColumns({"hit": F.size(F.array_intersect("params", want)), "extra": F.size(F.array_except("params", want))})
    return g.orderBy(F.desc("hit"), "extra", F.desc("area"), F.desc("edition")).limit(1)
