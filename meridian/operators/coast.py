"""Coastlines to water and land polygons, tile by tile.

Lines (water on their right, as drawn) are cut at the tile, joined end to start, and what
is still open is closed along the tile's edge, clockwise. Clockwise rings are water.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from .geometry import clip_line


def signed_area(ring: list[tuple]) -> float:
    """Twice the area; above 0 for a ring that runs clockwise on a map whose y grows south."""
    return sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]))


def chain(lines: list[list[tuple]]) -> tuple[list[list[tuple]], list[list[tuple]]]:
    """(closed rings, open chains) of lines joined where one ends and another starts."""
    by_start: dict[tuple, list[int]] = {}
    for i, line in enumerate(lines):
        by_start.setdefault(line[0], []).append(i)
    ends = {line[-1] for line in lines}
    used = [False] * len(lines)
    rings, chains = [], []
    # chains from starts that no line ends at first, then what is left are rings
    order = sorted(range(len(lines)), key=lambda i: (lines[i][0] in ends, i))
    for i in order:
        if used[i]:
            continue
        used[i] = True
        path = list(lines[i])
        while path[0] != path[-1]:
            nxt = next((j for j in by_start.get(path[-1], ()) if not used[j]), None)
            if nxt is None:
                break
            used[nxt] = True
            path += lines[nxt][1:]
        (rings if path[0] == path[-1] and len(path) > 3 else chains).append(path)
    return rings, chains


def _along(p: tuple, box: tuple) -> float | None:
    """Place on the box's edge, clockwise from the upper left corner in sides (0 to 4); None off the edge."""
    x0, y0, x1, y1 = box
    x, y = p
    if y == y0 and x0 <= x <= x1:
        return (x - x0) / (x1 - x0)
    if x == x1 and y0 <= y <= y1:
        return 1 + (y - y0) / (y1 - y0)
    if y == y1 and x0 <= x <= x1:
        return 2 + (x1 - x) / (x1 - x0)
    if x == x0 and y0 <= y <= y1:
        return 3 + (y1 - y) / (y1 - y0)
    return None


def close(chains: list[list[tuple]], box: tuple) -> tuple[list[list[tuple]], list[list[tuple]]]:
    """(rings, what cannot be closed): chains from edge to edge, each end led clockwise to the next start."""
    x0, y0, x1, y1 = box
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    good = [c for c in chains if _along(c[0], box) is not None and _along(c[-1], box) is not None]
    bad = [c for c in chains if c not in good]
    starts = {i: _along(c[0], box) for i, c in enumerate(good)}
    left, rings = set(starts), []
    while left:
        first = min(left)
        left.discard(first)
        ring, now = list(good[first]), first
        while True:
            at = _along(ring[-1], box)
            steps = {i: (s - at) % 4 for i, s in starts.items() if i in left or i == first}
            nxt = min(steps, key=lambda i: (steps[i] == 0 and i != first, steps[i]))
            way = steps[nxt] or (4.0 if nxt == now else 0.0)
            ring += [corners[int(k) % 4] for k in range(int(at) + 1, 9) if k < at + way]
            if nxt == first:
                break
            left.discard(nxt)
            ring += good[nxt]
            now = nxt
        rings.append([p for k, p in enumerate(ring) if k == 0 or p != ring[k - 1]])
    return rings, bad


def polygons(lines: list[list[tuple]], box: tuple) -> list[tuple[str, list[tuple]]]:
    """('water' or 'land', ring) of a tile. Islands alone stand in water: then the whole tile is water first."""
    pieces = [p for line in lines for p in clip_line(line, box)]
    rings, open_ = chain(pieces)
    closed, _ = close(open_, box)
    out = [("water" if signed_area(r) > 0 else "land", r) for r in rings + closed]
    if rings and not closed and not any(k == "water" for k, _ in out):
        x0, y0, x1, y1 = box
        out.insert(0, ("water", [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]))
    return out


def water(lines: DataFrame, zoom: int) -> DataFrame:
    """Rows (tx, ty, kind, ring) from lines (tx, ty, id, points): the tile each line was dealt to, its points in 31 bit."""
    size = 1 << (31 - zoom)

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tx, ty = key
        box = (tx * size, ty * size, (tx + 1) * size - 1, (ty + 1) * size - 1)
        ways = [[(p["x"], p["y"]) for p in r] for _, r in pdf.sort_values("id")[["id", "points"]].itertuples(index=False)]
        rows = [(tx, ty, kind, [{"x": int(x), "y": int(y)} for x, y in ring]) for kind, ring in polygons([w for w in ways if len(w) > 1], box)]
        return pd.DataFrame(rows, columns=["tx", "ty", "kind", "ring"])

    return lines.select("tx", "ty", "id", "points").groupBy("tx", "ty").applyInPandas(build, "tx long, ty long, kind string, ring array<struct<x:long,y:long>>")
