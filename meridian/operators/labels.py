"""Greedy placement of icons and labels, and road density, one tile a group."""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _corners(x: float, y: float, w: float, h: float, angle: float) -> list[tuple[float, float]]:
    c, s = math.cos(angle), math.sin(angle)
    return [(x + c * a - s * b, y + s * a + c * b) for a, b in ((-w / 2, -h / 2), (w / 2, -h / 2), (w / 2, h / 2), (-w / 2, h / 2))]


def boxes_hit(a: tuple, b: tuple) -> bool:
    """Whether two turned boxes (x, y, w, h, angle) overlap: none of their four side directions parts them."""
    if math.hypot(a[0] - b[0], a[1] - b[1]) > (math.hypot(a[2], a[3]) + math.hypot(b[2], b[3])) / 2:
        return False
    pa, pb = _corners(*a), _corners(*b)
    for angle in (a[4], a[4] + math.pi / 2, b[4], b[4] + math.pi / 2):
        c, s = math.cos(angle), math.sin(angle)
        u, v = [x * c + y * s for x, y in pa], [x * c + y * s for x, y in pb]
        if max(u) <= min(v) or max(v) <= min(u):
            return False
    return True


class Grid:
    """Placed boxes by cells of a size: only those near are tested."""

    def __init__(self, cell: float):
        self.cell, self.at = cell, {}

    def near(self, box: tuple):
        r = math.hypot(box[2], box[3]) / 2
        lo, hi = (int((box[0] - r) // self.cell), int((box[1] - r) // self.cell)), (int((box[0] + r) // self.cell), int((box[1] + r) // self.cell))
        seen = set()
        for i in range(lo[0], hi[0] + 1):
            for j in range(lo[1], hi[1] + 1):
                for k, b in self.at.get((i, j), ()):
                    if k not in seen:
                        seen.add(k)
                        yield b

    def add(self, number: int, box: tuple) -> None:
        r = math.hypot(box[2], box[3]) / 2
        for i in range(int((box[0] - r) // self.cell), int((box[0] + r) // self.cell) + 1):
            for j in range(int((box[1] - r) // self.cell), int((box[1] + r) // self.cell) + 1):
                self.at.setdefault((i, j), []).append((number, box))


def place(labels: DataFrame, apart: float = 0.0, shrink: float = 1.0) -> DataFrame:
    """Adds placed to labels (tile, id, ord, text, x, y, w, h, angle): in order, each unless it overlaps one placed before.

    A label whose text was placed within apart of it is left out too; shrink scales the
    boxes that are tested (icons may overlap at their margins). A null text never repeats.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "id"], kind="stable")
        grid, texts, out = Grid(64.0), {}, []
        for k, r in enumerate(pdf.itertuples()):
            box = (r.x, r.y, r.w * shrink, r.h * shrink, r.angle)
            same = texts.get(r.text, ()) if r.text is not None else ()
            ok = all(math.hypot(r.x - x, r.y - y) >= apart for x, y in same) and not any(boxes_hit(box, b) for b in grid.near(box))
            if ok:
                grid.add(k, box)
                if r.text is not None:
                    texts.setdefault(r.text, []).append((r.x, r.y))
            out.append(ok)
        return pdf.assign(placed=out)

    schema = "tile long, id long, ord int, text string, x double, y double, w double, h double, angle double"
    return labels.selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}" for c in schema.split(", ")]).groupBy("tile").applyInPandas(solve, schema + ", placed boolean")


def thin_out(lines: DataFrame, per_cell: int, cell: int) -> DataFrame:
    """Adds drawn to lines (tile, id, ord, points): from the highest ord down, each while a cell it passes has room.

    A line with an ord that a cell already holds is drawn there too, so roads of one class
    do not end at a cell's limit.
    """

    def run(it):
        tile, count, last = object(), {}, {}
        for b in it:
            out = []
            for t, rank, xs, ys in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if t != tile:
                    tile, count, last = t, {}, {}
                cells = {(x // cell, y // cell) for x, y in zip(xs or (), ys or (), strict=True)}
                ok = any(count.get(c, 0) < per_cell or (rank is not None and last.get(c) == rank) for c in cells)
                if ok:
                    for c in cells:
                        count[c] = count.get(c, 0) + 1
                        last[c] = rank
                out.append(ok)
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(out, pa.bool_())], names=["tile", "id", "ord", "drawn"])

    # lines come in order, so a task holds the counts of a tile's cells and one batch, not the tile
    xs, ys = (F.col("points")[c].alias(f"{c}s") for c in ("x", "y"))
    rows = lines.select(F.col("tile").cast("long").alias("tile"), F.col("id").cast("long").alias("id"), F.col("ord").cast("int").alias("ord"), xs, ys)
    rows = rows.repartition("tile").sortWithinPartitions("tile", F.desc_nulls_last("ord"), F.asc_nulls_last("id"))
    return rows.mapInArrow(run, "tile long, id long, ord int, drawn boolean")


def wrap(text: str, width: int) -> list[str]:
    """Lines of at most width characters, broken at blanks; a longer word stands alone."""
    out: list[str] = []
    for w in text.split():
        if out and len(out[-1]) + 1 + len(w) <= width:
            out[-1] += " " + w
        else:
            out.append(w)
    return out


def combine_lines(lines: list[list[tuple]], gap: float = 45.0, longest: float = 550.0) -> list[list[tuple]]:
    """Lines of one name joined end to start while they go on in the same direction, the nearest pair first.

    A pair is joined if its gap is small, neither turns back, and the result stays short.
    """
    out = [list(p) for p in lines if len(p) > 1]
    size = lambda p: sum(math.dist(a, b) for a, b in zip(p, p[1:]))
    while True:
        pairs = []
        for i, a in enumerate(out):
            for j, b in enumerate(out):
                if i == j:
                    continue
                d = math.dist(a[-1], b[0])
                u, v = (a[-1][0] - a[-2][0], a[-1][1] - a[-2][1]), (b[1][0] - b[0][0], b[1][1] - b[0][1])
                if d <= gap and u[0] * v[0] + u[1] * v[1] > 0 and size(a) + d + size(b) <= longest:
                    pairs.append((d, i, j))
        if not pairs:
            return out
        _, i, j = min(pairs)
        joined = out[i] + (out[j][1:] if out[i][-1] == out[j][0] else out[j])
        out = [p for k, p in enumerate(out) if k not in (i, j)] + [joined]


def combine_names(lines: DataFrame, gap: float = 45.0, longest: float = 550.0) -> DataFrame:
    """Rows (tile, text, part, points) of lines (tile, text, id, points): one name of one tile a group."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        got = combine_lines([[(p["x"], p["y"]) for p in r] for r in pdf.points], gap, longest)
        rows = [(pdf.tile.iloc[0], pdf.text.iloc[0], k, [{"x": float(x), "y": float(y)} for x, y in p]) for k, p in enumerate(got)]
        return pd.DataFrame(rows, columns=["tile", "text", "part", "points"])

    return lines.select("tile", "text", "id", "points").groupBy("tile", "text").applyInPandas(solve, "tile long, text string, part int, points array<struct<x:double,y:double>>")


def along_path(points: list[tuple], sizes: list[float], start: float) -> list[tuple[float, float, float]] | None:
    """(x, y, angle) for glyphs of given widths set along a path from start; None if the path is too short."""
    out, at, k, done = [], start, 0, 0.0
    legs = list(zip(points, points[1:]))
    for w in sizes:
        mid = at + w / 2
        while k < len(legs) and done + math.dist(*legs[k]) < mid:
            done += math.dist(*legs[k])
            k += 1
        if k == len(legs):
            return None
        (ax, ay), (bx, by) = legs[k]
        t = (mid - done) / math.dist(*legs[k])
        out.append((ax + t * (bx - ax), ay + t * (by - ay), math.atan2(by - ay, bx - ax)))
        at += w
    return out
