"""Clipping, simplification and vector tiles, one geometry or one tile at a time."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXTENT = 4096
LAYER = "map"
POINT, LINE, POLYGON = 1, 2, 3


def clip_line(points: list[tuple], box: tuple) -> list[list[tuple]]:
    """The pieces of a polyline inside a box, by parameter intervals of each leg (Liang-Barsky)."""
    x0, y0, x1, y1 = box
    out: list[list[tuple]] = []
    for (ax, ay), (bx, by) in zip(points, points[1:]):
        dx, dy = bx - ax, by - ay
        lo, hi = 0.0, 1.0
        for d, low, high, a in ((dx, x0, x1, ax), (dy, y0, y1, ay)):
            if d == 0:
                if not low <= a <= high:
                    lo = 2.0
                continue
            s, t = (low - a) / d, (high - a) / d
            lo, hi = max(lo, min(s, t)), min(hi, max(s, t))
        if lo > hi:
            continue
        p = (ax, ay) if lo == 0 else (round(ax + lo * dx), round(ay + lo * dy))
        q = (bx, by) if hi == 1 else (round(ax + hi * dx), round(ay + hi * dy))
        if out and out[-1][-1] == p:
            if q != p:
                out[-1].append(q)
        else:
            out.append([p] if p == q else [p, q])
    return [piece for piece in out if len(piece) > 1]


def clip_ring(points: list[tuple], box: tuple) -> list[tuple]:
    """A ring cut by the four sides of a box in turn; empty if nothing is left."""
    x0, y0, x1, y1 = box
    ring = points[:-1] if len(points) > 1 and points[0] == points[-1] else list(points)
    for axis, limit, keep_low in ((1, y1, True), (0, x1, True), (1, y0, False), (0, x0, False)):
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            pin, qin = ((v[axis] <= limit) if keep_low else (v[axis] >= limit) for v in (p, q))
            if pin:
                out.append(p)
            if pin != qin:
                k = (limit - p[axis]) / (q[axis] - p[axis])
                cut = [round(p[0] + k * (q[0] - p[0])), round(p[1] + k * (q[1] - p[1]))]
                cut[axis] = limit
                out.append(tuple(cut))
        ring = [p for i, p in enumerate(out) if i == 0 or p != out[i - 1]]
        if len(ring) > 1 and ring[0] == ring[-1]:
            ring.pop()
        if len(ring) < 3:
            return []
    return ring


def simplify(points: list[tuple], tolerance: float) -> list[tuple]:
    """Points of a line that matter at a tolerance: between two kept points none is farther off (no recursion)."""
    if len(points) < 3:
        return list(points)
    keep = {0, len(points) - 1}
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        (ax, ay), (bx, by) = points[a], points[b]
        dx, dy = bx - ax, by - ay
        long2 = dx * dx + dy * dy
        worst, at = tolerance, None
        for i in range(a + 1, b):
            px, py = points[i][0] - ax, points[i][1] - ay
            t = max(0.0, min(1.0, (px * dx + py * dy) / long2)) if long2 else 0.0
            d = ((px - t * dx) ** 2 + (py - t * dy) ** 2) ** 0.5
            if d > worst:
                worst, at = d, i
        if at is not None:
            keep.add(at)
            stack += [(a, at), (at, b)]
    return [points[i] for i in sorted(keep)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def _commands(kind: int, parts: list[list[tuple]]) -> bytes:
    out, x, y = [], 0, 0
    for part in parts:
        out.append(1 | 1 << 3)
        for k, (px, py) in enumerate(part):
            if k == 1:
                out.append(2 | (len(part) - 1) << 3)
            out += [_zigzag(px - x), _zigzag(py - y)]
            x, y = px, py
        if kind == POLYGON:
            out.append(7 | 1 << 3)
    return b"".join(map(_varint, out))


def encode_tile(features: list[tuple[int, int, list[list[tuple]], dict[str, str]]], layer: str = LAYER) -> bytes:
    """A vector tile of one layer. features: (id, kind, parts in tile units, properties)."""
    keys: dict[str, int] = {}
    values: dict[str, int] = {}
    body = b""
    for fid, kind, parts, props in features:
        tags = []
        for k, v in sorted(props.items()):
            tags += [keys.setdefault(k, len(keys)), values.setdefault(v, len(values))]
        f = _varint(1 << 3) + _varint(fid) + _field(2, b"".join(map(_varint, tags))) + _varint(3 << 3) + _varint(kind) + _field(4, _commands(kind, parts))
        body += _field(2, f)
    head = _varint(15 << 3) + _varint(2) + _field(1, layer.encode())
    tail = b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, _field(1, v.encode())) for v in values) + _varint(5 << 3) + _varint(EXTENT)
    return _field(3, head + body + tail)


def _fields(data: bytes):
    at = 0

    def number():
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        tag = number()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, number()
        elif wire == 2:
            n = number()
            yield tag >> 3, data[at : at + n]
            at += n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            yield tag >> 3, struct.unpack("<d" if wire == 1 else "<f", data[at : at + n])[0]
            at += n
        else:
            raise ValueError(f"wire type {wire}")


def _numbers(data: bytes) -> list[int]:
    out, n, shift = [], 0, 0
    for b in data:
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(n)
            n = shift = 0
    return out


def decode_tile(data: bytes) -> list[tuple[int, int, list[list[tuple]], dict[str, str]]]:
    """The features of a tile's layers, as encode_tile takes them."""
    out = []
    for number, layer in _fields(data):
        if number != 3:
            continue
        keys, values, raw = [], [], []
        for k, v in _fields(layer):
            if k == 2:
                raw.append(v)
            elif k == 3:
                keys.append(v.decode())
            elif k == 4:
                values.append(next((x.decode() if isinstance(x, bytes) else x for _, x in _fields(v)), ""))
        for f in raw:
            fid, kind, tags, cmds = 0, 0, [], []
            for k, v in _fields(f):
                if k == 1:
                    fid = v
                elif k == 2:
                    tags = _numbers(v)
                elif k == 3:
                    kind = v
                elif k == 4:
                    cmds = _numbers(v)
            parts, x, y, at = [], 0, 0, 0
            while at < len(cmds):
                op, n = cmds[at] & 7, cmds[at] >> 3
                at += 1
                if op == 7:
                    continue
                for _ in range(n):
                    dx, dy = (c >> 1 ^ -(c & 1) for c in cmds[at : at + 2])
                    at += 2
                    x, y = x + dx, y + dy
                    if op == 1:
                        parts.append([])
                    parts[-1].append((x, y))
            out.append((fid, kind, parts, {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2])}))
    return out


def tiles(features: DataFrame, zoom: int, buffer: float = 0.5) -> DataFrame:
    """Rows (tx, ty, n_features, tile): a vector tile for each tile of a zoom that a feature touches.

    features: id, points (31 bit), area (boolean), tags. Geometry is cut at the tile and
    half a tile around it and scaled to EXTENT; what vanishes is left out.
    """
    shift = 31 - zoom
    reach = int(buffer * (1 << shift))
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    last = (1 << zoom) - 1
    lo = lambda c: F.greatest(F.lit(0), F.shiftright(F.array_min(c) - reach, shift))
    hi = lambda c: F.least(F.lit(last), F.shiftright(F.array_max(c) + reach, shift))
    dealt = features.where("size(points) > 0").withColumn("tx", F.explode(F.sequence(lo(xs), hi(xs)))).withColumn("ty", F.explode(F.sequence(lo(ys), hi(ys))))

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tx, ty = (k.as_py() for k in key)
        size = 1 << shift
        box = (-int(buffer * EXTENT), -int(buffer * EXTENT), EXTENT + int(buffer * EXTENT), EXTENT + int(buffer * EXTENT))
        rows = []
        for r in sorted(table.to_pylist(), key=lambda r: r["id"]):
            pts = [((p["x"] - tx * size) * EXTENT // size, (p["y"] - ty * size) * EXTENT // size) for p in r["points"]]
            if len(pts) == 1:
                kind, parts = POINT, [pts] if box[0] <= pts[0][0] <= box[2] and box[1] <= pts[0][1] <= box[3] else []
            elif r["area"]:
                ring = clip_ring(pts, box)
                kind, parts = POLYGON, [ring] if ring else []
            else:
                kind, parts = LINE, clip_line(pts, box)
            if parts:
                rows.append((r["id"], kind, parts, {t["tag"]: t["value"] for t in r["tags"] or ()}))
        return pa.table({"tx": pa.array([tx] if rows else [], pa.int64()), "ty": pa.array([ty] if rows else [], pa.int64()), "n_features": pa.array([len(rows)] if rows else [], pa.int64()), "tile": pa.array([encode_tile(rows)] if rows else [], pa.binary())})

    return dealt.select("tx", "ty", "id", "points", "area", "tags").groupBy("tx", "ty").applyInArrow(build, "tx long, ty long, n_features long, tile binary")


def project_on(points: list[tuple], p: tuple) -> tuple[int, tuple, float]:
    """(leg, point on it, distance) of the place of a line nearest to p; the first of equals."""
    best = None
    for i, ((ax, ay), (bx, by)) in enumerate(zip(points, points[1:])):
        dx, dy = bx - ax, by - ay
        n = dx * dx + dy * dy
        t = max(0.0, min(1.0, ((p[0] - ax) * dx + (p[1] - ay) * dy) / n)) if n else 0.0
        q = (ax + t * dx, ay + t * dy)
        d = ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5
        if best is None or d < best[2]:
            best = (i, q, d)
    return best


def with_endpoint(points: list[tuple], p: tuple) -> tuple[list[tuple], int]:
    """A road's points with the place nearest to p among them, and its place; no point is doubled."""
    i, q, _ = project_on(points, p)
    q = (round(q[0]), round(q[1]))
    if q == points[i]:
        return list(points), i
    if q == points[i + 1]:
        return list(points), i + 1
    return points[: i + 1] + [q] + points[i + 1 :], i + 1


def inside(ring: list[tuple], p: tuple) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > p[1]) != (by > p[1]) and p[0] < ax + (p[1] - ay) * (bx - ax) / (by - ay):
            odd = not odd
    return odd


def _properly_cross(a, b, c, d) -> bool:
    o = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return o(a, b, c) * o(a, b, d) < 0 and o(c, d, a) * o(c, d, b) < 0


def sees(ring: list[tuple], a: tuple, b: tuple) -> bool:
    """Whether one can go straight from a to b inside an area."""
    if any(_properly_cross(a, b, p, q) for p, q in zip(ring, ring[1:] + ring[:1])):
        return False
    return all(inside(ring, (a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t)) for t in (0.25, 0.5, 0.75))


def across_area(ring: list[tuple], path: list[tuple]) -> list[tuple]:
    """A way round an area's edge shortened to straight lines inside it: from each point to the last that it sees."""
    out, k = [path[0]], 0
    while k < len(path) - 1:
        k = next((j for j in range(len(path) - 1, k + 1, -1) if sees(ring, path[k], path[j])), k + 1)
        out.append(path[k])
    return out


def slice_between(ways: list[list[tuple]], start: tuple, end: tuple) -> list[tuple]:
    """The geometry of a ride from one stop to another: the way's part between the places nearest to both.

    On one way its slice; over two the end of the first and the start of the second; if no
    way comes near in this order, the straight line.
    """
    near = lambda p: min(((project_on(w, p)[2], k, project_on(w, p)[0]) for k, w in enumerate(ways) if len(w) > 1), default=None)
    a, b = near(start), near(end)
    if not a or not b or (b[1], b[2]) < (a[1], a[2]):
        return [start, end]
    if a[1] == b[1]:
        return ways[a[1]][a[2] : b[2] + 2]
    out = ways[a[1]][a[2] :]
    for k in range(a[1] + 1, b[1]):
        out = out + ways[k]
    return out + ways[b[1]][: b[2] + 2]
