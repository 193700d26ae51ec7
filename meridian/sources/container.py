"""A compact container of map features, as a Spark data source ("meridian_container").

A file is a sequence of fields (varint tag, length, bytes). Blocks of features follow a
header; each block starts with its own box, zoom range and size, so a reader passes over
the blocks a query's box and zoom rule out. Inside a block ids are relative to a base,
points are zigzag deltas, tags and values are numbers into the block's string table.
Fields that a reader does not know are passed over.

    df.write.format("meridian_container").save(folder)     one file a partition
    spark.read.format("meridian_container").option("box", "l,t,r,b").option("zoom", 12).load(folder)
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "id long, file_ord int, min_zoom int, max_zoom int, area boolean, points array<struct<x:long,y:long>>, tags array<struct<tag:string,value:string>>"
VERSION = 1
BLOCK_FEATURES = 512
_HEADER, _BLOCK = 1, 2
_BOX, _ZOOMS, _BASE, _STRINGS, _FEATURE = 1, 2, 3, 4, 5
_ID, _POINTS, _TAGS, _AREA, _LEVELS = 1, 2, 3, 4, 5


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def unzigzag(n: int) -> int:
    return n >> 1 ^ -(n & 1)


def field(number: int, data: bytes) -> bytes:
    return varint(number) + varint(len(data)) + data


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            return n, at


def fields(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(data):
        number, at = read_varint(data, at)
        size, at = read_varint(data, at)
        yield number, data[at : at + size]
        at += size


def numbers(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        n, at = read_varint(data, at)
        out.append(n)
    return out


def pack(ns) -> bytes:
    return b"".join(map(varint, ns))


def encode_block(rows: list) -> bytes:
    """One block of features that have points."""
    xs = [p[0] for r in rows for p in r["points"]]
    ys = [p[1] for r in rows for p in r["points"]]
    base = min(r["id"] for r in rows)
    strings: dict[str, int] = {}
    body = b""
    x = y = 0
    for r in rows:
        deltas = []
        for px, py in r["points"]:
            deltas += [zigzag(px - x), zigzag(py - y)]
            x, y = px, py
        tags = [strings.setdefault(s, len(strings)) for kv in r["tags"] for s in kv]
        body += field(_FEATURE, field(_ID, varint(r["id"] - base)) + field(_LEVELS, pack((r["min_zoom"], r["max_zoom"]))) + field(_POINTS, pack(deltas)) + field(_TAGS, pack(tags)) + (field(_AREA, b"\1") if r["area"] else b""))
    table = b"".join(field(1, s.encode()) for s in strings)
    head = field(_BOX, pack((min(xs), min(ys), max(xs), max(ys)))) + field(_ZOOMS, pack((min(r["min_zoom"] for r in rows), max(r["max_zoom"] for r in rows)))) + field(_BASE, varint(zigzag(base)))
    return head + field(_STRINGS, table) + body


def decode_block(data: bytes, box=None, zoom: int | None = None) -> Iterator[dict]:
    """Features of a block that touch the box and have the zoom; nothing past the head is read if the block is ruled out."""
    base, strings = 0, []
    x = y = 0
    for number, v in fields(data):
        if number == _BOX and box:
            l, t, r, b = numbers(v)
            if r < box[0] or l > box[2] or b < box[1] or t > box[3]:
                return
        elif number == _ZOOMS and zoom is not None:
            lo, hi = numbers(v)
            if not lo <= zoom <= hi:
                return
        elif number == _BASE:
            base = unzigzag(read_varint(v, 0)[0])
        elif number == _STRINGS:
            strings = [s.decode() for _, s in fields(v)]
        elif number == _FEATURE:
            row = {"id": base, "area": False, "points": [], "tags": [], "min_zoom": 0, "max_zoom": 0}
            for k, w in fields(v):
                if k == _ID:
                    row["id"] = base + read_varint(w, 0)[0]
                elif k == _POINTS:
                    d = numbers(w)
                    for i in range(0, len(d), 2):
                        x, y = x + unzigzag(d[i]), y + unzigzag(d[i + 1])
                        row["points"].append((x, y))
                elif k == _TAGS:
                    n = numbers(w)
                    row["tags"] = [(strings[a], strings[b]) for a, b in zip(n[::2], n[1::2])]
                elif k == _AREA:
                    row["area"] = True
                elif k == _LEVELS:
                    row["min_zoom"], row["max_zoom"] = numbers(w)
            xs, ys = [p[0] for p in row["points"]], [p[1] for p in row["points"]]
            if box and (max(xs) < box[0] or min(xs) > box[2] or max(ys) < box[1] or min(ys) > box[3]):
                continue
            if zoom is None or row["min_zoom"] <= zoom <= row["max_zoom"]:
                yield row


@dataclass
class _File(InputPartition):
    path: str
    order: int


@dataclass
class _Wrote(WriterCommitMessage):
    path: str


def _name(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = _name(options["path"])
        self.box = tuple(int(v) for v in options["box"].split(",")) if options.get("box") else None
        self.zoom = int(options["zoom"]) if options.get("zoom") else None

    def partitions(self):
        names = sorted(n for n in os.listdir(self.path) if n.endswith(".mrd")) if os.path.isdir(self.path) else [""]
        return [_File(os.path.join(self.path, n) if n else self.path, k) for k, n in enumerate(names)]

    def read(self, part: _File):
        with open(part.path, "rb") as f:
            data = f.read()
        for number, v in fields(data):
            if number == _HEADER and read_varint(v, 0)[0] != VERSION:
                raise ValueError(f"{part.path}: version {read_varint(v, 0)[0]}, not {VERSION}")
            if number == _BLOCK:
                for r in decode_block(v, self.box, self.zoom):
                    yield (r["id"], part.order, r["min_zoom"], r["max_zoom"], r["area"], r["points"], r["tags"])


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.run = _name(options["path"]), overwrite, uuid.uuid4().hex

    def write(self, rows) -> _Wrote:
        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f"{self.run}-{uuid.uuid4().hex}.tmp")
        with open(name, "wb") as f:
            f.write(field(_HEADER, varint(VERSION)))
            block: list[dict] = []
            for r in rows:
                if r.points:
                    block.append({"id": r.id, "min_zoom": r.min_zoom, "max_zoom": r.max_zoom, "area": r.area, "points": [(p.x, p.y) for p in r.points], "tags": [(t.tag, t.value) for t in r.tags or ()]})
                if len(block) == BLOCK_FEATURES:
                    f.write(field(_BLOCK, encode_block(block)))
                    block = []
            if block:
                f.write(field(_BLOCK, encode_block(block)))
        return _Wrote(name)

    def commit(self, messages) -> None:
        kept = {m.path for m in messages if m}
        for n in os.listdir(self.path):
            full = os.path.join(self.path, n)
            if full in kept:
                os.rename(full, full.removesuffix(".tmp") + ".mrd")
            elif self.run in n or (self.overwrite and n.endswith(".mrd")):
                os.remove(full)

    def abort(self, messages) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class ContainerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "meridian_container"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def load(spark, path: str, box=None, zoom: int | None = None):
    """The features of container files at a path that only Spark has to reach: files are read by Spark and decoded where they are.

    A file is one row here, so it must fit a task; the data source above reads shared folders.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    kinds = pa.schema([("id", pa.int64()), ("min_zoom", pa.int32()), ("max_zoom", pa.int32()), ("area", pa.bool_()), ("points", pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())]))), ("tags", pa.list_(pa.struct([("tag", pa.string()), ("value", pa.string())])))])

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                for number, v in fields(data):
                    if number == _BLOCK:
                        rows = list(decode_block(v, box, zoom))
                        if rows:
                            yield pa.RecordBatch.from_pylist([r | {"points": [{"x": x, "y": y} for x, y in r["points"]], "tags": [{"tag": t, "value": w} for t, w in r["tags"]]} for r in rows], schema=kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mrd").load(path).select(F.col("content"))
    return files.mapInArrow(run, SCHEMA.replace("file_ord int, ", ""))


def register(spark) -> None:
    spark.dataSource.register(ContainerSource)
