"""What the training-data operators share: tables, durable stages, components."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares: spark.checkpoint.dir, else, on a local master only, one of our own (tests)."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = sc.getCheckpointDir()
        if not root:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = os.path.join(tempfile.gettempdir(), f"meridian-{os.getpid()}")
            sc.setCheckpointDir(root)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows go to the shared checkpoint folder, so a lost executor costs a reread."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Like durable(), as compressed Parquet in the shared folder: for tables with texts in them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the plans, broadcasts and shuffle files of finished steps now, not when the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have: name, with as many underscores after it as that takes."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def signed(x: int) -> int:
    """An unsigned 64-bit number as Spark's long."""
    x &= MASK64
    return x - (1 << 64) if x >> 63 else x


def batches(frame, schema: str, fn) -> DataFrame:
    """mapInArrow, fn taking one RecordBatch and giving one or more (None: nothing)."""

    def run(it):
        for b in it:
            if b.num_rows:
                out = fn(b)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out

    return frame.mapInArrow(run, schema)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest vertex reachable from each vertex that has an edge: rows (node, component).

    Contraction: each vertex points to its smallest neighbour if that is smaller
    than itself, pointers are doubled until they stop, vertices of a tree become one
    and edges are rewritten between trees. A round at least halves the vertices that
    still have edges, so rounds grow with the logarithm of the vertices, whatever
    the longest path. Only joins and aggregations that combine before they shuffle
    are used; the one number per round that reaches the driver is a count.
    Empty input gives an empty result; loops and repeated edges are harmless. Rounds are
    kept as Parquet: a checkpoint would carry its plan's size estimate, a product over all
    joins before it, whose digits double every round and fill the driver.
    """
    keep = partial(stored, name="components")
    e = keep(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct())
    maps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")))
        while True:
            top = up.select(F.col("u").alias("p"), F.col("p").alias("g"))
            nxt = keep(up.join(top, "p").select("u", F.col("g").alias("p"), (F.col("g") != F.col("p")).alias("moved")))
            moved = not nxt.where("moved").isEmpty()
            up = nxt.select("u", "p")
            if not moved:
                break
        maps.append(up)
        pu, pv = up.select("u", F.col("p").alias("x")), up.select(F.col("u").alias("v"), F.col("p").alias("y"))
        e = keep(e.join(pu, "u").join(pv, "v").where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
    if not maps:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = maps[0].select(F.col("u").alias("node"), F.col("p").alias("component"))
    for m in maps[1:]:
        m = m.select(F.col("u").alias("component"), F.col("p").alias("to"))
        out = out.join(m, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return keep(out) if len(maps) > 1 else out
