"""Map-shaped views of the driver's tables, by integer arithmetic that Spark and SQL evaluate alike.

Each SQL text here is valid in both dialects; views with nested columns are built on top of
them with DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = {
    "places": "select c_custkey as id, cast((c_custkey * 7919) % 3600000 as double) / 1e4 - 180 as lon, cast((c_custkey * 104729) % 1600000 as double) / 1e4 - 80 as lat, c_mktsegment as kind, c_acctbal as weight from customer",
    "boxes": "select p_partkey as id, (p_partkey * 7919123) % 2000000000 as cx, (p_partkey * 104729321) % 2000000000 as cy, cast(p_size as bigint) * 100000 as dx, cast(p_size % 7 + 1 as bigint) * 50000 as dy, p_size % 10 + 5 as min_zoom, p_size % 10 + 11 as max_zoom, p_brand as brand, p_type as type from part",
    "vertices": "select l_orderkey as road_id, cast(l_linenumber as bigint) as i, min(l_partkey) * 1000 as x, min(l_suppkey % 40) * 1000 as y, min(l_quantity) as quantity from lineitem group by l_orderkey, l_linenumber",
    "moves": "select distinct l_orderkey % 97 as from_id, l_partkey % 89 as to_id from lineitem",
    "bans": "select distinct l_orderkey % 97 as from_id, l_partkey % 89 as to_id, cast(l_suppkey % 7 + 1 as int) as type from lineitem where l_linenumber = 3 and l_orderkey % 5 = 0",
    "segments": "select l_orderkey as route, cast(l_linenumber as bigint) as seq, min(l_partkey) % 3 as road_id, case when min(l_suppkey) % 3 = 0 then 'TL' when min(l_suppkey) % 3 = 1 then 'C' end as turn, cast(min(l_quantity) as bigint) as length from lineitem group by l_orderkey, l_linenumber",
    "points": "select user_id as trace, event_id as ind, cast((event_id * 37 + user_id) % 9000 as double) / 1e3 as lon, cast((event_id * 53 + user_id) % 7000 as double) / 1e3 as lat from events",
    "arcs": "select distinct l_partkey % 60 as a, l_suppkey % 60 as b, cast(l_partkey % 9 + 1 as bigint) as cost from lineitem where l_partkey % 60 <> l_suppkey % 60",
    "calls": "select l_orderkey % 40 as route, cast(l_linenumber as bigint) as seq, l_suppkey % 90 as stop, cast(min(l_orderkey) * 7 % 50 as bigint) + cast(l_linenumber as bigint) * 10 as due from lineitem group by l_orderkey % 40, l_linenumber, l_suppkey % 90",
}
TABLES = {"places": "customer", "boxes": "part", "vertices": "lineitem", "moves": "lineitem", "bans": "lineitem", "segments": "lineitem", "points": "events", "arcs": "lineitem", "calls": "lineitem"}


#: Rows of a table that a task takes where rows are put in order by a key.
ROWS_A_TASK = 1 << 19
_LINES = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines dealt by order over as many tasks as their number asks for, so that no task's memory grows with the table.

    Groups and windows by order are satisfied with that, so nothing is shuffled again.
    """
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-t.count() // ROWS_A_TASK))
    return t.select(*_LINES).repartition(n, "l_orderkey")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of SQL above over the tables in a folder; no temporary view is left behind."""
    if name in ("segments", "vertices"):
        return spark.sql(SQL[name].replace("from lineitem", "from {t}"), t=by_order(spark, sf_dir))
    return spark.sql(SQL[name].replace(f"from {TABLES[name]}", "from {t}"), t=spark.read.parquet(f"{sf_dir}/{TABLES[name]}.parquet"))


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of a small file that each cost much, over as many tasks as a shuffle has; as read, the file is one task's."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """boxes as features: three points and two tags each, and the source order 0."""
    b = view(spark, sf_dir, "boxes")
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    t = lambda k, v: F.struct(F.lit(k).alias("tag"), v.alias("value"))
    x, y, dx, dy = (F.col(c) for c in ("cx", "cy", "dx", "dy"))
    return b.withColumns({"points": F.array(p(x, y), p(x + dx, y), p(x + dx, y + dy)), "tags": F.array(t("brand", F.col("brand")), t("type", F.col("type"))), "file_ord": F.lit(0)})


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vertices as roads: (road_id, points), points in order."""
    v = view(spark, sf_dir, "vertices")
    p = F.array_sort(F.collect_list(F.struct("i", "x", "y")))
    return v.groupBy("road_id").agg(F.transform(p, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("points"))
