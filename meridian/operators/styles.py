"""Rule lists compiled to columns, and drawing order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _matches(cond: dict[str, str]) -> Column:
    out = F.lit(True)
    for name, value in cond.items():
        c = F.col(name)
        out = out & (c.like(value) if "%" in value else c == value)
    return out


def first_match(rules: list[tuple[dict[str, str], object]], default) -> Column:
    """The output of the first rule whose column conditions all hold (a value with % is a pattern)."""
    out = None
    for cond, value in rules:
        out = F.when(_matches(cond), value) if out is None else out.when(_matches(cond), value)
    return F.lit(default) if out is None else out.otherwise(default)


def positions(rows: DataFrame, order: str = "ord", tie: str = "id", out: str = "position") -> DataFrame:
    """Numbers rows 1, 2, ... in drawing order without gathering them: counts per order value, then ranks inside.

    Rows of one order value are numbered in range partitions whose sizes are summed first.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, order, tie).withColumn("_part", F.spark_partition_id())
    w = W.partitionBy("_part").orderBy(order, tie)
    local = dealt.withColumn("_k", F.row_number().over(w))
    # the bounds of a range partition are drawn anew if it is planned again, so it is kept
    from .graph import checkpointed

    local = checkpointed(local)
    sizes = local.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_b")
    return local.join(before, "_part").withColumn(out, F.col("_k") + F.col("_b")).drop("_part", "_k", "_b")
