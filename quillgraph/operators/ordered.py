"""Running sums over a whole ordered table without a single task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.storage import durable


def running_sums(df: DataFrame, order: list[Column | str], values: dict[str, Column]) -> DataFrame:
    """df with a column for each of values: its sum over all rows up to this one, in order (nulls count as 0).

    Rows are dealt by ranges of order; each range sums its own rows, and a second pass adds what
    the ranges before it sum to: a row for each range. Only rows equal in order share a
    range for sure; among them the sums follow no stated order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = df.withColumns({k: F.coalesce(v.cast("long"), F.lit(0).cast("long")) for k, v in values.items()})
    dealt = durable(own.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(*(F.sum(k).alias(k) for k in values))  # n rows at most
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_range", *(F.coalesce(F.sum(k).over(earlier), F.lit(0).cast("long")).alias(f"_before_{k}") for k in values))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.select(*(c for c in dealt.columns if c not in values), *(F.sum(k).over(within).alias(k) for k in values)).join(F.broadcast(before), "_range")
    return summed.withColumns({k: F.col(k) + F.col(f"_before_{k}") for k in values}).drop("_range", *(f"_before_{k}" for k in values))


def running_sum(df: DataFrame, order: list[Column | str], value: Column, name: str) -> DataFrame:
    return running_sums(df, order, {name: value})


def running_sum_by(df: DataFrame, by: str, order: list[Column | str], value: Column, name: str) -> DataFrame:
    """The running sum of each group apart. A group, however large, lies in as many ranges as it
    needs: its sums are those of the whole table less what stands before its first row."""
    every = running_sums(df.withColumn("_own", F.coalesce(value.cast("long"), F.lit(0).cast("long"))), [by, *order], {name: F.col("_own"), "_n": F.lit(1)})
    starts = every.groupBy(F.col(by).alias("_by")).agg(F.min(F.struct("_n", (F.col(name) - F.col("_own")).alias("start"))).alias("_first"))
    return every.join(starts, F.col(by).eqNullSafe(F.col("_by"))).withColumn(name, F.col(name) - F.col("_first.start")).drop("_by", "_first", "_own", "_n")
