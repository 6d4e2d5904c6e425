"""Titles in order, written once in blocks, and ranges of them by their beginnings.

A block is a row: so many consecutive titles in arrays. A table of the blocks' first titles,
of FIRSTS rows at most whatever the number of titles, tells by binary search where a prefix begins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.operators.index import PREFIXED
from quillgraph.operators.ordered import running_sum

#: Titles of a block at least, and blocks at most.
BLOCK, FIRSTS = 256, 50_000


def build(articles: DataFrame, path: str, *, block: int = BLOCK) -> None:
    """Write the titles (title, path) of articles to path, an unused folder that all executors see. Null titles are left out."""
    named = articles.select(F.lower("title").alias("key"), "title", "path").filter("title is not null")
    size = max(block, -(-named.count() // FIRSTS))
    numbered = running_sum(named, ["key", "title", "path"], F.lit(1), "n")
    held = numbered.groupBy(F.floor((F.col("n") - 1) / size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("key", "title", "path"))).alias("titles"))
    held.repartitionByRange("block").sortWithinPartitions("block").select("block", F.col("titles")[0]["key"].alias("first"), "titles").write.parquet(path)


def by_prefix(spark: SparkSession, path: str, probes: DataFrame, limit: int, *, prefix_col: str = "prefix") -> DataFrame:
    """SC8, SO9: probes with the first `limit` titles (title, path) that begin with the prefix whatever the case, by
    lower-cased title, then title, then path; score 800. A null prefix has none; an empty one has the first of all.

    A prefix reads the block in which it would stand and as many after it as the limit needs."""
    held = spark.read.parquet(path)
    firsts = [r["first"] for r in held.select("block", "first").orderBy("block").collect()]  # FIRSTS at most
    if not firsts:
        return probes.select("*", F.lit("").alias("title"), F.lit("").alias("path"), F.lit(PREFIXED).alias("score")).limit(0)
    keys = np.array([x.encode() for x in firsts], object)
    size = held.select(F.size("titles")).orderBy("block").head()[0]

    @F.pandas_udf("long")
    def place(prefix: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(0, np.searchsorted(keys, np.array([x.encode() for x in prefix], object)) - 1))

    asked = probes.select(F.lower(prefix_col).alias("_p")).filter("_p is not null").distinct().withColumn("_b", place("_p"))
    reach = -(-limit // size) + 1
    wanted = asked.select("_p", F.explode(F.sequence(F.col("_b"), F.col("_b") + reach - 1)).alias("block"))
    found = held.join(wanted, "block").select("_p", F.slice(F.filter("titles", lambda t: t["key"].startswith(F.col("_p"))), 1, limit).alias("t"))
    each = found.select("_p", F.explode("t").alias("t"))
    first = each.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("t"))).filter(F.col("_r") <= limit)
    return probes.withColumn("_p", F.lower(prefix_col)).join(first, "_p").select(*probes.columns, "t.title", "t.path", F.lit(PREFIXED).alias("score"))
