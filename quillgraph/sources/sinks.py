"""Sinks: chat history, log files, selected archives. Tables are written beside the
old ones and put in their place, since Spark cannot overwrite what it reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import chat, logs
from quillgraph.sources.readers import CONVERSATIONS


def files(spark: SparkSession, path: str):
    """The file system of a path, and its paths by name."""
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def stands(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at path. A replacement that was cut short between its two
    renames is finished: the new table is whole by then."""
    fs, at = files(spark, path)
    if not fs.exists(at(path)) and fs.exists(at(f"{path}.old")) and fs.exists(at(f"{path}.new/_SUCCESS")):
        fs.rename(at(f"{path}.new"), at(path))
    return fs.exists(at(path))


def replaced(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """df in place of the table at path, from which it may be read. For a moment no table
    stands there; stands() finishes what a crash leaves then."""
    spark = df.sparkSession
    new, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").format(fmt).save(new)
    fs, at = files(spark, path)
    fs.delete(at(old), True)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(new), at(path))
    fs.delete(at(old), True)


def history_table(spark: SparkSession, path: str) -> DataFrame:
    """The stored conversations; none if nothing has been stored."""
    if not stands(spark, path):
        return spark.createDataFrame([], CONVERSATIONS)
    return spark.read.schema(CONVERSATIONS).parquet(path)


def store_conversations(spark: SparkSession, path: str, changes: DataFrame) -> None:
    """SK1."""
    replaced(chat.upserted(history_table(spark, path), changes), path)


def forget_conversations(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """SK2."""
    replaced(chat.deleted(history_table(spark, path), ids), path)


def append_log(entries: DataFrame, path: str, size: int = logs.BYTES) -> None:
    """SK3: the entries' lines, added to the log; once its files are over size, the last
    lines within its second half stay. Lines begin with their time, which orders them."""
    spark = entries.sparkSession
    stands(spark, path)
    logs.formatted(entries).select("line").write.mode("append").text(path)
    fs, at = files(spark, path)
    if fs.getContentSummary(at(path)).getLength() > size:
        lines = spark.read.text(path).select(F.col("value").alias("line"), F.lit(path).alias("log"))
        replaced(logs.rotated(lines, "line", by="log", size=size).select("line"), path, "text")


def dump_log(entries: DataFrame, path: str) -> None:
    """SK4: the entries' lines as text files at path, whose names and lines are in the order of the ids."""
    logs.dumped(entries).repartitionByRange("n").sortWithinPartitions("n").select("line").write.text(path)


def select_archives(spark: SparkSession, path: str, chosen: DataFrame) -> None:
    """SK6: one row for each uri, as JSON lines."""
    rows = chosen.groupBy("uri").agg(F.min_by(F.struct("name", "size"), "name").alias("x")).select("uri", "x.*")
    replaced(rows, path, "json")


def missing_only(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """SK8 as a set: what of the old listing the new one lacks."""
    return old.join(new.select(key).distinct(), key, "left_anti")
