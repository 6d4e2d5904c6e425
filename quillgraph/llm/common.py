"""What the training-data operators share: durable intermediate tables, Arrow
batch bounds, output columns, crc32 folds and connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch sent to Python: whole texts are kept, so a batch holds few rows.
ARROW_ROWS, ARROW_BYTES = 256, 32 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts may be very long. Spark reads these settings when
    a plan runs, so they stay set in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def give_back() -> None:
    """Return what a Python worker has freed to the system: an executor's workers stay
    and share its memory with the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names a shared folder in spark.checkpoint.dir. Only on one machine (as in
    tests) may it name none: a temporary one is used there, and elsewhere an error raised,
    since executors do not see each other's disks."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillgraph-checkpoint-"))


def durable(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, with its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared checkpoint folder, and read again."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def others(df: DataFrame, taken: list[str]) -> list[str]:
    """The columns of df that no result column replaces (names without case)."""
    low = {x.lower() for x in taken}
    return [c for c in df.columns if c.lower() not in low]


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def crc_fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


#: So many edges (16 bytes each) are few enough for one task.
FEW_EDGES = 1 << 20


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node that each reaches): roots hook onto smaller ones, and paths are halved."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while len(left := np.flatnonzero(root[x] != root[y])):
        x, y = x[left], y[left]
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while ((up := root[root]) != root).any():
            root = up
    return nodes, nodes[root]


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """Connected components of edges (a, b), both long and not null.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), each
    one aggregation and one join, until the edges no longer change or are at most
    `few`, which one task finishes. Returns (node, component): component is the
    smallest node reachable; only nodes with an edge to another node occur.
    Intermediate edges are checkpointed; nothing but a count and a checksum reaches
    the driver.
    """
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x[0].to_numpy(), x[1].to_numpy()) for x in batches]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in smallest_reachable(*(np.concatenate(x) for x in zip(*held, strict=True)))], ["node", "component"])

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large(e: DataFrame) -> DataFrame:
        e = both(e)
        least = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return e.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        e = both(e).filter("b < a")
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        return e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())

    def tidy(e: DataFrame) -> DataFrame:
        return e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = durable(tidy(edges))
    seen = state(now)
    while seen[0] > few:
        now = durable(tidy(small(tidy(large(now)))))
        if (then := state(now)) == seen:
            break
        seen = then
    if seen[0] <= few:
        return durable(now.coalesce(1).mapInArrow(finish, "node long, component long"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).distinct()
