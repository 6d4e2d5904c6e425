"""The size partition of benchmark decontamination: what each class reads, and that none loses a pair."""

import random
import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from quillgraph.llm import contamination  # noqa: E402


def prose(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def tables(spark):
    rng = random.Random(5)
    small, large = [prose(rng, rng.choice((6, 7))) for _ in range(150)], [prose(rng, rng.randint(260, 500)) for _ in range(40)]
    docs = [(k, prose(rng, 400)) for k in range(40)]
    docs += [(100 + k, f"{prose(rng, 50)} {x} {prose(rng, 3000)}") for k, x in enumerate(small[:20] + large[:20])]
    docs += [(200 + k, " ".join(x.split()[: len(x.split()) * 9 // 10]) + " " + prose(rng, 30)) for k, x in enumerate(large[20:])]
    items = list(enumerate(small + large))
    return docs, items


def test_large_items_read_fewer_shingles(spark):
    docs, items = tables(spark)
    rows = spark.createDataFrame(docs, "doc long, text string")
    sizes = {i: len(t.split()) - 4 for i, t in items}
    df = spark.createDataFrame(items, "item_id long, text string").select(F.col("item_id").alias("rep"), contamination.words(F.col("text")).alias("w"))
    df = spark.createDataFrame(df.collect(), df.schema)
    sets = df.select("rep", F.sort_array(F.array_distinct(contamination.windows(F.col("w"), 5, F.xxhash64))).alias("set")).withColumn("n", F.size("set"))
    need = F.ceil(F.col("n") * 0.8 - 1e-9).cast("int")
    signature = sets.select("rep", F.lit(5).alias("width"), F.floor(F.log2("n")).alias("part"), F.explode(F.slice("set", F.lit(1), F.col("n") - need + 1)).alias("h"))
    classes = {c.part: c for c in contamination.size_classes(signature)}
    assert set(classes) == {n.bit_length() - 1 for n in sizes.values()} and len(classes) > 1
    least, most = min(classes), max(classes)
    assert classes[most].ceiling < classes[least].ceiling
    split = rows.select(contamination.words(F.col("text")).alias("w"))
    hashes = [h for r in spark.createDataFrame(split.collect(), "w array<string>").select(contamination.windows(F.col("w"), 5, F.xxhash64).alias("h")).collect() for h in r["h"]]
    total, under = len(hashes), {c.part: sum(h <= c.ceiling for h in hashes) for c in classes.values()}
    read = {r["part"]: r["count"] for r in contamination.signatures(rows, list(classes.values())).groupBy("part").count().collect()}
    # the ceiling of a large class keeps about a third of a document, that of a small class nearly all
    assert under[most] < 0.45 * total and under[least] > 0.75 * total
    assert all(read[k] <= under[k] for k in read) and sum(read.values()) < 0.2 * total
    for k, c in classes.items():
        held = {r["h"] for r in signature.filter(F.col("part") == k).collect()}
        assert all(h <= c.ceiling and c.slots[h % contamination.SLOTS] for h in held)


def test_no_class_loses_a_pair(spark):
    docs, items = tables(spark)
    got = contamination.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in got.collect()}
    assert found == brute.contained(docs, items) and len(found) == 60


def test_a_common_line_in_many_items(spark):
    """A license line that all items and documents hold meets each candidate's document alone."""
    rng = random.Random(7)
    line = prose(rng, 12)
    items = [(k, f"{prose(rng, 4)} {line} {prose(rng, 4)}") for k in range(60)]
    docs = [(k, f"{prose(rng, 30)} {line} {items[k][1] if k < 20 else ''} {prose(rng, 30)}") for k in range(80)]
    got = contamination.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(k, k) for k in range(20)}
