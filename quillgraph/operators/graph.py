"""Walks over the typed link graph: edges (src_path, prop, text, dst_path, ord)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import href_title, normalised_query
from quillgraph.functions.vocab import Profile
from quillgraph.operators.index import only
from quillgraph.operators.storage import durable


def bounded_walk(seeds: DataFrame, edges: DataFrame, *, properties: DataFrame | None = None, max_nodes: int = 12, max_depth: int = 5, q_col: str = "q_id") -> DataFrame:
    """GR1: (q_col, path, depth, via_prop, via_label, from_path, ord): breadth-first
    walks from the seed path of every question at once.

    Level by level, each a join of the frontier with the edges. A path counts once
    for a question, from its first discoverer; the seed is left out. A level is cut
    in (parent, property, link) order once max_nodes are reached. properties:
    (q_col, prop, prop_ord) allowed for each question; none: all. A frontier never
    holds more than max_nodes paths for a question, so state stays small; the edges
    are read once for each level and, for a frontier of few paths, not shuffled. Levels are checkpointed: a later one does not
    compute the earlier ones again, and an empty one ends the walk.
    """
    links = edges.select(F.col("src_path").alias("from_path"), F.col("prop").alias("via_prop"), F.col("text").alias("via_label"), F.col("dst_path").alias("path"), F.col("ord").alias("_link"))
    start = seeds.filter(F.trim(F.coalesce("path", F.lit(""))) != "").select(q_col, "path")
    front = start.withColumn("_parent", F.lit(0))
    known = start.withColumn("ord", F.lit(0)).withColumn("depth", F.lit(0)).withColumn("via_prop", F.lit(None).cast("string")).withColumn("via_label", F.lit(None).cast("string")).withColumn("from_path", F.lit(None).cast("string"))
    for depth in range(1, max_depth + 1):
        step = front.select(q_col, F.col("path").alias("from_path"), "_parent").join(only(links, front, "from_path", "path"), "from_path")
        if properties is not None:
            step = step.join(properties.select(q_col, F.col("prop").alias("via_prop"), F.col("prop_ord").alias("_prop")), [q_col, "via_prop"])
        else:
            step = step.withColumn("_prop", F.lit(0))
        order = F.struct("_parent", "_prop", "_link")
        found = step.groupBy(q_col, "path").agg(F.min_by(F.struct("from_path", "via_prop", "via_label"), order).alias("_x"), F.min(order).alias("_o"))
        new = found.join(known.select(q_col, "path"), [q_col, "path"], "left_anti")
        have = known.groupBy(q_col).agg((F.count("*") - 1).alias("_have"), F.max("ord").alias("_last"))
        ranked = new.join(have, q_col).withColumn("_r", F.row_number().over(Window.partitionBy(q_col).orderBy("_o"))).filter(F.col("_have") + F.col("_r") <= max_nodes)
        level = ranked.select(q_col, "path", (F.col("_last") + F.col("_r")).alias("ord"), F.lit(depth).alias("depth"), "_x.via_prop", "_x.via_label", "_x.from_path")
        level = durable(level)
        if level.isEmpty():
            break
        known = known.unionByName(level)
        front = level.select(q_col, "path", F.col("ord").alias("_parent"))
    return known.filter("depth > 0").select(q_col, "path", "depth", "via_prop", "via_label", "from_path", "ord")


def walk_hits(walked: DataFrame, seeds: DataFrame, profile: Profile, q_col: str = "q_id") -> DataFrame:
    """GR2: candidates of a walk: the seed at its own score, then walked paths at
    900 - depth, each with a note on where it was found. seeds: (q_col, path, title, score)."""
    label = F.col("via_prop")
    for prop, name in profile.property_labels:
        label = F.when(F.col("via_prop") == prop, F.lit(f"{prop} ({name})")).otherwise(label)
    say = profile.strings
    tag = F.concat(F.lit(say["by"] + " "), label, F.lit(f" {say['from']} «"), href_title(F.col("from_path")), F.lit("»"))
    title = F.when(F.trim(F.coalesce("via_label", F.lit(""))) != "", F.col("via_label")).otherwise(href_title(F.col("path")))
    far = walked.select(q_col, "ord", title.alias("title"), "path", F.lit("").alias("snippet"), (900 - F.col("depth")).cast("int").alias("score"), tag.alias("source_tag"))
    near = seeds.select(q_col, F.lit(0).alias("ord"), "title", "path", F.lit("").alias("snippet"), F.col("score").cast("int").alias("score"), F.lit(None).cast("string").alias("source_tag"))
    return near.unionByName(far)


def predecessor_chain(starts: DataFrame, successor_of: DataFrame, *, steps: int = 3, q_col: str = "q_id") -> DataFrame:
    """GR3: (q_col, step, name): from each start name on to the name before it, steps
    times at most; a missing, blank or repeated name ends the chain.

    successor_of: (name_key, before): what the best hit's card names as predecessor,
    by normalised name. Each step is one equi-join."""
    key = lambda c: normalised_query(F.col(c))
    now = starts.select(q_col, F.col("name"), F.array(key("name")).alias("_seen"))
    out = now.select(q_col, F.lit(0).alias("step"), "name")
    pairs = successor_of.select(F.col("name_key").alias("_k"), F.trim(F.substring_index(F.substring_index("before", "(", 1), "[", 1)).alias("_next"))
    for step in range(1, steps + 1):
        moved = now.withColumn("_k", key("name")).join(pairs, "_k").filter((F.col("_next") != "") & ~F.array_contains("_seen", normalised_query(F.col("_next"))))
        now = moved.select(q_col, F.col("_next").alias("name"), F.array_append("_seen", normalised_query(F.col("_next"))).alias("_seen"))
        out = out.unionByName(now.select(q_col, F.lit(step).alias("step"), "name"))
    return out
