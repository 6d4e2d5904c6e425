"""Line dedup: lines that many documents hold stay in one of them only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import bounded_batches, durable, others, quoted

STRIPPED = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit key of a line without outer white space, A-Z lower-cased; None if
    it has fewer than min_chars code points."""
    line = line.strip(STRIPPED)
    if len(line) < min_chars or len(line) < 4 * min_chars and sum((b & 0xC0) != 0x80 for b in line) < min_chars:
        return None
    return xxhash.xxh3_128_digest(line.lower())


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(key, doc, mark, at): each distinct key of a row's text and its lines' positions.
    mark tells rows of one id and unlike texts apart."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, marks, places = [], [], [], []
            for i, m, t in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2].cast(pa.binary()).to_pylist(), strict=True):
                own: dict[bytes, list[int]] = {}
                for at, line in enumerate(t.split(b"\n")):
                    if (key := line_key(line, min_chars)) is not None:
                        own.setdefault(key, []).append(at)
                keys += own
                places += own.values()
                ids += [i] * len(own)
                marks += [m] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(places, pa.list_(pa.int32()))], ["key", "doc", "mark", "at"])

    text = quoted(text_col).cast("string")
    rows = docs.select(quoted(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text")).filter("doc is not null and text is not null")
    return rows.mapInArrow(explode, "key binary, doc long, mark long, at array<int>")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with text_col rid of lines common to min_docs documents or more.

    A text is split at \\n. A line's key is the line without outer ASCII white
    space, A-Z lower-cased; keys under min_chars code points never count. All
    lines of a common key go, except in the largest id that holds it. Adds n_lines
    (before) and n_dropped; these and text_col replace input columns so named,
    any other column stays.

    Null and empty texts are one empty line and come back as the empty text. Rows
    sharing an id count as one document, and each is cleaned. Rows with a null id
    count towards no key and come back unchanged. An empty table gives an empty one.

    Texts of any length are read whole. Plan: (key, doc) pairs, then their number per
    key in two shuffles (both pre-aggregated), a checkpoint of the common keys, their
    join back to the lines' positions (between two plain exchanges, so that AQE splits
    a hot key), and the dropped positions of each document beside its text.
    """
    bounded_batches(docs.sparkSession)
    lines = line_keys(docs, id_col, text_col, min_chars)
    held = lines.groupBy("key", "doc").agg(F.lit(1).alias("one"))
    common = durable(held.groupBy("key").agg(F.count("*").alias("n"), F.max("doc").alias("last")).filter(F.col("n") >= min_docs).select("key", "last"))
    drops = lines.join(common, "key").filter("doc < last").groupBy("doc", "mark").agg(F.flatten(F.collect_list("at")).alias("gone"))

    extra = others(docs, [text_col, "n_lines", "n_dropped"])
    rows = docs.select(*[quoted(c).alias(f"c{k}") for k, c in enumerate(extra)], quoted(text_col).cast("string").alias("text"), quoted(id_col).cast("long").alias("id")).withColumn("mark", F.xxhash64("text"))
    joined = rows.join(drops.withColumnRenamed("doc", "id").hint("shuffle_hash"), ["id", "mark"], "left").drop("id", "mark")
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in extra), T.StructField(text_col, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, before, dropped = [], [], []
            at = batch.schema.names
            for t, places in zip(batch[at.index("text")].cast(pa.binary()).to_pylist(), batch[at.index("gone")].to_pylist(), strict=True):
                lines = (t or b"").split(b"\n")
                gone = set(places or ())
                kept = [x for k, x in enumerate(lines) if k not in gone] if gone else lines
                texts.append(b"\n".join(kept).decode())
                before.append(len(lines))
                dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in range(len(extra))), pa.array(texts, pa.string()), pa.array(before, pa.int64()), pa.array(dropped, pa.int64())], schema.names)

    return joined.mapInArrow(reassemble, schema)
