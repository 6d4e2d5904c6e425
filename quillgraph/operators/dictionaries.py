"""Entries of a list found in texts: an Aho–Corasick automaton reads a text once, whatever the number of entries."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of entries that one automaton takes; longer lists are dealt over several, through which a text passes one by one.
ENTRY_BYTES = 8 << 20


def found_entries(texts: DataFrame, entries: DataFrame, *, id_col: str, text_col: str = "text", entry_col: str = "entry", place_col: str = "place") -> DataFrame:
    """JN5, JN6, PF1, PF15, TX5, TX6: (id_col, entry, place, n_entries): the entry of least place that a text holds anywhere, and how
    many distinct ones it holds. Texts are lower-cased; entries are matched as they are.

    Null and empty entries match nothing; of equal entries the least place counts. Null and empty texts, and those
    without an entry, have nulls and 0. Each row of texts comes back once."""
    known = entries.select(F.col(entry_col).cast("string").alias("entry"), F.col(place_col).cast("long").alias("place")).filter("entry <> '' and place is not null").groupBy("entry").agg(F.min("place").alias("place"))
    size = known.agg(F.sum(F.octet_length("entry") + 16)).head()[0] or 0
    parts = size // ENTRY_BYTES + 1
    found = texts.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"), F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("entry"), F.lit(0).cast("long").alias("n"))
    kind = found.schema["id"].dataType.simpleString()
    for k in range(parts if size else 0):
        held = [(r["entry"], r["place"]) for r in known.filter(F.pmod(F.xxhash64("entry"), F.lit(parts)) == k).collect()]  # ENTRY_BYTES on average
        found = found.mapInArrow(matcher(held), f"id {kind}, text string, place long, entry string, n long") if held else found
    return found.select(F.col("id").alias(id_col), "entry", "place", F.col("n").alias("n_entries"))


def matcher(held: list[tuple[str, int]]):
    """Adds what a text holds of these entries to what was found before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for entry, place in held:
            automaton.add_word(entry, (place, entry))
        automaton.make_automaton()
        for batch in batches:
            places, entries, numbers = [], [], []
            for text, place, entry, n in zip(*(batch[k].to_pylist() for k in range(1, 5)), strict=True):
                hits = {x for _, x in automaton.iter(text)} if text else set()
                least = min(hits | ({(place, entry)} if entry is not None else set()), default=(None, None))
                places.append(least[0])
                entries.append(least[1])
                numbers.append(n + len(hits))
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(places, pa.int64()), pa.array(entries, pa.string()), pa.array(numbers, pa.int64())], ["id", "text", "place", "entry", "n"])

    return run
