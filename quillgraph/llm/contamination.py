"""Benchmark decontamination: size-partitioned MinHash containment search.

An item of n distinct shingles is contained at threshold t when a document holds
at least ceil(t n) of them. So among any n - ceil(t n) + 1 of them at least one is
in such a document. The item's signature is its bottom-k MinHash with that k. Items
are partitioned by size, a class for each doubling, and each class is searched apart: its
ceiling is the largest hash in its signatures, and a document's signature for the class is
its MinHash up to that ceiling. Whatever its length, it meets the signature of every
contained item of the class, and the search loses no pair. The larger the items, the lower
their ceiling and the fewer shingles their class reads: items of a few shingles need most
of a document's, those of hundreds about a fifth. Of what is under the ceiling, a table
of the class's signatures (SLOTS places, by the low bits of a hash) keeps what may be in
one. Candidates are verified by their shingles' exact text. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import durable, quoted

#: Signature or candidate tables of up to so many rows are broadcast (16 bytes a row); larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Places of a class's table. It fills up where signatures are many; the ceiling holds whatever their number.
SLOTS = 1 << 16
#: Words: runs of letters, marks and digits of the lower-cased text.
SEPARATORS = r"[^\p{L}\p{M}\p{N}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda x: x != "")


def windows(array: Column, width: int, join) -> Column:
    """join of each run of width elements; none if the array is shorter."""
    last = F.size(array) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: join(*(F.get(array, i + k) for k in range(width))))).otherwise(F.array())


def pair(*w: Column) -> Column:
    """A shingle's text, and its hash as documents have it."""
    return F.struct(F.concat_ws(" ", *w).alias("shingle"), F.xxhash64(*(F.xxhash64(x) for x in w)).alias("h"))


def with_width(array: Column, width: int) -> Column:
    return F.transform(array, lambda x: F.struct(F.lit(width).alias("width"), x.alias("x")))


def of_widths(column: str, widths: list[int], join) -> Column:
    """structs (width, x) of all windows of these widths over the array column."""
    found = [with_width(windows(F.col(column), k, join), k) for k in widths]
    return found[0] if len(found) == 1 else F.concat(*found)


@dataclass(frozen=True)
class SizeClass:
    """Items of one width of shingles and one doubling of size: what of a document may be in their signatures."""

    width: int
    part: int
    ceiling: int
    slots: bytes

    def reads(self, h: Column) -> Column:
        taken = F.substring(F.lit(self.slots), F.pmod(h, F.lit(SLOTS)).cast("int") + 1, F.lit(1)) == F.lit(b"\1")
        return (h <= F.lit(self.ceiling)) & taken


def size_classes(signature: DataFrame) -> list[SizeClass]:
    """Of (rep, width, part, h). The driver gets a ceiling and SLOTS bits for each class: there
    is a class for each width of short items and each doubling of size."""
    tops = signature.groupBy("width", "part").agg(F.max("h").alias("top")).collect()
    slots = {(r["width"], r["part"]): np.zeros(SLOTS // 64, np.uint64) for r in tops}
    slot = F.pmod("h", F.lit(SLOTS)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63))
    for r in signature.select("width", "part", F.shiftright(slot, 6).alias("word"), bit.alias("bit")).groupBy("width", "part", "word").agg(F.bit_or("bit").alias("bits")).collect():
        slots[r["width"], r["part"]][r["word"]] = r["bits"] % (1 << 64)
    table = {k: np.unpackbits(v.view(np.uint8), bitorder="little").tobytes() for k, v in slots.items()}
    return sorted((SizeClass(r["width"], r["part"], r["top"], table[r["width"], r["part"]]) for r in tops), key=lambda c: (c.width, c.part))


def signatures(rows: DataFrame, classes: list[SizeClass]) -> DataFrame:
    """(doc, width, part, h): for each class, the hashes of a document that may be in the class's signatures. rows: (doc, text)."""
    widths = sorted({c.width for c in classes})
    hashes = rows.select("doc", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    hashes = hashes.select("doc", *(windows(F.col("w"), k, F.xxhash64).alias(f"h{k}") for k in widths))

    def of_class(c: SizeClass) -> Column:
        held = F.filter(F.col(f"h{c.width}"), c.reads)
        return F.transform(held, lambda h: F.struct(F.lit(c.width).alias("width"), F.lit(c.part).cast("long").alias("part"), h.alias("h")))

    found = [of_class(c) for c in classes]
    return hashes.select("doc", F.explode(found[0] if len(found) == 1 else F.concat(*found)).alias("s")).select("doc", "s.width", "s.part", "s.h")


def fitted(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contained_items(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id_col, item_col, n_shared, n_item, containment): the documents that hold
    threshold or more of an item's distinct word shingles.

    Words are runs of letters, marks and digits, lower-cased. An item of fewer
    than width words is one shingle of all its words, found as that run of words;
    an item without words, a null text or a null id matches nothing. Rows sharing a
    doc id count as one document, rows sharing an item id as one item of all their
    shingles. Items of equal shingles are searched once. Texts of any length are
    searched whole.
    """
    mine = items.select(quoted(item_col).alias("item"), words(quoted(item_text_col)).alias("w")).filter(F.col("item").isNotNull() & (F.size("w") > 0))
    mine = mine.withColumn("width", F.least(F.size("w"), F.lit(width)))
    # the widths of short items: at most width numbers reach the driver
    sizes = sorted(r[0] for r in mine.select("width").distinct().collect())
    if not sizes:
        empty = docs.select(quoted(id_col).alias(id_col), F.lit(None).cast(items.schema[item_col].dataType).alias(item_col)).limit(0)
        return empty.select("*", F.lit(0).cast("long").alias("n_shared"), F.lit(0).cast("long").alias("n_item"), F.lit(0.0).alias("containment"))
    parts = mine.select("item", F.col("width").alias("own"), F.explode(of_widths("w", sizes, pair)).alias("s")).filter("s.width = own")
    parts = parts.select("item", F.struct("s.x.h", "s.width", "s.x.shingle").alias("s")).distinct()
    sets = parts.groupBy("item").agg(F.sort_array(F.collect_list("s")).alias("set"))
    # items of equal shingles: one stands for them all
    member = durable(sets.join(sets.groupBy("set").agg(F.min("item").alias("same")), "set").select("item", "same", "set"))
    unique = member.filter("item = same").select(F.col("same").alias("rep"), "set", F.size("set").alias("n"))
    unique = unique.withColumn("need", F.ceil(F.col("n") * F.lit(threshold) - 1e-9).cast("int")).withColumn("need", F.greatest("need", F.lit(1)))
    # sets are sorted by hash: the first elements are the bottom-k MinHash
    signature = durable(unique.select("rep", F.floor(F.log2("n")).alias("part"), F.explode(F.slice("set", F.lit(1), F.col("n") - F.col("need") + 1)).alias("s")).select("rep", "part", "s.h", "s.width"))
    rows = docs.select(quoted(id_col).alias("doc"), quoted(text_col).cast("string").alias("text")).filter("doc is not null and text is not null")
    found = signatures(rows, size_classes(signature))
    cands = durable(found.join(fitted(signature, signature.count()), ["h", "width", "part"]).select("doc", "rep").distinct())

    named = cands.select("doc").distinct()
    texts = rows.join(fitted(named, named.count()), "doc", "left_semi").select("doc", words(F.col("text")).alias("w"))
    held = texts.select("doc", F.explode(of_widths("w", sizes, lambda *w: F.concat_ws(" ", *w))).alias("s")).select("doc", "s.width", F.col("s.x").alias("shingle")).distinct()
    want = unique.select("rep", "n", "need", F.explode("set").alias("s")).select("rep", "n", "need", "s.width", "s.shingle")
    # a candidate's shingles are looked for in its own document alone: common ones meet no others
    due = cands.join(fitted(want, want.count()), "rep")
    shared = held.join(due, ["doc", "width", "shingle"])
    leaks = shared.groupBy("doc", "rep", "n", "need").agg(F.count("*").alias("shared")).filter("shared >= need")
    out = leaks.join(member.select("item", F.col("same").alias("rep")), "rep")
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("shared").alias("n_shared"), F.col("n").cast("long").alias("n_item"), (F.col("shared") / F.col("n")).alias("containment"))
