"""Periodic runs of words: repeated k-grams mask a text, Main–Lorentz searches what is left.

A run of period q and length l >= max(least, powers * q) overlaps its own copy, shifted
by q, in l - q words. So all its words lie in k-grams that occur twice in the document,
where k is the smallest such overlap. Words outside repeated k-grams are masked, and
only the stretches between them are searched: each is halved, and for each period a
run across the middle is extended both ways from two places one period apart. Common
extensions come from names of blocks of 1, 2, 4, … words (equal blocks have equal
names), so no hash decides what a run is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.blocks import Numbers
from quillgraph.llm.common import bounded_batches, give_back, quoted

#: Bytes of a text split at once, words named at once in a batch, and periods tried at once.
PIECE, TOGETHER, TRIED = 1 << 20, 1 << 20, 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")
RUNS = "array<struct<start:long,length:long,period:long>>"


def overlap(least: int, powers: int) -> int:
    """The smallest l - q of a run of period q and length l = max(least, powers * q): the masks' k."""
    return min(max(least, powers * q) - q for q in range(1, least + 1))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of text, those of a piece at a time."""
    at = 0
    while at < len(text):
        cut = at + PIECE
        cut = found.start() if (found := SPACE.search(text, cut)) else len(text)
        yield text[at:cut].split()
        at = cut


def surviving(words: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Whether a word lies in a k-gram that its document holds twice. A collision of hashes masks less, never more."""
    n = len(words) - k + 1
    kept = np.zeros(len(words), bool)
    if n < 2:
        return kept
    with np.errstate(over="ignore"):
        h = doc[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for i in range(k):
            h = (h ^ words[i : i + n].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
    whole = np.flatnonzero(doc[:n] == doc[k - 1 :])
    order = whole[np.argsort(h[whole], kind="stable")]
    same = h[order][1:] == h[order][:-1]
    twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    edge = np.zeros(len(words) + 1, np.int64)
    edge[twice] += 1
    np.subtract.at(edge, twice + k, 1)
    return np.cumsum(edge[:-1]) > 0


def block_names(words: np.ndarray, stretch: np.ndarray, longest: int) -> list[np.ndarray]:
    """names[j][i]: a number for the block of 2^j words from i on; blocks of other stretches have other names."""
    names = [np.unique(stretch.astype(np.int64) * (int(words.max()) + 1) + words, return_inverse=True)[1].astype(np.int64)]
    while 2 << (len(names) - 1) <= longest:
        own, size = names[-1], 1 << (len(names) - 1)
        names.append(np.unique(own[:-size] * len(words) + own[size:], return_inverse=True)[1].astype(np.int64))
    return names


def common(names: list[np.ndarray], x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
    """How many words are equal from x and y on (x < y), going up (step 1) or down (-1)."""
    got = np.zeros(len(x), np.int64)
    for j in reversed(range(len(names))):
        own, size = names[j], 1 << j
        while True:  # the largest block may fit again
            a, b = (x + got, y + got) if step > 0 else (x - got - size + 1, y - got - size + 1)
            fine = np.flatnonzero((a >= 0) & (b < len(own)))
            fine = fine[own[a[fine]] == own[b[fine]]]
            got[fine] += size
            if j < len(names) - 1 or not len(fine):
                break
    return got


def stretches(words: np.ndarray, doc: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the unmasked stretches of at least `least` words of one document."""
    kept = surviving(words, doc, k)
    label = np.where(kept, doc, -1)
    first = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]])) if len(label) else np.empty(0, np.int64)
    end = np.append(first[1:], len(label))
    fine = kept[first] & (end - first >= least) if len(first) else np.empty(0, bool)
    return first[fine], end[fine]


def runs_within(words: np.ndarray, first: np.ndarray, end: np.ndarray, least: int, powers: int) -> np.ndarray:
    """(n, 3) rows (start, length, period) of all runs inside the stretches [first, end) of words, sorted by start and period."""
    none = np.empty((0, 3), np.int64)
    if not len(first):
        return none
    size = end - first
    at = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(first - at[:-1], size) + np.arange(at[-1])
    names = block_names(words[place], np.repeat(np.arange(len(first)), size), int(size.max()))
    lo, hi, found = at[:-1], at[1:], [none]
    while len(lo := lo[fine := hi - lo >= least]):
        hi = hi[fine]
        mid = (lo + hi) // 2
        for q, m in tried(mid, (hi - lo) // powers):
            # a run across the middle holds half its periods on one side of it at least: of four
            # periods, a block of half a period or more there equals the one a period on
            block = np.log2(q).astype(np.int64)
            for x, y, after in ((m, m + q, True), (m - q, m, False)):
                a, b = (x, y) if after else (x - (1 << block), y - (1 << block))
                same = np.full(len(q), powers < 4) & (x >= 0) & (y < at[-1])
                for j in np.unique(block) if powers >= 4 else ():
                    own = np.flatnonzero((block == j) & (a >= 0) & (b < len(names[j])))
                    same[own] = names[j][a[own]] == names[j][b[own]]
                xs, ys = x[same], y[same]
                start, stop = xs - common(names, xs - 1, ys - 1, -1), ys + common(names, xs, ys, 1)
                row = np.stack([start, stop - start, q[same]], axis=1)
                found.append(row[row[:, 1] >= np.maximum(least, powers * row[:, 2])])
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
    # a stretch that has a smaller period as well is that period's run
    rows = np.unique(np.concatenate(found), axis=0)
    rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])] if len(rows) else rows
    rows[:, 0] = place[rows[:, 0]]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def tried(mid: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(periods, middles): 1 to most for each middle, so many at once."""
    ends = np.cumsum(most)
    total = int(ends[-1]) if len(ends) else 0
    for k in range(0, total, TRIED):
        n = np.arange(k, min(k + TRIED, total))
        node = np.searchsorted(ends, n, side="right")
        yield n - (ends[node] - most[node]) + 1, mid[node]


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 6, powers: int = 4, edit: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """(id_col, n_words, runs, text) for each row of docs.

    Words are runs of other bytes than space and \\x09 to \\x0D. runs: every stretch of words of
    smallest period q and a length of at least max(least, powers * q) that no neighbouring
    word extends, as structs (start, length, period) by start and period. text: the words
    that no run holds after its first q, joined by one space. edit(id, n) may give, for a
    text of n words, the places whose words are put in their stead.

    Null, empty and blank texts have no word, no run and an empty text. Rows with a null id,
    repeated rows and rows sharing an id come back one by one; texts are searched whole,
    each in one task, in memory of some times its words. powers must be 2 or more.
    """
    if powers < 2 or least < 2:
        raise ValueError("powers and least must be 2 or more")
    bounded_batches(docs.sparkSession)
    k = overlap(least, powers)

    def judge(ids: list, counts: list[int], words: np.ndarray, names: list[bytes]) -> pa.RecordBatch:
        ends = np.cumsum([0, *counts])
        doc = np.repeat(np.arange(len(ids)), counts)
        rows = runs_within(words, *stretches(words, doc, k, least), least, powers)
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, rows[:, 0] + rows[:, 2], 1)
        np.subtract.at(edge, rows[:, 0] + rows[:, 1], 1)
        kept = np.cumsum(edge[:-1]) == 0
        cut = np.searchsorted(rows[:, 0], ends)
        local = rows[:, 0] - np.repeat(ends[:-1], np.diff(cut))
        found = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in (local, rows[:, 1], rows[:, 2])], ["start", "length", "period"]))
        texts = [b" ".join(map(names.__getitem__, words[a:b][kept[a:b]].tolist())) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), found, pa.array(texts, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "text"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, ids, counts, held = Numbers(), [], [], []
            for i, t in zip(batch[0].to_pylist(), batch[1].cast(pa.binary()).to_pylist(), strict=True):
                own = np.concatenate([np.fromiter(map(numbers.__getitem__, p), np.int64, len(p)) for p in pieces(t)] or [np.empty(0, np.int64)]) if t else np.empty(0, np.int64)
                moved = edit(i, len(own)) if edit else None
                ids.append(i)
                counts.append(len(own))
                held.append(own if moved is None else own[moved])
                if sum(counts) >= TOGETHER:
                    yield judge(ids, counts, np.concatenate(held), list(numbers))
                    numbers, ids, counts, held = Numbers(), [], [], []
            if ids:
                yield judge(ids, counts, np.concatenate(held), list(numbers))
            give_back()

    out = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text")).mapInArrow(search, f"id long, n_words long, runs {RUNS}, text string")
    return out.select(F.col("id").alias(id_col), "n_words", "runs", "text")


def longest(runs: Column) -> Column:
    """Of an array of runs, the one of greatest length (ties: smallest start, then period) as a
    struct (less, start, period), where less is the negative length; null if there is none."""
    return F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))


def listed(runs: Column) -> Column:
    """A line `start,length,period` for each run."""
    return F.concat(F.lit(""), F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), ""))
