"""Substring dedup by level-wise doubling.

Windows of `seed` words are checked first; those whose hash occurs once in the
corpus are dropped, the rest are extended to twice the length and checked again,
up to the window length asked for. Only windows that repeat at one length are
ever extended, so the longest level sees a small share of the corpus.

At the first level not every start is needed. Of the seed windows inside each
window of full length the one of least hash is taken (winnowing); equal windows
take it at the same offset, so a repeated window always has a repeated seed.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import blocks
from quillgraph.llm.common import partitions

MULTIPLIERS = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB5B)
#: Bytes of text whose words are hashed in one array.
CHUNK = 1 << 20
NOWHERE = np.iinfo(np.int64).max
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Odd numbers that stand for the 256 bytes, a set for each of the two hashes.
BYTES = np.random.default_rng(20).integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)


@functools.lru_cache(2)
def powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 from 0 to CHUNK, and of its inverse."""
    base = MULTIPLIERS[which]
    return tuple(np.cumprod(np.array([1] + [x] * CHUNK, np.uint64), dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64)))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """A 64-bit hash of each word data[start:end], by prefix sums over the bytes: words
    need not be cut out. Words beyond CHUNK bytes are hashed alone."""
    power, inverse = powers(which)
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        base = int(start[at])
        to = int(np.searchsorted(end, base + CHUNK, "right"))
        if to == at:
            out[at] = xxhash.xxh3_64_intdigest(data[base : end[at]].tobytes(), which)
            at += 1
            continue
        size = int(end[to - 1]) - base
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(BYTES[which][data[base : base + size]] * power[:size], out=sums[1:])
        out[at:to] = (sums[end[at:to] - base] - sums[start[at:to] - base]) * inverse[start[at:to] - base]
        at = to
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(factor)
    return out ^ (out >> np.uint64(29))


def doubled(h: np.ndarray, width: int, power: int) -> np.ndarray:
    """Hashes of windows of twice the width."""
    return h[:-width] + h[width:] * np.uint64(pow(power, width, 1 << 64)) if len(h) > width else h[:0]


def seeded(words: np.ndarray, width: int, power: int) -> np.ndarray:
    n = len(words) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        out += words[k : k + n] * np.uint64(pow(power, k, 1 << 64))
    return out


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each run of width values."""
    f, have = np.minimum if least else np.maximum, 1
    while have < width:
        step = min(have, width - have)
        values = f(values[:-step], values[step:])
        have += step
    return values


class Chunk:
    """Some documents' words in one array, and the window hashes of each level.
    Hashes at windows that would run over a document's end mean nothing: fits() tells."""

    def __init__(self, rows: list[tuple[int | None, bytes]], seed: int, window: int):
        self.seed, self.window = seed, window
        self.data = np.frombuffer(b"\n".join(t for _, t in rows) + b"\n", np.uint8)
        space = np.concatenate([[True], SPACE[self.data]])
        edge = np.flatnonzero(space[1:] != space[:-1])
        self.start, self.stop = edge[::2], edge[1::2]
        ends = np.searchsorted(self.start, np.cumsum([len(t) + 1 for _, t in rows]))
        self.lengths = np.diff(ends, prepend=0)
        self.end, self.begin = np.repeat(ends, self.lengths), np.repeat(ends - self.lengths, self.lengths)
        self.doc = np.repeat(np.array([NOWHERE if i is None else i for i, _ in rows], np.int64), self.lengths)
        self.hashes: dict[int, np.ndarray] = {}

    def at(self, width: int, which: int = 0) -> np.ndarray:
        """The first or the second hash of all windows of this width."""
        if which not in self.hashes:
            self.hashes[which] = word_hashes(self.data, self.start, self.stop, which)
        h, have = seeded(self.hashes[which], self.seed, MULTIPLIERS[which]), self.seed
        while have < width:
            h, have = doubled(h, have, MULTIPLIERS[which]), 2 * have
        return h

    def fits(self, starts: np.ndarray, width: int) -> np.ndarray:
        return starts + width <= self.end[starts]

    def whole(self) -> np.ndarray:
        """Starts of full windows."""
        return np.flatnonzero(np.arange(len(self.end)) + self.window <= self.end)

    def named(self, starts: np.ndarray) -> np.ndarray:
        """Without those in rows of a null id."""
        return starts[self.doc[starts] != NOWHERE]

    def starts(self) -> np.ndarray:
        """Starts whose seed is the least of the seeds of some full window."""
        reach = self.window - self.seed
        # in another order than that of the hashes: the least of these would all go to the first buckets
        seeds = self.at(self.seed) * np.uint64(MULTIPLIERS[1])
        if len(seeds) <= reach:
            return np.empty(0, np.int64)
        low = sliding(seeds, reach + 1, True)
        low[~self.fits(np.arange(len(low)), self.window)] = 0
        pad = np.zeros(reach, np.uint64)
        return self.named(np.flatnonzero(sliding(np.concatenate([pad, low, pad]), reach + 1, False) == seeds))

    def extended(self, starts: np.ndarray, width: int) -> np.ndarray:
        """Starts of windows of twice the width that stand for those at starts: each
        to its right and to its left. A full window around the narrower one holds
        one of the two at least."""
        left = starts[starts - width >= self.begin[starts]] - width
        return np.unique(np.concatenate([starts[self.fits(starts, 2 * width)], left]))

    def covering(self, starts: np.ndarray, width: int) -> np.ndarray:
        """Starts of full windows that hold a window of this width at starts."""
        first = np.maximum(starts - (self.window - width), self.begin[starts])
        last = np.minimum(starts, self.end[starts] - self.window)
        some = first <= last
        mark = np.bincount(first[some], minlength=len(self.end) + 1) - np.bincount(last[some] + 1, minlength=len(self.end) + 1)
        return np.flatnonzero(np.cumsum(mark[:-1]) > 0)


class Known:
    """A sorted array to look hashes up in; a table of their high bits turns most others away."""

    BITS = 22

    def __init__(self, values: np.ndarray):
        self.values = values
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[values >> np.uint64(64 - self.BITS)] = True

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indexes of asked that are here, the first place of each)."""
        at = np.flatnonzero(self.table[asked >> np.uint64(64 - self.BITS)]) if len(self.values) else np.empty(0, np.int64)
        place = np.searchsorted(self.values, asked[at])
        place[place == len(self.values)] = 0
        same = self.values[place] == asked[at] if len(at) else np.empty(0, bool)
        return at[same], place[same]


def bucketed(n: int, key: np.ndarray, *columns: np.ndarray) -> dict:
    """{bucket: columns}, dealt by the key's high bits; key is sorted."""
    edges = np.searchsorted(key, np.array([((k << 64) // n) for k in range(1, n)], np.uint64)) if n > 1 else np.empty(0, np.int64)
    cuts = [0, *edges.tolist(), len(key)]
    return {k: tuple(c[a:b] for c in (key, *columns)) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b}


def repeated(frame: pd.DataFrame) -> list:
    """For requests (hashes, several): the sorted hashes that occur twice or more in all."""
    asked = [blocks.load(p) for p in frame["payload"]]
    keys = np.concatenate([a[0] for a in asked])
    many = np.concatenate([a[1] for a in asked])
    order = np.argsort(keys)
    keys, many = keys[order], many[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    twice = (np.diff(np.append(first, len(keys))) > 1) | np.logical_or.reduceat(many, first)
    known = keys[first][twice]
    known = Known(known)
    return [a[0][own] if len(own := known.find(a[0])[0]) else None for a in asked]


def counted(parts: list[np.ndarray], n: int) -> dict:
    """Requests to repeated(): the distinct hashes and whether each is there twice or more."""
    keys, counts = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
    return bucketed(n, keys, counts > 1)


def told(frame: pd.DataFrame) -> np.ndarray:
    """All answered hashes, sorted."""
    parts = [blocks.load(p) for p in frame["payload"]]
    return np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def firsts(h: np.ndarray, g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (h, g) and the smallest doc of each, sorted by h."""
    order = np.lexsort((doc, g, h))
    h, g, doc = h[order], g[order], doc[order]
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]) if len(h) else np.empty(0, bool)
    return h[first], g[first], doc[first]


def earlier(frame: pd.DataFrame) -> list:
    """For requests (h, g, smallest doc): those that a smaller document of another block holds."""
    asked = [blocks.load(p) for p in frame["payload"]]
    h, g, doc = (np.concatenate([a[k] for a in asked]) for k in range(3))
    owner = np.repeat(np.arange(len(asked)), [len(a[0]) for a in asked])
    order = np.lexsort((doc, g, h))
    h, g, doc, owner = h[order], g[order], doc[order], owner[order]
    start = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
    least = doc[np.flatnonzero(start)][np.cumsum(start) - 1]
    out = []
    late = doc > least
    by = np.argsort(owner[late], kind="stable")
    hs, gs, os = h[late][by], g[late][by], owner[late][by]
    for k in range(len(asked)):
        a, b = np.searchsorted(os, [k, k + 1])
        out.append((hs[a:b], gs[a:b]) if b > a else None)
    return out


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20, levels: int = 2) -> DataFrame:
    """(id_col, n_words, n_removed, text_col): each text rid of the words under
    windows that occur earlier.

    Words: runs without ASCII white space. A window is `window` consecutive words
    of a document, and occurs earlier if the same words start in a document of
    smaller id, or further up in the same document. Windows are judged on the
    input. Kept words are joined by one space. window must be divisible by
    2^levels; the first level has window / 2^levels words.

    A null text has no words. Rows sharing an id count as one document: they never
    remove each other's words. A row with a null id is compared with itself only
    and removes no other's words. Shorter texts than the window lose nothing.

    The levels that 64 bits of hash decide are only filters; the last one compares 96,
    of two hashes that differ from the bytes on. A text of any length is read whole; a
    chunk holds one such text, at some fifteen times its bytes. See blocks for how
    hashes travel.
    """
    if window % (1 << levels):
        raise ValueError("window must be divisible by 2 ** levels")
    spark = docs.sparkSession
    n, seed = partitions(spark), window >> levels
    packed = blocks.pack(docs, id_col, text_col, n)

    def chunks(frame: pd.DataFrame):
        """(rows, Chunk) of about CHUNK bytes."""
        rows, size = [], 0
        for i, t in blocks.documents(frame):
            rows.append((i, t or b""))
            size += len(t or b"")
            if size >= CHUNK:
                yield rows, Chunk(rows, seed, window)
                rows, size = [], 0
        if rows:
            yield rows, Chunk(rows, seed, window)

    def first(frame: pd.DataFrame) -> dict:
        return counted([c.at(seed)[c.starts()] for _, c in chunks(frame)], n)

    def surviving(c: Chunk, known: Known, width: int) -> np.ndarray:
        """Starts of windows of this width whose hash known has."""
        h = c.at(width)
        if width == seed:
            starts = c.starts()
            return starts[known.find(h[starts])[0]]
        starts = known.find(h)[0]
        return c.named(starts[c.fits(starts, width)])

    def between(width: int):
        def build(frame: pd.DataFrame, answers: pd.DataFrame) -> dict:
            known = Known(told(answers))
            return counted([c.at(2 * width)[c.extended(surviving(c, known, width), width)] for _, c in chunks(frame)], n)

        return build

    def full(width: int):
        def build(frame: pd.DataFrame, answers: pd.DataFrame) -> dict:
            known, parts = Known(told(answers)), []
            for _, c in chunks(frame):
                starts = c.covering(surviving(c, known, width), width)
                parts.append(firsts(c.at(window)[starts], (c.at(window, 1)[starts] >> np.uint64(32)).astype(np.uint32), c.doc[starts]))
            return bucketed(n, *firsts(*(np.concatenate(x) for x in zip(*parts, strict=True))))

        return build

    answers = blocks.reply(blocks.ask(packed, None, first, n), n, repeated)
    width = seed
    while 2 * width < window:
        answers = blocks.reply(blocks.ask(packed, answers, between(width), n), n, repeated)
        width *= 2
    answers = blocks.reply(blocks.ask(packed, answers, full(width), n), n, earlier)

    def build(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows, parts, at = [], [], 0
        for some, c in chunks(frame):
            starts = c.whole()
            row = np.repeat(np.arange(len(rows), len(rows) + len(some)), c.lengths)[starts]
            parts.append((c.at(window)[starts], (c.at(window, 1)[starts] >> np.uint64(32)).astype(np.uint32), starts + at, c.doc[starts], row))
            rows += zip(some, c.lengths.tolist(), strict=True)
            at += len(c.end)
        h, g, start, doc, row = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        late_parts = [blocks.load(p) for p in answers["payload"]] or [(np.empty(0, np.uint64), np.empty(0, np.uint32))]
        late, check = (np.concatenate(x) for x in zip(*late_parts, strict=True))
        order = np.argsort(late)
        late, check = late[order], check[order]

        dead = np.zeros(len(h), bool)
        # windows that a smaller document of another block holds
        hit, place = Known(late).find(h)
        while len(hit):
            same = check[place] == g[hit]
            dead[hit[same]] = True
            hit, place = hit[~same], place[~same] + 1
            more = place < len(late)
            hit, place = hit[more], place[more]
            more = late[place] == h[hit]
            hit, place = hit[more], place[more]
        dead &= doc != NOWHERE
        # windows that are in this block more than once
        order = np.argsort(h)
        again = h[order][1:] == h[order][:-1]
        several = np.sort(order[np.concatenate([again, [False]]) | np.concatenate([[False], again])]) if len(h) else order
        order = several[np.lexsort((start[several], row[several], doc[several], g[several], h[several]))]
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])]) if len(order) else np.empty(0, bool)
        least = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else doc[:0]
        own = ~new & np.concatenate([[False], row[order][1:] == row[order][:-1]]) if len(order) else new
        dead[order[own | (doc[order] > least) & (doc[order] != NOWHERE)]] = True

        gone = np.bincount(start[dead], minlength=at + window + 1) - np.bincount(start[dead] + window, minlength=at + window + 1)
        gone = np.cumsum(gone)[:at] > 0
        out, at = {"id": [], "n_words": [], "n_removed": [], "text": []}, 0
        for (i, t), size in rows:
            own = gone[at : at + size]
            at += size
            count = int(own.sum())
            words = t.split() if count < size else []
            out["id"].append(i)
            out["n_words"].append(size)
            out["n_removed"].append(count)
            out["text"].append(b" ".join(itertools.compress(words, (~own).tolist()) if count else words).decode())
        return pd.DataFrame(out | {"id": blocks.ids_column(out["id"])})

    found = blocks.finish(packed, answers, build, "id long, n_words long, n_removed long, text string")
    return found.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("text").alias(text_col))
