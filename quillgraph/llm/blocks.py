"""Exchange between blocks of whole documents and buckets of keys.

Several operators need, for every key a document holds (word, window hash, byte
context), something known only over the corpus. Shuffling a row for each
occurrence would move many times the input. Instead documents are dealt into
blocks by a hash of their id; a block sends each distinct key once, in one packed
row for each bucket of keys; the bucket's task answers each block in one packed
row; the block's texts and the answers meet by block. So

* texts are shuffled once, compressed (Spark reuses that exchange);
* a key that every document holds reaches its bucket once per block, already
  aggregated: hot keys make no hot task;
* a task holds one block or one bucket. Both shrink as the number of partitions
  grows with the input.

A document's block follows from its id (or its text, where the id is null), not
from row order, so recomputed tasks rebuild the same blocks.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import bounded_batches, give_back, partitions, quoted

#: Text bytes that a map task holds back before it writes packed rows.
FLUSH_BYTES = 12 << 20
#: Of zstd: most of what it can save, at a few CPU seconds a GB.
LEVEL = 5
MESSAGE = "block int, bucket int, payload binary"


#: Labels of the second set of buckets start here.
SECOND = 1 << 29


def hashed(value: int) -> int:
    """Spark's hash of an int column: Murmur3, 32 bits, seed 42."""
    def rotated(x: int, r: int) -> int:
        return (x << r | x >> (32 - r)) & 0xFFFFFFFF

    k = rotated(value * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
    h = (rotated(42 ^ k, 13) * 5 + 0xE6546B64 & 0xFFFFFFFF) ^ 4
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


@functools.lru_cache(8)
def labels(n: int, start: int = 0) -> tuple[int, ...]:
    """n numbers from start on of which Spark's hash partitioning puts one into each of
    n partitions. Blocks and buckets numbered 0, 1, … would share partitions by chance:
    the fullest would get several times the mean."""
    out: dict[int, int] = {}
    value = start
    while len(out) < n:
        out.setdefault(hashed(value) % n, value)
        value += 1
    return tuple(out[k] for k in range(n))


def dump(value) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL).compress(pickle.dumps(value, protocol=5))


def load(payload: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(payload))


def dealt_rows(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    key = F.when(quoted(id_col).isNull(), F.xxhash64(quoted(text_col))).otherwise(F.xxhash64(quoted(id_col)))
    return docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"), F.pmod(key, F.lit(n)).cast("int").alias("block"))


def packed(docs: DataFrame, id_col: str, text_col: str, n: int | None, new: Callable) -> DataFrame:
    """(block, payload) rows over n blocks, dealt by block. new() makes a packer: add(block,
    id, UTF-8 text or None), and payloads() as (block, value) of what was added since."""
    bounded_batches(docs.sparkSession)
    n = n or partitions(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, packer, size = labels(n), new(), 0

        def flush() -> pa.RecordBatch:
            rows = [(place[k], dump(v)) for k, v in packer.payloads()]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.binary())], ["block", "payload"])

        for batch in batches:
            for i, t, b in zip(batch[0].to_pylist(), batch[1].cast(pa.binary()).to_pylist(), batch[2].to_pylist(), strict=True):
                packer.add(b, i, t)
                size += len(t or b"") + 64
                if size >= FLUSH_BYTES:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return dealt_rows(docs, id_col, text_col, n).mapInArrow(write, "block int, payload binary").repartition(n, "block")


class Texts:
    """Payloads hold ids (None for null) and UTF-8 texts (None for null) of some of a block's rows."""

    def __init__(self):
        self.held: dict[int, tuple[list, list]] = {}

    def add(self, block: int, i: int | None, text: bytes | None) -> None:
        ids, texts = self.held.setdefault(block, ([], []))
        ids.append(i)
        texts.append(text)

    def payloads(self) -> Iterator[tuple[int, tuple]]:
        held, self.held = self.held, {}
        yield from sorted(held.items())


class Numbers(dict):
    """Word -> its number, in the order in which they are asked for."""

    def __missing__(self, word: str) -> int:
        found = self[word] = len(self)
        return found


def planes(values: np.ndarray) -> bytes:
    """32-bit numbers, their lowest bytes first: mostly small numbers compress well so."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


class Words:
    """Payloads hold the texts split into words: ids, words in each text, the distinct words,
    the commonest first, and the numbers of the texts' words among them."""

    def __init__(self, split: Callable[[bytes], Iterable[str]]):
        self.split = split
        self.numbers, self.held = Numbers(), {}

    def add(self, block: int, i: int | None, text: bytes | None) -> None:
        ids, codes = self.held.setdefault(block, ([], []))
        ids.append(i)
        codes.append(np.fromiter(map(self.numbers.__getitem__, self.split(text or b"")), np.uint32))

    def payloads(self) -> Iterator[tuple[int, tuple]]:
        names = list(self.numbers)
        for block, (ids, codes) in sorted(self.held.items()):
            used, own, counts = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            words = [names[k] for k in used[order].tolist()]
            yield block, (ids, [len(c) for c in codes], "".join(words).encode(), planes(np.array([len(w) for w in words], np.uint32)), planes(rank[own]))
        self.numbers, self.held = Numbers(), {}


def worded(frame: pd.DataFrame) -> Iterator[tuple[list, np.ndarray, list[str], np.ndarray]]:
    """(ids, words in each text, distinct words, numbers of the words in order), a payload at a time."""
    for payload in frame["payload"]:
        ids, sizes, joined, lengths, codes = load(payload)
        text, ends = joined.decode(), np.cumsum(from_planes(lengths)).tolist()
        yield ids, np.array(sizes, np.int64), [text[a:b] for a, b in zip([0, *ends], ends, strict=False)], from_planes(codes)


def pack(docs: DataFrame, id_col: str, text_col: str, n: int | None = None) -> DataFrame:
    """Whole texts in blocks: see Texts."""
    return packed(docs, id_col, text_col, n, Texts)


def pack_words(docs: DataFrame, id_col: str, text_col: str, split: Callable[[bytes], Iterable[str]], n: int | None = None) -> DataFrame:
    """Texts split into words, in blocks: see Words."""
    return packed(docs, id_col, text_col, n, lambda: Words(split))


def documents(frame: pd.DataFrame) -> Iterator[tuple[int | None, bytes | None]]:
    """The block's rows, a payload at a time."""
    for payload in frame["payload"]:
        yield from zip(*load(payload), strict=True)


def block_of(*frames: pd.DataFrame) -> int:
    return int(next(f["block"].iloc[0] for f in frames if len(f)))


def messages(block: int, by_bucket: dict, n: int) -> pd.DataFrame:
    """Buckets 0 to n - 1, and n to 2 n - 1 for a second set, get their labels here."""
    keys = [k for k, v in by_bucket.items() if v is not None]
    place = (*labels(n), *labels(n, SECOND)) if any(k >= n for k in keys) else labels(n)
    return pd.DataFrame({"block": np.full(len(keys), block, np.int32), "bucket": np.array([place[k] for k in keys], np.int32), "payload": [dump(by_bucket[k]) for k in keys]})


def ask(blocks: DataFrame, answers: DataFrame | None, build: Callable, n: int) -> DataFrame:
    """build(block frame[, earlier answers]) -> {bucket: value or None}, for each block."""
    if answers is None:
        def alone(frame: pd.DataFrame) -> pd.DataFrame:
            give_back()
            return messages(block_of(frame), build(frame), n)

        return blocks.groupBy("block").applyInPandas(alone, MESSAGE)

    def beside(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        give_back()
        return messages(block_of(frame, told), build(frame, told) if len(frame) else {}, n)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(beside, MESSAGE)


def reply(requests: DataFrame, n: int, answer: Callable) -> DataFrame:
    """answer(frame of the bucket's requests) -> list of an answer (or None) for each row.

    The result is dealt by block, beside the texts."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        give_back()
        told = answer(frame)
        kept = [i for i, x in enumerate(told) if x is not None]
        return pd.DataFrame({"block": frame["block"].to_numpy()[kept], "bucket": frame["bucket"].to_numpy()[kept], "payload": [dump(told[i]) for i in kept]})

    return requests.repartition(n, "bucket").groupBy("bucket").applyInPandas(run, MESSAGE).repartition(n, "block")


def finish(blocks: DataFrame, answers: DataFrame, build: Callable, schema: str) -> DataFrame:
    """build(block frame, answers) -> result rows."""
    def run(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        give_back()
        return build(frame, told)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, schema)


def ids_column(ids: list) -> pd.Series:
    """Longs that may be null."""
    return pd.Series(pd.array(ids, dtype="Int64"))
