"""Language-model scores by context-tree weighting over bytes.

Each byte is coded as 8 binary decisions. A decision has a Krichevsky-Trofimov
estimate at every context depth from 0 to D preceding bytes, and the depths are
mixed by the weights that context-tree weighting gives them (Willems, Shtarkov,
Tjalkens 1995): P_w = (P_e + product of the children's P_w) / 2 inside the tree,
P_w = P_e at depth D.

Training sums, over all training texts, how often each byte follows each context
of D bytes; the tree's counts and weights follow from these sums. A text's score
needs one number for each byte: the log probability of that byte after its D
predecessors, so each block of texts asks once for each distinct (context, byte).
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import blocks
from quillgraph.llm.common import durable, partitions

END = b"\n"
#: Bytes whose contexts are sorted at once.
CHUNK = 1 << 20
#: Sorted contexts that a block holds before it merges them.
MERGE = 1 << 21
KEYS = "bucket int, payload binary"


def held_out(doc: int | None, modulus: int) -> bool:
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % modulus == 0


def tokens(text: bytes | None) -> list[bytes]:
    """Words of the A-Z-lower-cased text, then the end."""
    return [*(text or b"").lower().split(), END]


def events(words: list[bytes], depth: int) -> np.ndarray:
    """A key for each byte of the text: the preceding byte highest, then the ones
    before it, the byte itself lowest. The text is its words joined by a space,
    then the end byte; the end byte also stands before the text."""
    s = np.frombuffer(END * depth + b" ".join(words[:-1]) + END, np.uint8).astype(np.uint64)
    n = len(s) - depth
    key = s[depth:].copy()
    for back in range(1, depth + 1):
        key |= s[depth - back : depth - back + n] << np.uint64(8 * (depth - back + 1))
    return key


class Hashed:
    """Positions of the distinct keys of an array, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self.place(keys)
        while len(left):
            free = self.table[at] < 0
            self.table[at[free]] = left[free]
            lost = self.table[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.table) - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """All keys must be known."""
        at = self.place(keys)
        out = self.table[at]
        wrong = np.flatnonzero(self.keys[out] != keys)
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.table) - 1)
            out[wrong] = self.table[at[wrong]]
            wrong = wrong[self.keys[out[wrong]] != keys[wrong]]
        return out


_SMALL = 2048
_HALF = np.concatenate([[0.5 * np.log(np.pi)], 0.5 * np.log(np.pi) + np.cumsum(np.log(np.arange(_SMALL) + 0.5))])
_WHOLE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _SMALL + 1)))])


def log_gamma(n: np.ndarray, offset: float) -> np.ndarray:
    """log gamma(n + offset) for whole n >= 0, offset 0.5 or 1."""
    table = _HALF if offset == 0.5 else _WHOLE
    x = np.maximum(n, _SMALL) + offset
    far = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n <= _SMALL, table[np.minimum(n, _SMALL).astype(np.int64)], far)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    return log_gamma(zeros, 0.5) + log_gamma(ones, 0.5) - log_gamma(zeros + ones, 1.0) - np.log(np.pi)


def mixed(log_pe: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.logaddexp(log_pe, below) - np.log(2)


class Level:
    """The nodes at one depth: sorted keys (context, decision), counts, weights."""

    def __init__(self, keys, zeros, ones, below):
        order = np.argsort(keys)
        self.keys, self.zeros, self.ones = keys[order], zeros[order], ones[order]
        log_pe = log_kt(self.zeros, self.ones)
        self.leaf = below is None
        self.log_weight = log_pe if self.leaf else mixed(log_pe, below[order])
        #: Odds that the estimate at this depth rather than the deeper mixture is right.
        self.odds = None if self.leaf else np.exp(np.clip(log_pe - below[order], -700, 700))

    def mix(self, keys: np.ndarray, bit: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        count = np.where(bit, self.ones[at], self.zeros[at])
        own = (count + 0.5) / (self.zeros[at] + self.ones[at] + 1)
        if self.leaf:
            return np.where(known, own, deeper)
        return np.where(known, (self.odds[at] * own + deeper) / (self.odds[at] + 1), deeper)


def gathered(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of their columns."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], *(np.add.reduceat(c[order].astype(np.float64), first) if len(keys) else np.empty(0) for c in columns)


def decision(key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(decision's number, its bit) of the k-th decision of each key's byte."""
    byte = key & np.uint64(255)
    return np.uint64(1 << k) | (byte >> np.uint64(8 - k)), (byte >> np.uint64(7 - k) & np.uint64(1)).astype(bool)


def subtree(keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> list[Level]:
    """Levels depth, depth - 1, ..., top of the tree over these events."""
    node, zeros, ones = [], [], []
    for k in range(8):
        number, bit = decision(keys, k)
        node.append((keys >> np.uint64(8) << np.uint64(8)) | number)
        zeros.append(np.where(bit, 0, counts))
        ones.append(np.where(bit, counts, 0))
    at, a, b = gathered(np.concatenate(node), np.concatenate(zeros), np.concatenate(ones))
    levels, below = [], None
    for d in range(depth, top - 1, -1):
        levels.append(Level(at, a, b, below))
        if d > top:
            now = levels[-1]
            up = (now.keys >> np.uint64(16) << np.uint64(8)) | (now.keys & np.uint64(255))
            at, a, b, below = gathered(up, now.zeros, now.ones, now.log_weight)
    return levels


def log10_probability(keys: np.ndarray, levels: list[Level], depth: int) -> np.ndarray:
    """Of each event's byte after its context; levels from depth down to 0."""
    out = np.zeros(len(keys))
    for k in range(8):
        number, bit = decision(keys, k)
        p = np.full(len(keys), 0.5)
        for d, level in zip(range(depth, -1, -1), levels, strict=True):
            context = keys >> np.uint64(8 * (depth - d + 1)) << np.uint64(8)
            p = level.mix(context | number, bit, p)
        out += np.log10(p)
    return out


def event_buckets(keys: np.ndarray, n: int, depth: int) -> np.ndarray:
    """By the two bytes before, so that a bucket has whole subtrees from depth 2 down."""
    near = keys >> np.uint64(8 * (depth - 1))
    return ((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % n


def dealt(n: int, bucket: np.ndarray, *columns: np.ndarray) -> dict:
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1)).tolist()
    return {k: tuple(c[order[a:b]] for c in columns) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b}


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = 5, modulus: int = 10) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score,
    n_bytes, bits_per_byte) for each row of docs.

    Learns from rows whose crc32 of the id as text is not divisible by modulus (a
    null id counts as empty text: held out). Tokens are the words of the
    A-Z-lower-cased text and one end. base_score: the additively smoothed unigram
    log10 probability. score: log10 of the context-tree probability of the words
    joined by a space, and the end. Null and empty texts have the end alone; with
    no training text every byte has probability 1/256. Repeated rows count each.

    Text, words and events travel in blocks (see there). The sums of all training
    texts are written once to the checkpoint folder; depths 0 and 1 (at most 257
    x 255 decisions, whatever the input) reach the driver.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6")
    n = partitions(docs.sparkSession)
    packed = blocks.pack(docs, id_col, text_col, n)

    def ask(frame: pd.DataFrame) -> dict:
        train: dict[bytes, int] = {}
        seen: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        chunk, size = [], 0

        def settle() -> None:
            nonlocal chunk, size
            if chunk:
                a, b = np.unique(np.concatenate(chunk), return_counts=True)
                seen.append(a)
                counts.append(b)
                chunk, size = [], 0
                if sum(map(len, seen)) > MERGE:
                    a, b = gathered(np.concatenate(seen), np.concatenate(counts))
                    seen[:], counts[:] = [a], [b]

        for i, t in blocks.documents(frame):
            words, out = tokens(t), held_out(i, modulus)
            for w in words:
                train[w] = train.get(w, 0) + (not out)
            keys = events(words, depth) << np.uint64(1)
            chunk.append(keys | np.uint64(1) if out else keys)
            size += len(keys)
            if size >= CHUNK:
                settle()
        settle()
        key, total = gathered(np.concatenate(seen), np.concatenate(counts))
        distinct, learnt = gathered(key >> np.uint64(1), np.where(key & np.uint64(1), 0, total))
        out = {n + k: v for k, v in dealt(n, event_buckets(distinct, n, depth), distinct, learnt.astype(np.int64)).items()}
        for w, c in train.items():
            words, count = out.setdefault(xxhash.xxh3_64_intdigest(w) % n, ([], []))
            words.append(w)
            count.append(c)
        return out

    asked = durable(blocks.ask(packed, None, ask, n))
    of_words, of_events = asked.filter(F.col("bucket") < blocks.SECOND), asked.filter(F.col("bucket") >= blocks.SECOND)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        keys, counts = zip(*(blocks.load(p) for p in frame["payload"]), strict=True)
        key, count = gathered(np.concatenate(keys), np.concatenate(counts))
        kept = count > 0
        return pd.DataFrame({"bucket": [frame["bucket"].iloc[0]], "payload": [blocks.dump((key[kept], count[kept]))]})

    model = durable(of_events.select("bucket", "payload").repartition(n, "bucket").groupBy("bucket").applyInPandas(merge, KEYS))

    def near(frame: pd.DataFrame) -> pd.DataFrame:
        key, count = blocks.load(frame["payload"].iloc[0])
        if not len(key):
            return pd.DataFrame({"node": [], "zeros": [], "ones": [], "below": []}).astype({"node": "int64"})
        now = subtree(key, count, depth, 2)[-1]
        up = (now.keys >> np.uint64(16) << np.uint64(8)) | (now.keys & np.uint64(255))
        at, a, b, below = gathered(up, now.zeros, now.ones, now.log_weight)
        return pd.DataFrame({"node": at.astype(np.int64), "zeros": a, "ones": b, "below": below})

    rows = model.groupBy("bucket").applyInPandas(near, "node long, zeros double, ones double, below double").groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).collect()
    first = Level(*(np.array([r[k] for r in rows], np.uint64 if k == 0 else np.float64) for k in range(4)))
    root = Level(*gathered(first.keys & np.uint64(255), first.zeros, first.ones, first.log_weight))

    def totals(frame: pd.DataFrame) -> pd.DataFrame:
        count: dict[bytes, int] = {}
        for p in frame["payload"]:
            for w, c in zip(*blocks.load(p), strict=True):
                if c:
                    count[w] = count.get(w, 0) + c
        return pd.DataFrame({"distinct": [len(count)], "total": [sum(count.values())]})

    at = of_words.repartition(n, "bucket").groupBy("bucket").applyInPandas(totals, "distinct long, total long").agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).head()
    distinct, total = int(at[0]), int(at[1])
    floor = np.log10(total + 0.1 * (distinct + 1))

    def count_words(frame: pd.DataFrame) -> list:
        asked = [blocks.load(p) for p in frame["payload"]]
        count: dict[bytes, int] = {}
        for words, counts in asked:
            for w, c in zip(words, counts, strict=True):
                count[w] = count.get(w, 0) + c
        return [(words, [count[w] for w in words]) for words, _ in asked]

    def predict(frame: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame({"block": [], "bucket": [], "payload": []})
        asked = [blocks.load(p)[0] for p in frame["payload"]]
        keys = np.unique(np.concatenate(asked))
        key, count = blocks.load(known["payload"].iloc[0])
        deep = subtree(key, count, depth, 2) if len(key) else []
        levels = [*deep, first, root] if len(first.keys) and deep else []
        if levels:
            found = log10_probability(keys, levels, depth)
        elif len(first.keys):  # contexts without any training event in this bucket
            found = log10_probability(keys, [*([Level(np.array([1 << 63], np.uint64), np.zeros(1), np.zeros(1), None)] * (depth - 1)), first, root], depth)
        else:
            found = np.full(len(keys), 8 * np.log10(0.5))
        out = [blocks.dump((a, found[np.searchsorted(keys, a)])) for a in asked]
        return pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"], "payload": out})

    told_words = blocks.reply(of_words, n, count_words)
    told_events = of_events.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInPandas(predict, blocks.MESSAGE)

    def finish(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        count: dict[bytes, int] = {}
        keys, values = [], []
        for b, p in zip(answers["bucket"], answers["payload"], strict=True):
            told = blocks.load(p)
            if b < blocks.SECOND:
                count.update(zip(*told, strict=True))
            else:
                keys.append(told[0])
                values.append(told[1])
        where, values = Hashed(np.concatenate(keys)), np.concatenate(values)
        out = {k: [] for k in ("id", "held_out", "n_tokens", "n_known", "base", "score", "n_bytes")}
        for i, t in blocks.documents(frame):
            words = tokens(t)
            c = np.fromiter(map(count.__getitem__, words), np.float64, len(words))
            own = events(words, depth)
            out["id"].append(i)
            out["held_out"].append(held_out(i, modulus))
            out["n_tokens"].append(len(words))
            out["n_known"].append(int((c > 0).sum()))
            out["base"].append(float(np.log10(c + 0.1).sum() - len(words) * floor))
            out["score"].append(float(values[where.find(own)].sum()))
            out["n_bytes"].append(len(own))
        return pd.DataFrame(out | {"id": blocks.ids_column(out["id"])})

    found = blocks.finish(packed, told_words.union(told_events.repartition(n, "block")), finish, "id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long")
    return found.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
        "n_bytes", (-F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"))
