"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's subwords are its runs of two to four bytes, with ASCII letters lower-cased and
other ASCII bytes as blanks. Each is hashed to a place in a table of embeddings; their
mean goes through a linear layer and a softmax. Table and layer are learnt together by
stochastic gradient descent in numpy, on a bounded sample of labelled rows. Part of the
sample is kept from the descent: on it the softmax gets its temperature, so that
scores are probabilities, and the least score at which a prediction is accepted.
"""

from __future__ import annotations

import dataclasses
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import bounded_batches, durable, give_back, quoted
from quillgraph.llm.contamination import fitted

WIDTHS = (2, 3, 4)
#: Bytes of text hashed at once.
CHUNK = 1 << 17
BLANKS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
UNKNOWN = "und"


@dataclasses.dataclass(frozen=True)
class Model:
    """names: the learnt languages. logits: what a subword of each place adds to the mean, for
    each language. least: the score from which a prediction is accepted."""

    names: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float


def places(text: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """For each width, the places of the subwords that start at each byte but the last width - 1."""
    wide = text.astype(np.uint32)
    own = wide.copy()
    for width in range(2, max(WIDTHS) + 1):
        own = (own[:-1] << np.uint32(8)) | wide[width - 1 :]
        if width in WIDTHS:
            mixed = (own ^ (own >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(width)
            yield ((mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)


def means(texts: list[bytes], logits: np.ndarray, bits: int) -> np.ndarray:
    """The mean of the subwords' rows of logits, for each text."""
    total, number = np.zeros((len(texts), logits.shape[1])), np.zeros(len(texts))
    held, whose, size = [], [], 0

    def add() -> None:
        joined = np.frombuffer(b"".join(held), np.uint8)
        sizes = np.array([len(x) for x in held])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        owner = np.repeat(np.arange(len(held)), sizes)
        early = np.arange(len(joined)) - starts[owner] < CHUNK  # what starts later is the next piece's
        for width, found in zip(WIDTHS, places(joined, bits), strict=True):
            inside = (owner[: len(found)] == owner[width - 1 :]) & early[: len(found)]
            rows = logits[found]
            rows[~inside] = 0
            fine = np.flatnonzero(starts < len(found))
            np.add.at(total, np.array(whose)[fine], np.add.reduceat(rows, starts[fine], axis=0, dtype=np.float64))
            np.add.at(number, np.array(whose)[fine], np.add.reduceat(inside, starts[fine], dtype=np.int64))

    for k, text in enumerate(texts):
        text = b" " + text.translate(BLANKS) + b" "
        for at in range(0, len(text), CHUNK):
            held.append(text[at : at + CHUNK + max(WIDTHS) - 1])
            whose.append(k)
            size += len(held[-1])
            if size >= CHUNK:
                add()
                held, whose, size = [], [], 0
    if held:
        add()
    return total / np.maximum(number, 1)[:, None]


def sparse(text: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, their shares) of a text's subwords: as many as there are places at most."""
    counts = np.zeros(1 << bits, np.int64)
    text = b" " + text.translate(BLANKS) + b" "
    for at in range(0, len(text), CHUNK):
        for width, found in zip(WIDTHS, places(np.frombuffer(text[at : at + CHUNK + max(WIDTHS) - 1], np.uint8), bits), strict=True):
            counts += np.bincount(found[:CHUNK], minlength=1 << bits)
    own = np.flatnonzero(counts)
    return own.astype(np.int32), (counts[own] / max(1, counts.sum())).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def descend(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, n: int, bits: int, size: int, epochs: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(logits, bias) learnt by stochastic gradient descent over minibatches of rows."""
    rng = np.random.default_rng(12)
    embeddings, layer, bias = rng.normal(0, 0.1, (1 << bits, size)).astype(np.float32), np.zeros((size, n), np.float32), np.zeros(n, np.float32)
    layer[:] = rng.normal(0, 0.1, layer.shape)
    batch, steps, step = 16, epochs * -(-len(rows) // 16), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            now = order[at : at + batch]
            place, share = np.concatenate([rows[k][0] for k in now]), np.concatenate([rows[k][1] for k in now])
            starts = np.cumsum([0, *(len(rows[k][0]) for k in now[:-1])])
            mean = np.add.reduceat(embeddings[place] * share[:, None], starts, axis=0)
            slope = softmax(mean @ layer + bias)
            slope[np.arange(len(now)), label[now]] -= 1
            pull = rate * (1 - step / steps)
            back = slope @ layer.T
            layer -= pull / len(now) * (mean.T @ slope)
            bias -= pull / len(now) * slope.sum(axis=0)
            # a text's subwords share its gradient by their shares; their squares keep the step of its mean apart from its length
            owner = np.repeat(np.arange(len(now)), np.diff(np.append(starts, len(place))))
            weight = share / np.maximum(np.add.reduceat(share**2, starts), 1e-9)[owner]
            np.subtract.at(embeddings, place, (pull / len(now)) * weight[:, None] * back[owner])
            step += 1
    return (embeddings @ layer).astype(np.float32), bias


def calibrated(logits: np.ndarray, label: np.ndarray, alpha: float) -> tuple[float, float]:
    """(temperature, least): the temperature that makes the labels likeliest, and the score that
    a share alpha of the labels' languages stay under."""
    if not len(label):
        return 1.0, 0.0
    tried = np.exp(np.linspace(np.log(0.02), np.log(20), 80))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(label)), label], 1e-12)).mean() for t in tried]
    best = float(tried[int(np.argmin(loss))])
    return best, float(np.quantile(softmax(logits / best)[np.arange(len(label)), label], alpha))


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = 4000, bits: int = 15, size: int = 16, epochs: int = 6, rate: float = 0.5, alpha: float = 0.01) -> Model:
    """A model of the languages of labelled rows.

    It learns from fit_rows rows at most, as many of each language as that leaves it,
    chosen by a hash of id and text; rows with a null text or language take no part. Each
    row counts once as a whole and twice as a short piece of its text. Every fifth row
    is kept from the descent for calibration. Features of the sample (at most
    2 ** bits numbers a row), not its texts, meet in the one task that learns; the
    driver gets the model. Without rows the model knows no language.
    """
    spark = labelled.sparkSession
    bounded_batches(spark)
    rows = labelled.select(quoted(lang_col).cast("string").alias("lang"), quoted(text_col).cast("string").alias("text"), F.xxhash64(quoted(id_col), quoted(text_col)).alias("key")).filter("lang is not null and text is not null")
    counts = durable(rows.groupBy("lang").agg(F.count("*").alias("n")))
    known = max(1, counts.count())
    share = F.lit(fit_rows / known) / F.col("n")
    chosen = rows.join(fitted(counts, known), "lang").filter(F.pmod("key", F.lit(1 << 31)) < share * F.lit(float(1 << 31)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text, key in zip(batch[0].to_pylist(), batch[1].cast(pa.binary()).to_pylist(), batch[2].to_pylist(), strict=True):
                rng = np.random.default_rng(key & (2**63 - 1))
                texts = [text]
                for _ in range(2):
                    at, n = int(rng.integers(0, max(1, len(text)))), int(rng.integers(8, 160))
                    texts.append(text[at : at + n])
                own = [sparse(x, bits) for x in texts]
                kept = [k for k, x in enumerate(own) if len(x[0])]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kept)), pa.array([key] * len(kept), pa.int64()), pa.array(kept, pa.int32()), pa.array([own[k][0].tobytes() for k in kept], pa.binary()), pa.array([own[k][1].tobytes() for k in kept], pa.binary())], ["lang", "key", "part", "place", "share"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, keys, parts, held = [], [], [], []
        for batch in batches:
            langs += batch[0].to_pylist()
            keys += batch[1].to_pylist()
            parts += batch[2].to_pylist()
            held += [(np.frombuffer(p, np.int32), np.frombuffer(s, np.float32)) for p, s in zip(batch[3].to_pylist(), batch[4].to_pylist(), strict=True)]
        order = sorted(range(len(langs)), key=lambda k: (keys[k], langs[k], parts[k]))
        langs, keys, held = [langs[k] for k in order], np.array(keys, np.int64)[order], [held[k] for k in order]
        names = sorted(set(langs))
        if names:
            label = np.array([names.index(x) for x in langs])
            apart = (keys >> 31) % 5 == 0
            if len(set(label[~apart])) < len(names):
                apart[:] = False
            own = np.flatnonzero(~apart)
            logits, bias = descend([held[k] for k in own], label[own], len(names), bits, size, epochs, rate)
            rest = np.flatnonzero(apart)
            seen = np.array([s @ logits[p] for p, s in (held[k] for k in rest)]).reshape(len(rest), len(names)) + bias
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Model(names, logits, bias, *calibrated(seen, label[rest], alpha)))], pa.binary())], ["model"])

    features = chosen.select("lang", "text", "key").mapInArrow(read, "lang string, key long, part int, place binary, share binary")
    sample = durable(features).orderBy("key", "lang", "part").limit(3 * fit_rows)
    found = sample.coalesce(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else Model([], np.zeros((1 << bits, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, accepted) for each row of docs.

    lang_pred is a language of the model, and score its probability; `und` and 0 where the
    text is null or has no letter, or where the model knows no language. accepted: whether
    the score reaches the model's least, so that texts unlike any learnt language can be
    told; `und` is never accepted. Whole texts count, long ones piece by piece. Rows with
    a null id and repeated rows come back one by one.
    """
    bounded_batches(docs.sparkSession)
    bits = int(np.log2(len(model.logits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
            own = np.flatnonzero(batch[2].to_numpy(zero_copy_only=False)) if model.names else np.empty(0, np.int64)
            if len(own):
                texts = batch[1].cast(pa.binary()).take(pa.array(own)).to_pylist()
                chance = softmax((means(texts, model.logits, bits) + model.bias) / model.temperature)
                best = chance.argmax(axis=1)
                score[own] = chance[np.arange(len(own)), best]
                for k, b in zip(own.tolist(), best.tolist(), strict=True):
                    lang[k] = model.names[b]
            accepted = np.array([x != UNKNOWN for x in lang], bool) & (score >= model.least)
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(lang, pa.string()), pa.array(score), pa.array(accepted)], ["id", "lang_pred", "score", "accepted"])
            give_back()

    text = quoted(text_col).cast("string")
    out = docs.select(quoted(id_col).cast("long").alias("id"), text.alias("text"), has_letter(text).alias("lettered")).mapInArrow(run, "id long, lang_pred string, score double, accepted boolean")
    return out.select(F.col("id").alias(id_col), "lang_pred", "score", "accepted")


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
