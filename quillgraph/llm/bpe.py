"""Byte-level BPE over a table of distinct words.

Texts are split into words (pre-tokens) once, on the executors. Each distinct word is
encoded once, and its ids come back to the positions of the texts that hold it.
Decoding joins ids with the vocabulary's id-to-piece table.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import blocks
from quillgraph.llm.common import partitions

#: Words that the library encodes in one call.
BATCH = 8192
#: Texts with other code points than these are split by the library, so that both follow the same Unicode version.
PLAIN = re.compile("[^\x00-\x1b\x20-\x84\x86-ɏ]")
#: Bytes of a text beyond which its words are cut out one by one.
LONG = 1 << 22
#: Ids or bytes gathered at once.
PIECE = 1 << 20


def of_category(first: str) -> str:
    """The code points up to U+024F of the Unicode categories that begin with this letter, for a character class."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == first)


_L, _N = of_category("L"), of_category("N")
#: The split of byte-level BPE, for these code points.
SPLIT = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")


@functools.lru_cache(2)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@functools.lru_cache(2)
def special(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    pre = parts["pre_tokenizer"] or {}
    if parts["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"{path}: not a plain byte-level BPE")
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in parts["added_tokens"]):
        raise ValueError(f"{path}: an added token takes up what stands beside it")
    ids = {x["content"]: x["id"] for x in parts["added_tokens"]}
    return (re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")") if ids else None), ids


@functools.lru_cache(2)
def pieces(path: str) -> list[bytes]:
    """The bytes of each id."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    byte = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}
    with open(path, encoding="utf-8") as f:  # the library's own tables take ten times the memory
        parts = json.load(f)
    vocabulary = parts["model"]["vocab"] | {x["content"]: x["id"] for x in parts["added_tokens"]}
    table = [b""] * (max(vocabulary.values()) + 1)
    for piece, k in vocabulary.items():
        table[k] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
    return table


def split(text: str, path: str) -> Iterable[str]:
    """The words that BPE works on, special tokens as words of their own."""
    at, _ = special(path)
    if len(text) > LONG and not (at and at.search(text)) and not PLAIN.search(text):
        return (m[0] for m in SPLIT.finditer(text))
    parts = at.split(text) if at and at.search(text) else [text]
    out: list[str] = []
    for k, part in enumerate(parts):
        if k % 2:
            out.append(part)
        elif PLAIN.search(part):
            out += [part[a:b] for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(part)]
        else:
            out += SPLIT.findall(part)
    return out


def encode_words(words: list[str], path: str) -> dict[str, list[int]]:
    _, ids = special(path)
    out = {}
    for k in range(0, len(words), BATCH):
        part = words[k : k + BATCH]
        for w, e in zip(part, tokenizer(path).encode_batch(part, add_special_tokens=False), strict=True):
            out[w] = [ids[w]] if w in ids else e.ids
    return out


class Table:
    """Runs of values, fetched by the run's number."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray):
        self.values, self.lengths = values, lengths.astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the runs of these numbers joined, the length of each)."""
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        out, at = np.empty(int(ends[-1]) if len(ends) else 0, self.values.dtype), 0
        while at < len(numbers):
            base = int(ends[at] - lengths[at])
            to = max(at + 1, int(np.searchsorted(ends, base + PIECE, "right")))
            size = int(ends[to - 1]) - base
            own = lengths[at:to]
            place = np.repeat(self.starts[numbers[at:to]] - (ends[at:to] - own - base), own) + np.arange(size)
            out[base : base + size] = self.values[place]
            at = to
        return out, lengths


@functools.lru_cache(2)
def piece_table(path: str) -> Table:
    found = pieces(path)
    return Table(np.frombuffer(b"".join(found), np.uint8), np.array([len(x) for x in found]))


def cut(values: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """values, made of runs of these lengths, cut after every so many runs."""
    ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(sizes)]
    return np.split(values, ends[:-1]) if len(sizes) else []


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids, decoded) for each row of docs: the ids of the whole
    text (binary, little-endian unsigned 32-bit integers) as the tokenizers library
    gives them without added tokens, and the text decoded from them, special tokens
    included.

    path: the tokenizer's JSON file, present on every executor. Special tokens'
    strings inside a text are those tokens, as in the library. Null and empty texts
    have no ids. Null ids stay null; repeated rows come back as often. Bytes that
    are not UTF-8 count as U+FFFD. Texts of any length are read whole.

    See blocks for how words travel: each block of texts sends its distinct words
    once, so a word of every document is encoded once and sent once per block. A
    bucket answers with ids alone, in the order in which it was asked.
    """
    n = partitions(docs.sparkSession)
    packed = blocks.pack_words(docs, id_col, text_col, lambda t: split(t.decode("utf-8", "replace"), path), n)

    def distinct(frame: pd.DataFrame) -> dict[int, list[str]]:
        known: set[str] = set()
        for _, _, words, _ in blocks.worded(frame):
            known.update(words)
        out: dict[int, list[str]] = {}
        for w in sorted(known):
            out.setdefault(xxhash.xxh3_64_intdigest(w) % n, []).append(w)
        return out

    def encode(frame: pd.DataFrame) -> list:
        asked = [blocks.load(p) for p in frame["payload"]]
        table = encode_words(sorted(set().union(*asked)), path)
        return [tuple(blocks.planes(np.array(x, np.uint32)) for x in ([len(table[w]) for w in words], [k for w in words for k in table[w]])) for words in asked]

    def assemble(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        told = {b: blocks.load(p) for b, p in zip(answers["bucket"].tolist(), answers["payload"], strict=True)}
        asked, place = distinct(frame), blocks.labels(n)
        number = {w: k for k, w in enumerate(w for words in asked.values() for w in words)}
        lengths, ids = (np.concatenate([blocks.from_planes(told[place[b]][k]) for b in asked] or [np.empty(0, np.uint32)]) for k in (0, 1))
        table = Table(ids, lengths)
        rows = {"id": [], "n_tokens": [], "ids": [], "decoded": []}
        for own, sizes, words, codes in blocks.worded(frame):
            numbers = np.fromiter(map(number.__getitem__, words), np.int64, len(words))[codes]
            found, each = table.of(numbers)
            text, bytes_each = piece_table(path).of(found)
            tokens = cut(found, each, sizes)
            rows["id"] += own
            rows["n_tokens"] += map(len, tokens)
            rows["ids"] += (x.astype("<u4").tobytes() for x in tokens)
            rows["decoded"] += (x.tobytes().decode("utf-8", "replace") for x in cut(text, bytes_each, np.array([len(x) for x in tokens], np.int64)))
        return pd.DataFrame(rows | {"id": blocks.ids_column(rows["id"])})

    answers = blocks.reply(blocks.ask(packed, None, distinct, n), n, encode)
    found = blocks.finish(packed, answers, assemble, "id long, n_tokens long, ids binary, decoded string")
    return found.select(F.col("id").alias(id_col), "n_tokens", "ids", "decoded")
