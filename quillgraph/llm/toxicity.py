"""Toxicity: a Levenshtein automaton over a lexicon trie, and context windows.

The lexicon is learnt from labelled texts: words, and stems with many endings, that
toxic texts hold and clean ones do not. All terms share one trie; the automaton
that accepts every word within one edit of a term is built over it as words are
read, state by state, and kept. Hits count by their window: inside quotation marks,
or beside words that report speech, they weigh apart from direct ones, be they exact or misspelled.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import bounded_batches, crc_fold, durable, others, quoted

#: Words read since the last reset that a task remembers, and automaton states that it keeps.
WORDS_KEPT, STATES_KEPT = 1 << 18, 1 << 14
#: Shortest term that may be misspelled.
FUZZY_LENGTH = 5
STEMS = (4, 5, 6)
QUOTES = "\"“”„«»‘’"
REPORTING = frozenset("said says wrote writes quoted quote quotes called reported word term slur insult allegedly dit écrit cité mot sagte schrieb zitiert wort dijo escribió citó palabra".split())
WINDOW = 6
TOKEN = re.compile(r"[^\W_]+(?:['@$!|+][^\W_]+)*|[" + QUOTES + "]")
LEET = str.maketrans("0134578@$!|+", "oieastbasiit")
#: Sums of log odds of hits by window, exact and by an edit; the rest counts direct hits alone, exact ones but for density.
FEATURES = ("bias", "direct", "quoted", "fuzzy", "fuzzy_quoted", "stem", "density", "any")


class Trie:
    """Terms as rows of children; a node may end a word or a stem (any ending follows)."""

    def __init__(self, terms: dict[str, float]):
        self.child: list[dict[str, int]] = [{}]
        self.word: dict[int, str] = {}
        self.stem: dict[int, str] = {}
        for term in sorted(terms):
            node = 0
            for c in term.rstrip("*"):
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                node = self.child[node][c]
            (self.stem if term.endswith("*") else self.word)[node] = term
        self.alphabet = {c for kids in self.child for c in kids}


class Automaton:
    """The trie intersected with the Levenshtein automaton of one edit.

    A state is the set of (node, edits) reachable on what was read; transitions are
    worked out once and looked up from then on."""

    def __init__(self, terms: dict[str, float]):
        self.terms, self.trie = terms, Trie(terms)
        self.reset()

    def reset(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.start = self.state(self.skips({(0, 0)}))

    def skips(self, found: set) -> frozenset:
        """With the states that leave out a letter of the term."""
        return frozenset(found | {(k, 1) for node, e in found if e == 0 for k in self.trie.child[node].values()})

    def state(self, found: frozenset) -> int:
        if found not in self.number:
            self.number[found] = len(self.sets)
            self.sets.append(found)
            self.next.append({})
        return self.number[found]

    def step(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            kids = self.trie.child[node]
            if c in kids:
                out.add((kids[c], e))
            if e == 0:
                out.add((node, 1))
                out.update((k, 1) for x, k in kids.items() if x != c)
        to = self.next[state][c] = self.state(self.skips(out))
        return to

    def match(self, word: str) -> tuple[str, str] | None:
        """(kind, term): "word" and "stem" are exact, "fuzzy" is one edit off a word."""
        if len(self.sets) > STATES_KEPT:
            self.reset()
        state, stem = self.start, None
        node = 0
        for c in word:
            c = c if c in self.trie.alphabet else "\0"
            to = self.next[state].get(c)
            state = self.step(state, c) if to is None else to
            if node is not None:
                node = self.trie.child[node].get(c)
                if node in self.trie.stem:
                    stem = self.trie.stem[node]
            if not self.sets[state]:
                break
        if node is not None and node in self.trie.word:
            return "word", self.trie.word[node]
        if stem:
            return "stem", stem
        near = [self.trie.word[n] for n, _ in self.sets[state] if n in self.trie.word and len(self.trie.word[n]) >= FUZZY_LENGTH]
        return ("fuzzy", max(near, key=lambda t: (self.terms[t], t))) if near else None


@dataclass(frozen=True)
class Model:
    terms: dict[str, float]
    exceptions: frozenset[str]
    weights: tuple[float, ...]


class Hits(dict):
    """Word -> its hit or None, worked out when first asked for; of bounded size."""

    def __init__(self, model: Model):
        self.model, self.automaton = model, Automaton(model.terms)

    def __missing__(self, word: str) -> tuple[str, str] | None:
        if len(self) >= WORDS_KEPT:
            self.clear()
        found = None if word in self.model.exceptions else self.automaton.match(word)
        if found is None and (plain := word.translate(LEET)) != word and any(c.isalpha() for c in word):
            found = self.automaton.match(plain)
        self[word] = found
        return found


class Scorer:
    def __init__(self, model: Model):
        self.model, self.hits = model, Hits(model)

    def features(self, text: str | None) -> tuple[np.ndarray, set[str]]:
        """FEATURES of the text, and its words that are hits by an edit."""
        tokens = TOKEN.findall((text or "").lower())
        found = list(map(self.hits.__getitem__, tokens))
        hits = [(k, tokens[k], x) for k, x in enumerate(found) if x] if any(found) else []
        out = np.zeros(len(FEATURES))
        out[0] = 1
        if not hits:
            return out, set()
        marks, inside = [False] * len(tokens), False
        for k, w in enumerate(tokens):
            if w in QUOTES and len(w) == 1:
                inside = not inside
            marks[k] = inside
        near, direct = set(), 0
        for k, w, (kind, term) in hits:
            told = marks[k] or not REPORTING.isdisjoint(tokens[max(0, k - WINDOW) : k + WINDOW + 1])
            out[1 + told + 2 * (kind == "fuzzy")] += self.model.terms[term]
            if kind == "fuzzy":
                near.add(w)
            if not told:
                direct += 1
                out[5] += kind == "stem"
                out[7] = max(out[7], kind != "fuzzy")
        out[1:6] = np.log1p(out[1:6])
        out[6] = 10 * direct / len(tokens)
        return out, near

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text)[0] @ np.array(self.model.weights), -30, 30))))


def family(tokens: set[str]) -> int:
    """Near copies of a text mostly share it: they count as one witness of a word."""
    return min((xxhash.xxh3_64_intdigest(w) for w in tokens), default=0) >> 1


def paired(sample: DataFrame, schema: str, pairs) -> DataFrame:
    """Distinct (term, number) rows: pairs(words of a text) gives each text's, and a
    batch's own repeats are dropped before anything is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for text in batch[0].to_pylist():
                seen.update(pairs(set(TOKEN.findall((text or "").lower()))))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in seen], pa.string()), pa.array([x for _, x in seen], pa.int64())], ["term", "number"])

    rows = sample.select("text").mapInArrow(run, schema)
    return rows.groupBy("term", "number").agg(F.lit(1).alias("one")).groupBy("term").agg(F.count("*").alias("n"))


def witnesses(sample: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """(term, n): how many families of texts hold each word ("x") or stem ("x*")."""
    def pairs(words: set[str]) -> Iterator[tuple[str, int]]:
        own = family(words)
        for w in words:
            for term in (w, *(w[:k] + "*" for k in STEMS if len(w) >= k)):
                if wanted is None or term in wanted:
                    yield term, own

    return paired(sample, "term string, number long", pairs)


def endings(sample: DataFrame, wanted: frozenset[str]) -> DataFrame:
    """(term, n): how many words begin with each stem."""
    def pairs(words: set[str]) -> Iterator[tuple[str, int]]:
        for w in words:
            for k in STEMS:
                if (term := w[:k] + "*") in wanted:
                    yield term, xxhash.xxh3_64_intdigest(w) >> 1

    return paired(sample, "term string, number long", pairs)


#: Where the fit starts and what the ridge pulls to: few samples hold misspelled or quoted terms.
PRIOR = np.array([0, 1.5, 0.3, 0.5, 0.1, 0, 0, 0])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression of weighted rows with a ridge around PRIOR, by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (p - y)) + penalty * (w - PRIOR))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 4, held: int = 2, fit_rows: int = 40_000, min_families: int = 3, min_odds: float = 3.0, chance: float = 1.0) -> Model:
    """A model from labelled rows whose crc32 of the id as text, modulo modulus, is not held.

    fit_rows bounds the sample: up to half of it toxic rows and the rest clean ones,
    those of least hash of the id. In the fit and in the votes on exceptions a row
    weighs as many labelled rows as it stands for, so the score follows the labels' own
    mix of classes at any size. The lexicon takes words held by min_families
    families of toxic texts or more, with log odds of min_odds or more over clean
    ones, where about `chance` words in all would pass by chance; stems also need
    three endings or more. Null labels and ids are left out;
    of repeated labels of an id the largest counts.
    """
    key = quoted(id_col)
    known = labels.select(key.cast("long").alias("id"), quoted(label_col).cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)").filter(crc_fold(F.col("id"), modulus) != held)
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("id", F.lit(11))
    totals = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    stands = [max(1.0, totals.get(t, 0) / max(fit_rows // 2, 1)) for t in (0, 1)]  # labelled rows for each one sampled
    chosen = [known.filter(F.col("toxic") == t).orderBy(order).limit(fit_rows // 2) for t in (0, 1)]
    picked = chosen[0].union(chosen[1])
    bounded_batches(docs.sparkSession)
    # fit_rows ids at most are broadcast, and their texts kept: every pass below reads the sample alone
    sample = durable(docs.select(key.cast("long").alias("id"), quoted(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id"))

    n = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return Model({}, frozenset(), (math.log((bad * stands[1] + 0.5) / (good * stands[0] + 0.5)) if bad or good else math.log(0.01), *[0.0] * (len(FEATURES) - 1)))
    bad_texts = sample.filter("toxic = 1")
    toxic = {r["term"]: r["n"] for r in witnesses(bad_texts, None).filter(F.col("n") >= min_families).collect()}
    clean = {r["term"]: r["n"] for r in witnesses(sample.filter("toxic = 0"), frozenset(toxic)).collect()}
    odds = {t: math.log((k + 0.5) / (bad + 1)) - math.log((clean.get(t, 0) + 0.5) / (good + 1)) for t, k in toxic.items()}
    share, doubt = bad / (bad + good), math.log(max(len(toxic), 1) / chance)

    def telling(t: str) -> bool:
        """Likelier in toxic texts than chance makes any of so many terms. Counts and share are the sample's."""
        yes, no = toxic[t], clean.get(t, 0)
        return odds[t] >= min_odds and yes * math.log(yes / ((yes + no) * share)) + (no * math.log(no / ((yes + no) * (1 - share))) if no else 0) >= doubt

    good_terms = {t for t in toxic if telling(t)}
    likely = frozenset(t for t in good_terms if t.endswith("*"))
    stems = {r["term"] for r in endings(bad_texts, likely).filter("n >= 3").collect()}
    stems = {t for t in stems if not any(t[:k] + "*" in stems for k in STEMS if k < len(t) - 1)}
    terms = {t: odds[t] for t in good_terms if t in stems or not t.endswith("*")}

    rows = featured(sample, Model(terms, frozenset(), tuple([0.0] * len(FEATURES))))
    votes: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for r in rows:
        for w in r["near"]:
            votes[w][r["toxic"]] += 1
    exceptions = frozenset(w for w, (no, yes) in votes.items() if no * stands[0] >= yes * stands[1])
    if exceptions:
        rows = featured(sample, Model(terms, exceptions, tuple([0.0] * len(FEATURES))))
    y = np.array([r["toxic"] for r in rows], float)
    weight = np.where(y > 0, stands[1], stands[0])
    w = logistic(np.array([r["x"] for r in rows]), y, weight / weight.mean())  # the ridge meets as many rows as were read
    return Model(terms, exceptions, tuple(float(v) for v in w))


def featured(sample: DataFrame, model: Model) -> list:
    """The sample's features (fit_rows rows at most) on the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.features(t) for t in batch[0].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[1], pa.array([x.tolist() for x, _ in found], pa.list_(pa.float64())), pa.array([sorted(w) for _, w in found], pa.list_(pa.string()))], ["toxic", "x", "near"])

    return sample.select("text", "toxic").mapInArrow(run, "toxic int, x array<double>, near array<string>").collect()


def score_documents(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold, else 0).

    They replace input columns so named. Only the text counts. Null and empty texts
    score as texts without any hit. One pass, no shuffle.
    """
    bounded_batches(docs.sparkSession)
    extra = others(docs, ["score", "predicted"])
    rows = docs.select(*[quoted(c).alias(f"c{k}") for k, c in enumerate(extra)], quoted(text_col).cast("string").alias("text"))
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in extra), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.score(t) for t in batch[len(extra)].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in range(len(extra))), pa.array(found, pa.float64()), pa.array([int(x >= threshold) for x in found], pa.int32())], schema.names)

    return rows.mapInArrow(run, schema)
