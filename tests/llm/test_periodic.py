"""Periodic runs against a plain search of every period."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import periodic
from quillgraph.llm.queries import repeated_tail


def plain_runs(words, least=6, powers=4):
    out = []
    for q in range(1, len(words) // powers + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(least, powers * q):
                own = words[s : s + length]
                if not any(own[p:] == own[:-p] for p in range(1, q)):
                    out.append((s, length, q))
            i = max(i, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(rng, n):
    for _ in range(n):
        words = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.randint(0, 70))]
        if words and rng.random() < 0.7:
            at = rng.randrange(len(words))
            period = rng.randint(1, min(9, len(words) - at))
            words[at:] = [words[at + k % period] for k in range(len(words) - at)]
            words += [rng.choice("abx") for _ in range(rng.randint(0, 8))]
        yield words


@pytest.mark.parametrize(("least", "powers"), [(6, 4), (2, 2), (5, 3), (9, 5)])
def test_runs_equal_plain_search(spark, least, powers):
    rows = list(enumerate(texts(random.Random(least), 400)))
    df = spark.createDataFrame([(i, rng_space(i).join(w)) for i, w in rows], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["text"], r["n_words"]) for r in periodic.periodic_runs(df, least=least, powers=powers).collect()}
    for i, w in rows:
        want = plain_runs(w, least, powers)
        assert got[i] == (want, collapsed(w, want), len(w))


def rng_space(i):
    return [" ", "\n", " \t\r", "\x0b\x0c"][i % 4]


def test_long_text_in_pieces(spark, monkeypatch):
    """A long text whose end repeats 900 words five times, and a word of over a megabyte."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(5000)}" for _ in range(150_000)]
    words += (block := [f"b{rng.randrange(10**6)}" for _ in range(900)]) * 5 + ["x" * (2 << 20)] + ["end"] * 6
    row = periodic.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).head()
    assert [tuple(r) for r in row["runs"]] == [(150_000, 4500, 900), (154_501, 6, 1)]
    assert row["text"] == " ".join([*words[:150_000], *block, words[154_500], "end"])


def test_odd_rows(spark):
    rows = [(None, "a a a a a a b"), (1, None), (2, ""), (3, " \t\n "), (4, "é é é é é é"), (4, "é é é é é é"), (5, "a\xa0a a\xa0a")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, runs string, N_WORDS string")
    got = periodic.periodic_runs(df)
    assert got.columns == ["doc_id", "n_words", "runs", "text"]
    found = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["text"]) for r in got.collect()), key=str)
    assert found == sorted([(None, 7, [(0, 6, 1)], "a b"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 6, [(0, 6, 1)], "é"), (4, 6, [(0, 6, 1)], "é"), (5, 2, [], "a\xa0a a\xa0a")], key=str)
    assert periodic.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="powers"):
        periodic.periodic_runs(df, powers=1)


def test_longest_and_listed(spark):
    df = spark.createDataFrame([([(5, 8, 2), (3, 8, 2), (3, 8, 1)],), ([],)], f"runs {periodic.RUNS}")
    a, b = df.select(periodic.longest(F.col("runs")).alias("best"), periodic.listed(F.col("runs")).alias("text")).collect()
    assert tuple(a["best"]) == (-8, 3, 1) and a["text"] == "5,8,2\n3,8,2\n3,8,1\n" and b["best"] is None and b["text"] == ""


def test_masks_keep_every_run():
    """k is the smallest overlap: a run of exactly the least length survives, and prose does not."""
    assert [periodic.overlap(*x) for x in ((6, 4), (2, 2), (9, 5))] == [5, 1, 8]
    words = np.arange(1000)
    assert not periodic.surviving(words, np.zeros(1000, np.int64), 5).any()
    words[500:506] = 7
    kept = periodic.surviving(words, np.zeros(1000, np.int64), 5)
    assert kept[500:506].all() and kept.sum() == 6
    across = periodic.surviving(np.zeros(8, np.int64), np.array([0] * 4 + [1] * 4), 4)
    assert not across.any()


def test_repeated_tail():
    places = [p for i in range(300) if (p := repeated_tail(i, 100)) is not None]
    assert 15 < len(places) < 50 and all((p <= np.arange(100)).all() for p in places)
    assert repeated_tail(7, 0) is None
