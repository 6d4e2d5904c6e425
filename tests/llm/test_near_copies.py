"""Near copies where texts repeat themselves, and where many lie close together."""

import random
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from quillgraph.llm import near_copies  # noqa: E402

SCHEMA = "doc_id long, text string"


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def grouped(spark, rows):
    got = {r["doc_id"]: r["group"] for r in near_copies.near_copy_groups(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    return {i: got.get(i, i) for i, _ in rows}


def test_repetition_neither_joins_nor_parts(spark):
    """A much repeated word or sentence fixes no bit of a set's fingerprint: texts that share little
    else stay, and copies that repeat a sentence are found."""
    rng = random.Random(1)
    own, sentence = words(rng, 100), "a sentence of nine words stands in both texts"
    rows = [
        (1, "spam " * 200 + " ".join(words(rng, 80))), (2, "spam " * 200 + " ".join(words(rng, 80))), (3, " ".join(own) + " " + sentence),
        (4, " ".join(own) + f" {sentence}" * 30), (5, f"{sentence}\n" * 100 + " ".join(words(rng, 60))), (6, f"{sentence}\n" * 100 + " ".join(words(rng, 60)))]
    assert grouped(spark, rows) == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6}
    kept = near_copies.one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 5, 6}


def test_half_of_the_texts_repeat_a_line(spark):
    """No removal below 0.8, and nearly all pairs from 0.8 on."""
    rng = random.Random(2)
    lines = [" ".join(words(rng, 9)) for _ in range(3)]
    rows = []
    for k in range(150):
        base = words(rng, rng.randint(30, 120))
        copies = [base]
        for _ in range(k % 3):
            other = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 30))):
                other[rng.randrange(len(other))] = "changed"
            copies.append(other)
        for c in copies:
            rows.append((len(rows), " ".join(c) + f"\n{rng.choice(lines)}" * (rng.choice((1, 40, 90)) if k % 2 else 0)))
    want, got = brute.similar_groups(rows), grouped(spark, rows)
    removed, due = {i for i, g in got.items() if g != i}, {i for i, g in want.items() if g != i}
    assert len(due) > 40 and removed <= due and len(removed) >= 0.97 * len(due)


def test_many_near_ones(spark):
    """Hundreds of edits of one text in one dense place, some at the limit: those that the first links leave out are tested too."""
    rng = random.Random(3)
    base = words(rng, 150)
    rows = [(0, " ".join(base))]
    for k in range(1, 150):
        own = list(base)
        for at in rng.sample(range(150), rng.choice((1, 1, 2, 4))):
            own[at] = f"x{k}"
        rows.append((k, " ".join(own)))
    want, got = brute.similar_groups(rows), grouped(spark, rows)
    removed, due = {i for i, g in got.items() if g != i}, {i for i, g in want.items() if g != i}
    assert len(due) < len(rows) - 1 and removed <= due and len(removed) >= 0.97 * len(due)


def test_left_out_pairs_are_found_again():
    """Every pair of a run within the distances whose groups differ, whatever the pieces."""
    rng = np.random.default_rng(4)
    n = 1300
    centre = rng.integers(0, 1 << 63, near_copies.WORDS, dtype=np.uint64)
    fps = np.tile(centre, (n, 1))
    for row in fps:
        for bit in rng.choice(256, rng.integers(0, 30), replace=False):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    cells, groups = np.repeat([1, 2], [900, 400]), rng.integers(0, 3, n)
    far = np.bitwise_count(fps[:, None] ^ fps[None, :]).sum(axis=2)
    due = {(i, j) for i, j in zip(*np.nonzero((far <= 20) & (groups[:, None] != groups[None, :]) & (cells[:, None] == cells[None, :])), strict=True) if i < j}
    got = list(zip(*near_copies.links_between(cells, fps, groups, 20), strict=True))
    assert len(due) > 100 and set(got) == due and len(got) == len(due)
