"""Conversation repair against every possible edit of short conversations, and a plain search of long ones."""

import hashlib
import heapq
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import turns
from quillgraph.llm.queries import damaged

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(SPACES)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def options(row, fault):
    """(cost, letter, repaired turns) of one row."""
    role, text = row
    yield 2, "D", []
    if fault not in ("blank", "duplicate"):
        more = 5 * (fault == "truncated")
        yield more, "K", [(role, text)]
        for r in ("user", "assistant"):
            yield more + 1, "R", [(r, text)]


def every_edit(rows):
    """The least (cost, audit, turns) over all edits, with up to two insertions in each place."""
    places = [[(0, "", [])] + [(5 * n, "I" * n, [(r, "") for r in x]) for n in (1, 2) for x in itertools.product(("user", "assistant"), repeat=n)]]
    for row, fault in zip(rows, faults(rows), strict=True):
        places += [list(options(row, fault)), places[0]]
    best = None
    for choice in itertools.product(*places):
        cost, audit = sum(c[0] for c in choice), "".join(c[1] for c in choice)
        if best is None or (cost, audit) < best[:2]:
            out = [t for c in choice for t in c[2]]
            if all(r for r, _ in out) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out)):
                best = (cost, audit, out)
    return best


def searched(rows):
    """The same by a search over (row, state) in order of (cost, audit)."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    marks, heap, done = faults(rows), [(0, "", 0, "", [])], set()
    while heap:
        cost, audit, k, state, out = heapq.heappop(heap)
        if k == len(rows) and state in ("", "a"):
            return cost, audit, out
        if (k, state) in done:
            continue
        done.add((k, state))
        if k < len(rows):
            for c, letter, made in options(rows[k], marks[k]):
                if not made or made[0][0][:1] and made[0][0][0] in follows[state]:
                    heapq.heappush(heap, (cost + c, audit + letter, k + 1, made[0][0][0] if made else state, out + made))
        for r in ("user", "assistant"):
            if r[0] in follows[state]:
                heapq.heappush(heap, (cost + 5, audit + "I", k, r[0], [*out, (r, "")]))


def expected(rows, solve):
    """rows: (turn, role, text) in order."""
    known = [t for t, _, _ in rows if t is not None]
    pairs = [(r or " ", x if x is not None else " ") for _, r, x in rows]
    marks = faults(pairs)
    cost, audit, out = solve(pairs)
    return {
        "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0, **{k: marks.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs)), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()}


def compare(spark, conversations, solve):
    rows = [(c, *r) for c, own in conversations.items() for r in own]
    random.Random(1).shuffle(rows)
    got = {r["conv_id"]: r.asDict() for r in turns.repair(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert set(got) == set(conversations)
    for c, own in conversations.items():
        assert {k: v for k, v in got[c].items() if k != "conv_id"} == expected(own, solve), (c, own)


TEXTS = ["Fine.", "Well said!", "cut off", "", " \n", "Why?", "é."]


def conversation(rng, n, roles=("system", "user", "assistant")):
    return [(k + 2 * (k > 3), rng.choice(roles), rng.choice(TEXTS)) for k in range(n)]


def test_every_edit_of_short_conversations(spark):
    rng = random.Random(3)
    made = {k: conversation(rng, rng.randint(1, 3), ("system", "user", "assistant", "unknown", "tool", "")) for k in range(60)}
    compare(spark, made, every_edit)
    for own in made.values():
        pairs = [(r or " ", t) for _, r, t in own]
        assert searched(pairs)[:2] == every_edit(pairs)[:2]


def test_plain_search_of_longer_conversations(spark):
    rng = random.Random(4)
    compare(spark, {k: conversation(rng, rng.randint(1, 30)) for k in range(40)}, searched)


@pytest.mark.parametrize(("segment", "joined"), [(2, 2), (3, 4)])
def test_segments_and_their_joins(spark, monkeypatch, segment, joined):
    """Segments of few turns, joined in several rounds, lead to the same audits."""
    monkeypatch.setattr(turns, "SEGMENT", segment)
    monkeypatch.setattr(turns, "JOINED", joined)
    rng = random.Random(segment)
    made = {k: [(t, r, x if x.strip() == "" else f"{t % 50}{x}") for t, r, x in conversation(rng, n)] for k, n in enumerate((1, 2, 7, 40, 150))}
    compare(spark, made, searched)


def test_one_long_conversation(spark):
    rng = random.Random(6)
    compare(spark, {1: [(k, rng.choice(("user", "assistant")), f"{k} words" + rng.choice(("", ".", "!"))) for k in range(3000)], 2: conversation(rng, 4)}, searched)


def test_odd_rows(spark):
    made = {
        None: [(0, "user", "Hello."), (1, "assistant", "Hi.")], 1: [(None, "assistant", "One."), (None, "user", "Two."), (3, "assistant", "Three.")],
        2: [(0, None, None)], 3: [(0, "user", "Twice."), (0, "user", "Twice."), (0, "user", "Twice."), (1, "assistant", "x" * (3 << 20) + ".")], 4: [(9, "", "Text.")], 5: [(-3, "system", "s."), (5, "user", "u.")]}
    compare(spark, made, searched)
    rows = [(c, *r, "x", "y") for c, own in made.items() for r in own]
    df = spark.createDataFrame(rows, f"{SCHEMA}, audit string, COST string")
    got = turns.repair(df)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"] and got.count() == len(made)
    assert turns.repair(df.limit(0)).count() == 0
    none = {r["conv_id"]: r for r in turns.repair(df.filter("conv_id = 5"), every=df).collect()}
    assert set(none) == set(made) and none[1]["audit"] == "" and none[1]["repaired_sha256"] == hashlib.sha256(b"").hexdigest() and none[1]["cost"] == 0


def test_repaired_turns(spark):
    rng = random.Random(8)
    made = {k: conversation(rng, rng.randint(1, 12)) for k in range(30)}
    rows = [(c, *r) for c, own in made.items() for r in own]
    got = {}
    for r in sorted(turns.repaired_turns(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: (r["conv_id"], r["turn"])):
        got.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    for c, own in made.items():
        assert got.get(c, []) == [(k, *x) for k, x in enumerate(searched([(r, t) for _, r, t in own])[2])]


def test_dear_deletions_make_insertions(spark):
    """Other costs: turns are inserted where deleting is dearer."""
    df = spark.createDataFrame([(1, 0, "user", "One."), (1, 1, "user", "Two."), (2, 0, "system", "S.")], SCHEMA)
    got = {r["conv_id"]: (r["cost"], r["audit"]) for r in turns.repair(df, costs=turns.Costs(rerole=9, delete=50, insert=1)).collect()}
    assert got == {1: (2, "KIKI"), 2: (2, "KII")}


def test_damage(spark):
    df = spark.createDataFrame([(k, t, "assistant", "A. B!") for k in range(50) for t in range(8)] + [(None, None, None, None)], SCHEMA)
    rows = {}
    for r in damaged(df).collect():
        rows.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"]))
    import zlib

    for k in range(50):
        for t in range(8):
            c = zlib.crc32(f"{k}:{t}".encode()) % 20
            want = {0: [], 1: [("assistant", "")], 2: [("assistant", "A B")], 3: [("assistant", "A. B!")] * 2, 4: [("user", "A. B!")]}.get(c, [("assistant", "A. B!")])
            assert rows.get((k, t), []) == want
    assert damaged(df).filter(F.col("role").isNull() | F.col("text").isNull()).count() == 0
