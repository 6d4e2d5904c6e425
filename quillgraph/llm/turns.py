"""Conversation structure repair at the least cost.

Every turn is kept, given another role, or deleted, and turns may be inserted, so that the
roles of a conversation follow the grammar: nothing, or user and assistant in turn, with a
system turn before them or not. The cheapest edits are found by a recursive DuckDB
query inside hash-partitioned batches: each recursion advances one turn for all
conversations of the batch, and keeps for each state of the grammar the least cost and,
at that cost, the least audit (the edits' initials in order).

Two ways to the same turn and state at the same cost never have audits of which one begins
the other, as its further letters could only be insertions, which cost. So the least audit
so far leads to the least audit of all, also over stretches of turns: a conversation is cut
into segments, each segment is solved from every state to every state, and segments are
joined by the same query, so that no task holds a long conversation.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import bounded_batches, durable, partitions, quoted

#: Turns of a segment, segments joined at once, and rows given to one query.
SEGMENT, JOINED, BATCH = 256, 64, 1 << 14
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. What may follow is by role initial.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
#: Insertions that lead from a state to one at which a conversation may end.
TO_END = {0: 0, 1: 2, 2: 1, 3: 0}
INITIALS = ("s", "u", "a")
FINE, DELETED, TRUNCATED = 0, 1, 2
BLANK = r"^[\x20\x09-\x0D]*\z"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
#: The order of a conversation's turns. Nulls come first; rows equal in all of this are equal.
ORDER = ("turn", "role", "h", "h2")


@dataclasses.dataclass(frozen=True)
class Costs:
    """Of a new role, a deletion, an insertion, and of a truncated turn that is not deleted. All but the last must be positive."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def moves(costs: Costs) -> list[tuple[int, int, int, int, str]]:
    """(code, src, dst, cost, letters): what one row allows, insertions before it included. code is fault * 4 + place of the initial."""
    out = []
    for src in NEXT:
        reached = [(src, 0)]
        while (there := NEXT[reached[-1][0]].get("a" if reached[-1][0] == 2 else "u")) not in {s for s, _ in reached}:
            reached.append((there, len(reached)))
        for mid, inserts in reached:
            for fault in (FINE, DELETED, TRUNCATED):
                for k, initial in enumerate((*INITIALS, "")):
                    own = [(mid, costs.delete, "D")]
                    if fault != DELETED:
                        more = costs.truncated * (fault == TRUNCATED)
                        own += [(NEXT[mid][initial], more, "K")] if initial in NEXT[mid] else []
                        own += [(NEXT[mid][r], more + costs.rerole, "R") for r in "ua" if r in NEXT[mid]]
                    out += [(fault * 4 + k, src, dst, cost + inserts * costs.insert, "I" * inserts + letter) for dst, cost, letter in own]
    return out


#: steps: (grp, pos, src, dst, cost, letters); starts: (grp, entry, size, conv, part, seg). Each recursion advances all groups by one place.
SOLVE = """
WITH RECURSIVE reached(grp, entry, pos, state, best) AS (
  SELECT grp, entry, 0, entry, struct_pack(cost := CAST(0 AS BIGINT), audit := '') FROM starts
  UNION ALL
  SELECT r.grp, r.entry, r.pos + 1, s.dst, min(struct_pack(cost := r.best.cost + s.cost, audit := r.best.audit || s.letters))
  FROM reached r JOIN steps s ON s.grp = r.grp AND s.pos = r.pos AND s.src = r.state
  GROUP BY r.grp, r.entry, r.pos, s.dst)
SELECT conv, part, seg, entry, state, best.cost AS cost, best.audit AS audit FROM reached JOIN starts USING (grp, entry) WHERE pos = size"""
STARTS = """
SELECT grp, CAST(unnest(CASE WHEN bool_or(fresh) THEN [0] ELSE [0, 1, 2, 3] END) AS INT) AS entry, max(pos) + 1 AS size,
  any_value(conv) AS conv, any_value(part) AS part, any_value(seg) AS seg FROM placed GROUP BY grp"""
ROW_STEPS = """
SELECT grp, pos, src, dst, m.cost + (n - 1) * {delete} AS cost, m.letters || repeat('D', n - 1) AS letters FROM placed JOIN moves m USING (code)"""
SEGMENT_STEPS = "SELECT grp, pos, src, dst, cost, letters FROM placed"
KEYS = ("conv", "part", "seg")
SEGMENTS = "conv long, part int, seg int, entry int, state int, cost long, audit string"


def solved(steps: str, costs: Costs):
    """For mapInArrow over rows sorted by KEYS (and pos): the least cost and audit of each segment, from every
    state it may be entered in to every state. Whole segments are gathered to BATCH rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        con.execute("CREATE TABLE moves (code INT, src INT, dst INT, cost BIGINT, letters VARCHAR)")
        con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?)", moves(costs))

        def solve(table: pa.Table) -> list[pa.RecordBatch]:
            con.register("held", table)
            con.execute("CREATE OR REPLACE TEMP TABLE placed AS SELECT *, dense_rank() OVER (ORDER BY conv, part, seg) AS grp FROM held")
            con.unregister("held")
            con.execute(f"CREATE OR REPLACE TEMP TABLE starts AS {STARTS}")
            con.execute(f"CREATE OR REPLACE TEMP TABLE steps AS {steps.format(delete=costs.delete)}")
            return con.sql(SOLVE).to_arrow_table().combine_chunks().to_batches()

        kept: list[pa.Table] = []
        for batch in batches:
            now = pa.concat_tables([*kept, pa.Table.from_batches([batch])])
            if len(now) > BATCH:
                key = list(zip(*(now[k].to_pylist() for k in KEYS), strict=True))
                cut = next((k for k in range(len(key) - 1, 0, -1) if key[k - 1] != key[-1]), 0)
                if cut:
                    yield from solve(now.slice(0, cut))
                    now = now.slice(cut).combine_chunks()
            kept = [now]
        if kept and len(kept[0]):
            yield from solve(kept[0])

    return run


def numbered(sorted_rows: DataFrame, schema: str, key: tuple[str, ...], size: int) -> DataFrame:
    """sorted_rows with part, seg, pos and fresh in the stead of key: every `size` distinct keys of a
    conversation, in order, make a segment of the partition. fresh: whether the segment surely is the first
    of its conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, seg, pos, at, fresh = TaskContext.get().partitionId(), object(), -1, 0, object(), False
        for batch in batches:
            segs, places, firsts = [], [], []
            for c, k in zip(batch.column("conv").to_pylist(), zip(*(batch.column(x).to_pylist() for x in key), strict=True), strict=True):
                if c != conv or (k != at and pos + 1 >= size):
                    fresh = c != conv and seg >= 0
                    conv, seg, pos = c, seg + 1, 0
                elif k != at:
                    pos += 1
                at = k
                segs.append(seg)
                places.append(pos)
                firsts.append(fresh)
            kept = [x for x in batch.schema.names if x not in ("part", "seg", "fresh", "pos")]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), pa.array([part] * len(segs), pa.int32()), pa.array(segs, pa.int32()), pa.array(places, pa.int32()), pa.array(firsts, pa.bool_())], [*kept, "part", "seg", "pos", "fresh"])

    return sorted_rows.mapInArrow(run, f"{schema}, part int, seg int, pos int, fresh boolean")


def turn_rows(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, h, h2): nulls of role and text as one space; h and h2 stand for the text."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(" "))
    return conversations.select(
        quoted(conv_col).cast("long").alias("conv"), quoted(turn_col).cast("long").alias("turn"), F.coalesce(quoted(role_col).cast("string"), F.lit(" ")).alias("role"),
        text.alias("text"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(7), text).alias("h2"))


def beside(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """a joined to b on columns of these names, of which nulls are equal."""
    renamed = b.withColumnsRenamed({n: f"{n}_of_b" for n in names})
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"{n}_of_b"))
    return a.join(renamed, on, how).drop(*(f"{n}_of_b" for n in names))


def judged(rows: DataFrame) -> DataFrame:
    """Distinct rows of a conversation without their text: (conv, turn, role, h, h2, n, fault, repeated), n: how
    often the row stands, repeated: whether an earlier turn has its role and text."""
    light = rows.select("conv", "turn", "role", "h", "h2", F.col("text").rlike(BLANK).alias("blank"), (~F.col("text").rlike(ENDED)).alias("cut"))
    each = light.groupBy("conv", "turn", "role", "h", "h2", "blank", "cut").agg(F.count("*").alias("n"))
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = each.groupBy("conv", "role", "h", "h2").agg(F.min(at).alias("first"))
    return beside(each, first, ["conv", "role", "h", "h2"]).select("conv", "turn", "role", "h", "h2", "n", "blank", "cut", (at != F.col("first")).alias("repeated"))


def audits(rows: DataFrame, costs: Costs) -> DataFrame:
    """(conv, blank, duplicate, truncated, cost, audit) of each conversation of turn_rows."""
    spark = rows.sparkSession
    found = durable(judged(rows))
    once = ~F.col("blank") & ~F.col("repeated")
    counts = found.groupBy("conv").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.when(F.col("repeated"), F.col("n")).otherwise(F.col("n") - 1)).otherwise(0)).alias("duplicate"),
        F.sum(F.when(once & F.col("cut"), 1).otherwise(0)).cast("long").alias("truncated"))
    fault = F.when(~once, DELETED).when(F.col("cut"), TRUNCATED).otherwise(FINE)
    initial = F.lit(len(INITIALS))
    for k, x in enumerate(INITIALS):
        initial = F.when(F.substring("role", 1, 1) == x, k).otherwise(initial)
    light = found.select("conv", *ORDER, F.col("n").cast("long").alias("n"), (fault * 4 + initial).cast("int").alias("code"))
    lined = light.repartitionByRange(partitions(spark), "conv", *ORDER).sortWithinPartitions("conv", *ORDER)
    dealt = numbered(lined, "conv long, turn long, role string, h long, h2 long, n long, code int", ORDER, SEGMENT)
    now = durable(dealt.drop(*ORDER).repartition(partitions(spark), *KEYS).sortWithinPartitions(*KEYS, "pos").mapInArrow(solved(ROW_STEPS, costs), SEGMENTS))
    done = None
    while True:
        of = durable(now.select(*KEYS).distinct().groupBy("conv").agg(F.count("*").alias("segments")))
        finished = beside(now, of.filter("segments = 1").select("conv"), ["conv"], "left_semi")
        done = finished if done is None else done.unionByName(finished)
        most, left = of.filter("segments > 1").agg(F.max("segments"), F.sum("segments")).head()
        if not most:
            break
        rest = beside(now, of.filter("segments > 1").select("conv"), ["conv"], "left_semi")
        rest = rest.select(*KEYS, F.col("entry").alias("src"), F.col("state").alias("dst"), "cost", F.col("audit").alias("letters"))
        # what lies side by side is joined; few partitions cut through a conversation, none through one of few segments
        few = most <= JOINED
        lined = rest.repartition(partitions(spark), "conv") if few else rest.repartitionByRange(min(partitions(spark), 1 + left // JOINED**2), *KEYS)
        dealt = numbered(lined.sortWithinPartitions(*KEYS), "conv long, src int, dst int, cost long, letters string", ("part", "seg"), JOINED)
        now = durable((dealt if few else dealt.repartition(partitions(spark), *KEYS).sortWithinPartitions(*KEYS, "pos")).mapInArrow(solved(SEGMENT_STEPS, costs), SEGMENTS))
    inserts = F.lit(0)
    for state, k in TO_END.items():
        inserts = F.when(F.col("state") == state, k).otherwise(inserts)
    ends = done.filter("entry = 0").select("conv", F.struct((F.col("cost") + inserts * costs.insert).alias("cost"), F.concat("audit", F.repeat(F.lit("I"), inserts)).alias("audit")).alias("best"))
    best = ends.groupBy("conv").agg(F.min("best").alias("best"))
    return beside(counts, best, ["conv"]).select("conv", "blank", "duplicate", "truncated", "best.cost", "best.audit")


class Walk:
    """Goes through one conversation's rows in order, beside its audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0
        self.before, self.illegal, self.turns, self.first, self.last = None, 0, 0, None, None

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self.placed(None), ""

    def placed(self, role: str | None) -> str:
        role = ("assistant" if self.state == 2 else "user") if role is None else role
        self.state = NEXT[self.state][role[:1]]
        return role

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple[str, str]]:
        """The repaired turns that this row makes, insertions before it included."""
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.turns, self.last = self.turns + 1, turn
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            yield self.placed(role if letter == "K" else None), text

    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.turns


def walked(conversations: DataFrame, every: DataFrame | None, costs: Costs, columns: tuple[str, str, str, str], run, schema: str) -> DataFrame:
    """run over rows (conv, kind, turn, role, text, counts, cost, audit) in which a row of kind 0 with the audit stands before its conversation's turns."""
    spark = conversations.sparkSession
    bounded_batches(spark)
    rows = turn_rows(conversations, *columns)
    told = durable(audits(rows, costs))
    if every is not None:
        ids = every.select(quoted(columns[0]).cast("long").alias("conv")).distinct()
        told = beside(ids, told, ["conv"], "left").select("conv", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("blank", "duplicate", "truncated", "cost")), F.coalesce("audit", F.lit("")).alias("audit"))
    heads = told.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("h2"), F.lit("").alias("text"), "blank", "duplicate", "truncated", "cost", "audit")
    nothing = [F.lit(0).cast("long").alias(x) for x in ("blank", "duplicate", "truncated", "cost")]
    lines = rows.select("conv", F.lit(1).alias("kind"), "turn", "role", "h", "h2", "text", *nothing, F.lit("").alias("audit"))
    lined = heads.unionByName(lines).repartition(partitions(spark), "conv").sortWithinPartitions("conv", "kind", *ORDER)
    return lined.select("conv", "kind", "turn", "role", "text", "blank", "duplicate", "truncated", "cost", "audit").mapInArrow(run, schema)


def repair(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", costs: Costs = Costs(), every: DataFrame | None = None) -> DataFrame:
    """(conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each conversation.

    A conversation's rows are taken by turn (nulls first), then role, then a hash of the text;
    equal rows stay side by side. Nulls of role and text count as one space; a null id is a
    conversation of its own. Each row's first fault counts: blank (nothing but
    \\x20 and \\x09-\\x0D), duplicate (role and text of an earlier row), truncated (its last other character is none of
    `.!?`). Blank rows and duplicates must be deleted. An empty role has no initial and is never kept.
    gaps: turns missing between the smallest and the largest. illegal: neighbours whose
    role initials are none of su, ua, au. repaired_sha256: of the repaired `role:text`, joined by
    newlines. every: a table whose conversations are reported even if no row of theirs is left, with
    zeros, an empty audit and the hash of nothing. Audits are as long as their conversations; texts of one
    conversation go through one task, a batch at a time, since a hash reads them in order.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = head = digest = None
        begun = False

        def add(turns: Iterator[tuple[str, str]]) -> None:
            nonlocal begun
            for role, text in turns:
                digest.update((b"\n" if begun else b"") + role.encode() + b":" + text.encode())
                begun = True

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), [pa.int64()] * 7 + [pa.string()] * 2, strict=True)], ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])

        def ended() -> tuple:
            add(walk.inserted())
            return (head[0], walk.gaps(), *head[1:4], walk.illegal, head[4], walk.audit, digest.hexdigest())

        for batch in batches:
            out = []
            for conv, kind, turn, role, text, blank, duplicate, truncated, cost, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    if walk:
                        out.append(ended())
                    walk, head, digest, begun = Walk(audit), (conv, blank, duplicate, truncated, cost), hashlib.sha256(), False
                else:
                    add(walk.row(turn, role, text))
            if out:
                yield told(out)
        if walk:
            yield told([ended()])

    schema = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return walked(conversations, every, costs, (conv_col, turn_col, role_col, text_col), run, schema).withColumnRenamed("conv", conv_col)


def repaired_turns(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", costs: Costs = Costs()) -> DataFrame:
    """(conv_col, turn_col, role_col, text_col): the repaired conversations of repair(), turns numbered from 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = conv = None
        number = 0

        def numbered_turns(turns: Iterator[tuple[str, str]]) -> Iterator[tuple]:
            nonlocal number
            for role, text in turns:
                yield conv, number, role, text
                number += 1

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)], ["conv", "turn", "role", "text"])

        for batch in batches:
            out = []
            for c, kind, turn, role, text, *_, audit in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if kind == 0:
                    out += numbered_turns(walk.inserted()) if walk else []
                    walk, conv, number = Walk(audit), c, 0
                else:
                    out += numbered_turns(walk.row(turn, role, text))
            if out:
                yield told(out)
        if walk and (out := list(numbered_turns(walk.inserted()))):
            yield told(out)

    out = walked(conversations, None, costs, (conv_col, turn_col, role_col, text_col), run, "conv long, turn long, role string, text string")
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("text").alias(text_col))
