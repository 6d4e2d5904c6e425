"""SimHash groups of near copies at a wide radius.

Two texts with a shingle similarity of 0.8 differ in about 15 % of their fingerprint
bits. Probing every neighbouring cell within such a radius would take more cells than
there are texts. So the segment-popcount grid is cut into many tables, each on other
segments: near copies share the home cell of some table (a documented miss rate
bounds how many do not), rows of a cell are filtered by the Manhattan distance of
their bit counts and then by their Hamming distance. What passes is a candidate:
only the exact similarity of the shingle sets links it.

Fingerprints are those of the sets, as the similarity is: a shingle counts once however
often a text repeats it. Only texts of equal sets collapse unseen. In dense cells a few
candidates for each row are tested first; what they leave out is tested afterwards,
unless its ends have come together by then.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import bounded_batches, components, durable, partitions, quoted
from quillgraph.llm.contamination import fitted
from quillgraph.llm.simhash import beside_hot, majority, shingles

#: 64-bit words of a fingerprint; segments are pairs of bits.
WORDS = 4
SEGMENTS = 32 * WORDS
#: Share of fingerprint bits that differ, on average, between texts at the limit (a shingle similarity of 0.8).
LIMIT = 0.1515
#: Bits that one segment tells unrelated texts apart by, and those left to the rows of a cell.
TELLS, ROOM = 1.415, 7
#: Tables searched at once.
BATCH = 12
PAIRWISE = 16
#: Rows of a cell compared all with all at first, and how many near ones a row may have there for all its links to be tested at first.
PIECE, NEAREST = 512, 4


def spread(h: np.ndarray) -> np.ndarray:
    """WORDS hash words from one, by the splitmix64 finaliser."""
    out = np.empty((len(h), WORDS), np.uint64)
    for k in range(WORDS):
        x = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def hashed(text: bytes | None, width: int) -> np.ndarray:
    """The hashes of the text's distinct shingles, sorted."""
    found = shingles(text or b"", width)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in found), np.uint64, len(found)))


def set_key(hashes: np.ndarray) -> bytes:
    """Texts of equal sets of shingles have equal keys, of 128 bits."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    return majority(spread(hashes)).tobytes()


def similar(x: bytes, y: bytes, share: float) -> bool:
    """Whether two sorted sets of hashes have a Jaccard similarity of share or more."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if min(len(x), len(y)) < share * max(len(x), len(y)) - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= share * (len(x) + len(y) - both) - 1e-9


def outline(own: np.ndarray) -> bytes:
    """The size of a set of hashes and a bitmap of their low bits, eight bits for each hash or more."""
    bits = np.zeros(max(64, 1 << (8 * len(own) - 1).bit_length() if len(own) else 0), bool)
    bits[own & np.uint64(len(bits) - 1)] = True
    return np.uint32(len(own)).tobytes() + np.packbits(bits, bitorder="little").tobytes()


def ceiling(x: bytes, y: bytes) -> float:
    """The largest Jaccard similarity that sets of these outlines can have: a bit that one
    alone has stands for an element, at least, that the other lacks."""
    n, m = (int(np.frombuffer(z, np.uint32, 1)[0]) for z in (x, y))
    p, q = (np.frombuffer(z, np.uint8, -1, 4) for z in (x, y))
    while len(p) != len(q):  # low bits number the places: halves lie over each other
        p, q = (z[: len(z) // 2] | z[len(z) // 2 :] if len(z) > min(len(p), len(q)) else z for z in (p, q))
    both = min(n - int(np.bitwise_count(p & ~q).sum()), m - int(np.bitwise_count(q & ~p).sum()))
    return both / (n + m - both) if n + m > both else 1.0


def verified(rows: DataFrame, edges: DataFrame, width: int, share: float, before: DataFrame | None = None, rounds: int = 2) -> DataFrame:
    """(a, b) of edges (a, b, x, y) whose shingle sets are similar, as many as it takes to connect what all similar
    ones connect. rows: (doc, text); x and y are the keys of a's and b's sets; before: edges known to be similar.

    Outlines of the sets, an eighth of their size, turn away the pairs that cannot be
    similar. Then each group of texts tests its most promising link to another, `rounds`
    times over, and at last every link that would still join two groups is tested.
    """
    spark = rows.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [hashed(t, width) for t in batch[1].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[0], *(pa.array(x, pa.binary()) for x in ([set_key(h) for h in sets], [h.tobytes() for h in sets], [outline(h) for h in sets]))], ["doc", "key", "own", "outline"])

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = np.array([ceiling(x, y) for x, y in zip(batch[4].to_pylist(), batch[5].to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in range(4)), pa.array(1 - most)], ["a", "b", "x", "y", "far"]).filter(pa.array(most >= share - 1e-9))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = [similar(x, y, share) for x, y in zip(batch[2].to_pylist(), batch[3].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch[0], batch[1]], ["a", "b"]).filter(pa.array(fine, pa.bool_()))

    wanted = durable(edges.select(F.col("a").alias("doc"), F.col("x").alias("key")).union(edges.select("b", "y")).distinct())
    docs = wanted.select("doc").distinct()
    texts = rows.join(fitted(docs, docs.count()), "doc", "left_semi").select("doc", "text")
    bounded_batches(spark)
    sets = durable(texts.mapInArrow(read, "doc long, key binary, own binary, outline binary").join(wanted, ["doc", "key"], "left_semi").dropDuplicates(["key"]).select("key", "own", "outline"))

    def beside(e: DataFrame, what: str) -> DataFrame:
        left, right = sets.select(F.col("key").alias("x"), F.col(what).alias("s")), sets.select(F.col("key").alias("y"), F.col(what).alias("t"))
        return e.join(left.hint("merge"), "x").join(right.hint("merge"), "y")

    def tested(e: DataFrame) -> DataFrame:
        return durable(beside(e, "own").select("a", "b", "s", "t").mapInArrow(judge, "a long, b long"))

    def apart(e: DataFrame, sure: DataFrame | None) -> DataFrame:
        """Links that would join two groups of the sure ones, with these."""
        if sure is None:
            return e.select("*", F.col("a").alias("a_group"), F.col("b").alias("b_group"))
        groups = components(sure)
        of = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"{c}_group"))
        found = e.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return found.select("a", "b", "x", "y", "far", F.coalesce("a_group", "a").alias("a_group"), F.coalesce("b_group", "b").alias("b_group")).filter("a_group <> b_group")

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1 << 12)  # bounded by bytes as well
    sifted = durable(beside(edges, "outline").select("a", "b", "x", "y", "s", "t").mapInArrow(sift, "a long, b long, x binary, y binary, far double"))
    sure = before
    left = durable(apart(sifted, sure))
    number = left.count()
    for k in range(rounds + 1):
        if not number:
            break
        ends = left.select(F.col("a_group").alias("node"), "far", "a", "b", "x", "y").union(left.select("b_group", "far", "a", "b", "x", "y"))
        now = ends.groupBy("node").agg(F.min(F.struct("far", "a", "b", "x", "y")).alias("e")).select("e.a", "e.b", "e.x", "e.y").distinct()
        if k == rounds:
            now = left.select("a", "b", "x", "y")
        found = tested(now)
        sure = found if sure is None else sure.union(found)
        if k == rounds:
            break
        left = durable(apart(left.drop("a_group", "b_group").join(now.select("x", "y"), ["x", "y"], "left_anti"), sure))
        number = left.count()
    bounded_batches(spark)
    return edges.select("a", "b").limit(0) if sure is None else sure


def thermometer(fps: np.ndarray) -> np.ndarray:
    """Each pair of bits sorted: the bit count of an XOR is then the Manhattan distance of segment counts."""
    low = np.uint64(0x5555555555555555)
    high = fps >> np.uint64(1)
    return ((fps | high) & low) | ((fps & high & low) << np.uint64(1))


def tables(n: int, miss: float, radius: int) -> tuple[int, int]:
    """(segments in a cell, number of tables) for n texts: a cell holds some hundred
    unrelated texts whatever n is, and a pair at the limit is missed at a rate of miss
    at most, be it beyond the radius or in no table. The distance of such a pair
    scatters, and what lies farther apart meets less often, so each distance counts apart."""
    k = max(8, round((math.log2(max(n, 2)) - ROOM) / TELLS))
    bits = 2 * SEGMENTS
    chance = [math.comb(bits, d) * LIMIT**d * (1 - LIMIT) ** (bits - d) for d in range(radius + 1)]
    beyond = 1 - sum(chance)
    if beyond >= miss:
        raise ValueError("the radius alone misses more than miss")
    meet = [((1 - d / bits) ** 2 + (d / bits) ** 2 / 2) ** k for d in range(radius + 1)]
    count = 1
    while beyond + sum(p * (1 - m) ** count for p, m in zip(chance, meet, strict=True)) > miss:
        count += 1
    return k, count


def least_forest(n: int, x: np.ndarray, y: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Places of links that connect what all links connect, by the shortest (Borůvka's
    rounds: each tree takes its shortest link to another). Links are given both ways."""
    order = np.argsort(far, kind="stable")
    tree, taken = np.arange(n), []
    while len(order := order[tree[x[order]] != tree[y[order]]]):
        _, first = np.unique(tree[x[order]], return_index=True)
        taken.append(order[first])
        a, b = tree[x[taken[-1]]], tree[y[taken[-1]]]
        root = np.arange(n)
        while True:
            before = root.copy()
            np.minimum.at(root, a, root[b])
            np.minimum.at(root, b, root[a])
            root = root[root]
            if (root == before).all():
                break
        tree = root[tree]
    return np.concatenate(taken) if taken else np.empty(0, np.int64)


def near_pairs(codes: np.ndarray, fps: np.ndarray, p: slice, q: slice, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a row of p and one of q within the radius."""
    x, y = np.nonzero(sum(np.bitwise_count(codes[p, None, w] ^ codes[None, q, w]).astype(np.uint16) for w in range(WORDS)) <= radius)
    x, y = x + p.start, y + q.start
    fine = np.bitwise_count(fps[x] ^ fps[y]).sum(axis=1) <= radius
    return x[fine], y[fine]


def nearest_in_cell(fps: np.ndarray, codes: np.ndarray, ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a run to test at first: the pairs within the radius of rows that have NEAREST of them at
    most, and among the others the shortest that connect them. Runs beyond PIECE
    rows are compared in pieces, which differ from table to table, and their middle
    row with all. Rows of which a pair is left out, in a piece or between two, get a link to themselves."""
    a, b, left = [], [], np.zeros(len(ids), bool)
    for at in range(0, len(ids), PIECE):
        own, f = codes[at : at + PIECE], fps[at : at + PIECE]
        for other in range(at + PIECE, len(ids), PIECE):
            x, y = near_pairs(codes, fps, slice(at, at + PIECE), slice(other, other + PIECE), radius)
            left[x] = left[y] = True
        lower = sum(np.bitwise_count(own[:, None, w] ^ own[None, :, w]).astype(np.uint16) for w in range(WORDS))
        np.fill_diagonal(lower, radius + 1)
        x, y = np.nonzero(lower <= radius)
        far = np.bitwise_count(f[x] ^ f[y]).sum(axis=1)
        x, y, far = x[far <= radius], y[far <= radius], far[far <= radius]
        if not len(x):
            continue
        few = np.bincount(x, minlength=len(own)) <= NEAREST
        kept = few[x] | few[y]
        kept[least_forest(len(own), x, y, far)] = True
        left[at + x[~kept]] = True
        x, y = np.minimum(x, y)[kept], np.maximum(x, y)[kept]
        pairs = np.unique(x * PIECE + y)
        a.append(ids[at + pairs // PIECE])
        b.append(ids[at + pairs % PIECE])
    if len(ids) > PIECE:
        bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        middle = np.packbits(2 * bits > len(ids), bitorder="little").view(np.uint64)
        hub = int(np.bitwise_count(fps ^ middle).sum(axis=1).argmin())
        beside = np.flatnonzero(np.bitwise_count(fps ^ fps[hub]).sum(axis=1) <= radius)
        beside = beside[beside != hub]
        a.append(np.repeat(ids[hub], len(beside)))
        b.append(ids[beside])
    return np.concatenate([*a, ids[left]]), np.concatenate([*b, ids[left]])


def runs(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, size) of each run of equal cells."""
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    return first, np.diff(np.append(first, len(cells)))


def cell_links(cells: np.ndarray, fps: np.ndarray, ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges within runs of equal cells. Pairs of small runs are compared all at once."""
    codes = thermometer(fps)
    first, size = runs(cells)
    a, b = [ids[:0]], [ids[:0]]
    own = np.repeat(size, size)
    for gap in range(1, min(PAIRWISE, int(size.max(initial=0)))):
        i = np.flatnonzero((cells[gap:] == cells[:-gap]) & (own[gap:] <= PAIRWISE))
        i = i[np.bitwise_count(codes[i] ^ codes[i + gap]).sum(axis=1) <= radius]
        i = i[np.bitwise_count(fps[i] ^ fps[i + gap]).sum(axis=1) <= radius]
        a.append(ids[i])
        b.append(ids[i + gap])
    for at, n in zip(first[size > PAIRWISE].tolist(), size[size > PAIRWISE].tolist(), strict=True):
        x, y = nearest_in_cell(fps[at : at + n], codes[at : at + n], ids[at : at + n], radius)
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def links_between(cells: np.ndarray, fps: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of a run within the radius whose groups differ."""
    first, size = runs(cells)
    codes, a, b = thermometer(fps), [first[:0]], [first[:0]]
    for at, n in zip(first.tolist(), size.tolist(), strict=True):
        for i in range(at, at + n, PIECE) if (groups[at : at + n] != groups[at]).any() else ():
            for j in range(i, at + n, PIECE):
                x, y = near_pairs(codes, fps, slice(i, min(i + PIECE, at + n)), slice(j, min(j + PIECE, at + n)), radius)
                fine = (groups[x] != groups[y]) & ((x < y) | (i < j))
                a.append(x[fine])
                b.append(y[fine])
    return np.concatenate(a), np.concatenate(b)


def near_copy_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 56, miss: float = 0.03, share: float = 0.8) -> DataFrame:
    """(id_col, group) for ids that have copies or near copies: group is the
    smallest id of theirs.

    Near copies are texts whose sets of word shingles have a Jaccard similarity of share
    or more; chains of them form one group. Candidates are texts whose 256-bit
    fingerprints, of the sets, differ in radius bits or fewer: a similarity of 0.8 makes 39 bits on
    average, give or take 6, so 56 leaves out next to none. Pairs at the limit are
    missed at a rate of miss, closer ones and groups less often. How often a text repeats a
    shingle does not matter. Texts of equal sets collapse first; every other link is tested
    by the sets, and every candidate is tested unless its ends are in one group by other
    links. Blank texts are copies of each other.
    Rows with a null id take no part; rows sharing an id are one document.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [hashed(t, width) for t in batch[1].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array([set_key(h) for h in sets], pa.binary()), pa.array([wide_fingerprint(h) for h in sets], pa.binary())], ["doc", "key", "fp"])

    rows = docs.select(quoted(id_col).cast("long").alias("doc"), quoted(text_col).cast("string").alias("text")).filter("doc is not null")
    found = durable(rows.mapInArrow(read, "doc long, key binary, fp binary"))
    reps = durable(found.groupBy("key", "fp").agg(F.min("doc").alias("rep")))
    number = reps.count()
    k, count = tables(number, miss, radius)
    rng = np.random.default_rng(5)
    chosen = [rng.choice(SEGMENTS, k, replace=False) for _ in range(count)]

    def placed(start: int, batch_tables: int):
        """(cell, fp, …) of some tables, with the other columns as they are."""
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fps = np.frombuffer(b"".join(batch[0].to_pylist()), np.uint64).reshape(len(batch[0]), WORDS)
                bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little").reshape(len(fps), SEGMENTS, 2).sum(axis=2, dtype=np.int64)
                for number, own in enumerate(chosen[start : start + batch_tables], start):
                    cell = (bits[:, own] @ (3 ** np.arange(k, dtype=np.int64))) * count + number
                    yield pa.RecordBatch.from_arrays([pa.array(cell), *batch.columns], ["cell", *batch.schema.names])

        return place

    def linked(pairs):
        """pairs(cells, fps, table) gives places of a table's rows, whose cells are whole and in order."""
        def out(table: pa.Table) -> pa.RecordBatch:
            fps = np.frombuffer(b"".join(table["fp"].to_pylist()), np.uint64).reshape(len(table), WORDS)
            # a cell's rows in an order of its table's own
            cells = table["cell"].to_numpy()
            order = np.lexsort(((fps[:, 0] ^ cells.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15), cells))
            table = table.take(pa.array(order))
            reps, keys = table["rep"].to_numpy(), table["key"].to_numpy()
            i, j = pairs(cells[order], np.ascontiguousarray(fps[order]), table)
            i, j = np.where(reps[i] < reps[j], i, j), np.where(reps[i] < reps[j], j, i)
            return pa.RecordBatch.from_arrays([pa.array(reps[i]), pa.array(reps[j]), pa.array(keys[i], pa.binary()), pa.array(keys[j], pa.binary())], ["a", "b", "x", "y"])

        def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: list[pa.Table] = []
            for batch in batches:
                now = pa.concat_tables([*kept, pa.Table.from_batches([batch])]) if kept else pa.Table.from_batches([batch])
                cells = now["cell"].to_numpy()
                cut = int(np.searchsorted(cells, cells[-1]))
                if cut > 1 << 12:
                    yield out(now.slice(0, cut))
                    now = now.slice(cut)
                kept = [now]
            if kept and len(kept[0]):
                yield out(kept[0])

        return link

    def candidates(members: DataFrame, pairs, batch_tables: int) -> DataFrame:
        """Distinct links (a, b, x, y) that pairs finds in the cells of all tables. members: fp, key, rep and more."""
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1 << 12)
        kinds = ", ".join(f"{n} {t}" for n, t in members.dtypes)
        edges = None
        for start in range(0, count, batch_tables):
            cells = members.mapInArrow(placed(start, batch_tables), f"cell long, {kinds.replace('bigint', 'long')}")
            part = durable(cells.repartition(partitions(spark), "cell").sortWithinPartitions("cell").mapInArrow(linked(pairs), "a long, b long, x binary, y binary").distinct())
            edges = edges.union(part) if edges is not None else part
        bounded_batches(spark)
        return durable(edges.distinct())

    spread_reps = durable(reps.select("fp", "key", "rep").repartition(partitions(spark)))
    first = candidates(spread_reps, lambda cells, fps, table: cell_links(cells, fps, np.arange(len(table)), radius), BATCH)
    sure = verified(rows, first.filter("a <> b"), width, share)
    groups = components(sure)
    left = first.filter("a = b").select(F.col("a").alias("rep")).distinct()
    if open_rows := left.count():
        at_once = BATCH * max(1, number // open_rows)  # as many rows in cells at once as before
        left = durable(spread_reps.join(left, "rep", "left_semi").select("fp", "key", "rep"))
        apart = left.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "key", "rep", F.coalesce("component", "rep").alias("group")).repartition(partitions(spark))
        more = candidates(apart, lambda cells, fps, table: links_between(cells, fps, table["group"].to_numpy(), radius), at_once)
        groups = components(verified(rows, more, width, share, sure, 0))
    joined = reps.join(groups, reps["rep"] == groups["node"], "left").select("key", F.coalesce("component", "rep").alias("group"))
    return beside_hot(found.select("doc", "key"), joined, "key").select(F.col("doc").alias(id_col), "group").distinct()


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the near copies of a document of smaller id; other columns as
    they are. Rows with a null id stay."""
    gone = near_copy_groups(docs, id_col=id_col, **options).filter(quoted(id_col) > F.col("group")).select(id_col)
    return docs.join(gone.hint("shuffle_hash"), id_col, "left_anti").select(*[quoted(c) for c in docs.columns])
