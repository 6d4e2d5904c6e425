"""Exact top-k inner-product search by Fagin's threshold algorithm."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import quoted

#: Rows of a shard of candidates and of a block of queries: what one task holds at a time.
SHARD, BLOCK = 16_384, 2_048
#: Depth of the first look into the lists; it doubles from there.
FIRST = 16
#: Lists that would show so many entries for each row are read to their ends: next to no row would stay unseen.
ENOUGH = 4
#: Rows with a larger component are searched apart, in arithmetic without a bound.
WIDE = 1 << 24
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def quantised(vectors: list[np.ndarray], scale: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(matrix, its rows' places) of the vectors' floor(scale * x): of small components as
    64-bit integers, and of rows with a large one as Python's, which have no bound."""
    raw = np.array(vectors, np.float64).reshape(len(vectors), -1)
    with np.errstate(over="ignore"):
        scaled = np.floor(raw * scale)
    wide = (np.abs(scaled) >= WIDE).any(axis=1)
    out = []
    if not wide.all():
        out.append((scaled[~wide].astype(np.int64), np.flatnonzero(~wide)))
    if wide.any():
        exact = np.empty((int(wide.sum()), raw.shape[1]), object)
        for k, (row, own) in enumerate(zip(scaled[wide].tolist(), raw[wide].tolist(), strict=True)):
            exact[k] = [int(s) if abs(s) < float("inf") else int(x) * scale for s, x in zip(row, own, strict=True)]
        out.append((exact, np.flatnonzero(wide)))
    return out


class Lists:
    """A shard's rows and its sorted lists: for each dimension the rows by falling component."""

    def __init__(self, matrix: np.ndarray, ids: np.ndarray, largest: int):
        n = len(ids)
        self.ids = ids
        self.scored = 0
        # sums below 2^24 and 2^53 are exact in these types, whose products are fast
        top = int(np.abs(matrix).max(initial=0)) * max(largest, 1) * max(matrix.shape[1], 1)
        kind = next((t for t, bound in ((np.float32, 1 << 24), (np.float64, 1 << 53), (np.int64, 1 << 62)) if top < bound), object)
        self.rows = matrix.astype(kind)
        self.down = np.asfortranarray(np.argsort(-matrix, axis=0, kind="stable")).astype(np.int32)
        self.depths = [min(n, FIRST << k) for k in range(max(1, (n // FIRST).bit_length() + 1))]
        columns = np.arange(matrix.shape[1])
        self.tops = np.array([self.rows[self.down[d - 1], columns] for d in self.depths])
        self.ends = np.array([self.rows[self.down[n - d], columns] for d in self.depths])

    def best(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, id) of the rows (id own excepted), ties to smaller ids.

        A list is read from its top where the query's component is positive and from
        its end where it is negative. A row's score is worked out when a list first
        shows the row (scored counts them); no unseen row can score above the sum of
        the query's components times the values at the depth read, so the search ends
        once the k-th score is above that bound (a row equal to it could still win by
        its id). The k-th score only rises: the first depth whose bound it beats is
        read next.
        """
        n = len(self.ids)
        query = query.astype(self.rows.dtype)
        up, falling = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        zero = np.zeros(len(query), query.dtype)
        bounds = self.tops @ np.where(query > 0, query, zero) + self.ends @ np.where(query < 0, query, zero)
        seen = self.ids == own
        rows, scores = np.empty(0, np.int64), np.empty(0, query.dtype)
        at = 0 if len(up) + len(falling) else len(self.depths) - 1
        before = 0
        while True:
            if self.depths[at] * (len(up) + len(falling)) >= ENOUGH * n:
                at = len(self.depths) - 1
            depth = self.depths[at]
            if depth == n:
                new = np.flatnonzero(~seen)
            else:
                shown = np.zeros(n, bool)
                shown[self.down[before:depth, up]] = True
                shown[self.down[n - depth : n - before, falling]] = True
                new = np.flatnonzero(shown & ~seen)
            seen[new] = True
            self.scored += len(new)
            found = (self.rows @ query)[new] if 2 * len(new) > n else self.rows[new] @ query
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, found])
            if len(rows) > k and scores.dtype != object:  # what is below the k-th can no longer win
                kept = scores >= np.partition(scores, len(rows) - k)[len(rows) - k]
                rows, scores = rows[kept], scores[kept]
            order = np.lexsort((self.ids[rows], -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(rows)), key=lambda x: (-scores[x], self.ids[rows[x]]))[:k], np.int64)
            last = scores[order[-1]] if len(order) == k else None
            if depth == n or last is not None and last > bounds[at]:
                return [(int(scores[x]), int(self.ids[rows[x]])) for x in order]
            beaten = np.flatnonzero(bounds < last) if last is not None else np.empty(0, int)
            before = depth
            at = max(at + 1, int(beaten[0]) if len(beaten) else len(self.depths) - 1 if last is not None else at + 1)


def beyond(score: int) -> str:
    """Of scores that do not fit a long, and of its ends: a text that sorts as they do."""
    digits = str(abs(score))
    digits = f"{len(digits):05d}{digits}"
    if LEAST < score < MOST:
        return ""
    return digits if score > 0 else digits.translate(str.maketrans("0123456789", "9876543210"))


def top_inner(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, every: int = 20, k: int = 20, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id_col, score): each query's k best other rows.

    Components are floor(scale * x). Queries: rows whose id is divisible by every;
    candidates: all rows but those with the query's id. Ties go to the smaller id.
    Rows with a null id, or a vector that is null or holds a null or non-finite
    component, take no part; any finite component counts. Scores are whole numbers
    without a bound and rank as such; one that does not fit a long is shown as the
    largest or least long. Vectors only meet vectors of their own length; an empty one
    scores zero. Equal query rows count once, unlike ones of one id each have a ranked
    list of their own; repeated candidate rows count each.

    Queries in blocks meet candidates in shards, both of bounded size: each pair
    of them is one group, which builds the sorted lists and runs the algorithm.
    The shards' winners, k at most for each query, are merged by a ranked window.
    """
    v = quoted(vector_col)
    rows = vectors.select(quoted(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v"))).select("id", F.col("v").cast("array<double>").alias("v"))
    asked = rows.filter(F.col("id") % every == 0).dropDuplicates(["id", "v"])
    n, q = rows.count(), asked.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-q // block))
    place = F.xxhash64("id", F.lit(7))
    left = rows.select("id", "v", F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"))
    right = asked.select("id", "v", F.xxhash64("v").alias("mark"), F.pmod(place, F.lit(blocks)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def search(cands: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(cands) and len(queries):
            cl, ql = cands["v"].map(len), queries["v"].map(len)
            for size in ql.unique():
                own, asking = cands[cl == size], queries[ql == size]
                for matrix, at in quantised(own["v"].tolist(), scale) if len(own) else []:
                    ids = own["id"].to_numpy()[at]
                    for mq, which in quantised(asking["v"].tolist(), scale):
                        lists = Lists(matrix, ids, int(np.abs(mq).max(initial=0)))
                        for i, mark, vec in zip(asking["id"].to_numpy()[which], asking["mark"].to_numpy()[which], mq, strict=True):
                            out += [(int(i), int(mark), j, min(max(s, LEAST), MOST), beyond(s)) for s, j in lists.best(vec, int(i), k)]
        return pd.DataFrame(out, columns=["query_id", "mark", "cand", "score", "beyond"]).astype({"query_id": "int64", "mark": "int64", "cand": "int64", "score": "int64", "beyond": "str"})

    found = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInPandas(search, "query_id long, mark long, cand long, score long, beyond string")
    best = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), F.desc("beyond"), "cand")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("cand").alias(id_col), "score")
