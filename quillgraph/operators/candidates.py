"""Candidate rows of questions: (q_id, ord, title, path, snippet, score, source_tag).

Order is data: each operator keeps or renews ord, and every sort ends in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.vectors import cosine_normalised

# Score lanes.
PINNED, CONFIDENT, LIST_ARTICLE = 500, 800, 2000


def _per(q_col: str, *order) -> Window:
    return Window.partitionBy(q_col).orderBy(*order)


def union_first(lanes: list[DataFrame], q_col: str = "q_id", key: str = "path") -> DataFrame:
    """ST-U1, AG1: lanes one after another; of equal keys the first row stays."""
    whole = lanes[0].withColumn("_lane", F.lit(0))
    for k, lane in enumerate(lanes[1:], 1):
        whole = whole.unionByName(lane.withColumn("_lane", F.lit(k)), allowMissingColumns=True)
    first = whole.groupBy(q_col, key).agg(F.min_by(F.struct(*[c for c in whole.columns if c not in (q_col, key)]), F.struct("_lane", "ord")).alias("_x"))
    rows = first.select(q_col, key, "_x.*")
    return rows.withColumn("ord", F.row_number().over(_per(q_col, "_lane", "ord"))).drop("_lane")


def append_missing(hits: DataFrame, extra: DataFrame, q_col: str = "q_id", key: str = "path") -> DataFrame:
    """JN3, ST-U2: extra rows whose key the question does not have yet, after its own."""
    new = extra.join(hits.select(q_col, key).distinct(), [q_col, key], "left_anti")
    both = hits.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("ord", F.row_number().over(_per(q_col, "_s", "ord"))).drop("_s")


def confident_or_all(hits: DataFrame, least: int = CONFIDENT, q_col: str = "q_id") -> DataFrame:
    """PF6: rows of score least or more; all rows of a question without one."""
    any_ = F.max(F.col("score") >= least).over(Window.partitionBy(q_col))
    return hits.withColumn("_any", any_).filter((F.col("score") >= least) | ~F.col("_any")).drop("_any")


def without_titles(hits: DataFrame, excluded: DataFrame, q_col: str | None = "q_id") -> DataFrame:
    """PF7, ST-U3."""
    on = ["title"] if q_col is None else [q_col, "title"]
    return hits.join(excluded.select(*on).distinct(), on, "left_anti")


def boost_key(score: Column, title: Column, terms: Column) -> Column:
    """SO1's sort key. terms: lower-case array; without terms the key is null."""
    low = F.lower(title)
    flag = lambda c, w: F.when(c, w).otherwise(0)
    key = score + flag(F.exists(terms, lambda t: low == t), 100) + flag(F.exists(terms, lambda t: low.startswith(t)), 20) + flag(F.exists(terms, lambda t: low.contains(t)), 10) - F.floor(F.length(title) / 20)
    return F.when(F.size(terms) > 0, key)


def title_boosted(hits: DataFrame, terms_col: str = "terms", q_col: str = "q_id") -> DataFrame:
    """SO1: renews ord by the boost key, falling; score stays as it is."""
    key = boost_key(F.col("score"), F.col("title"), F.col(terms_col))
    return hits.withColumn("ord", F.row_number().over(_per(q_col, F.desc_nulls_last(key), "ord")))


def top_count(top_k: Column, hits: Column, is_list: Column) -> Column:
    """SO2: articles to take: for list questions min(12, max(top_k, 5, hits + 2))."""
    return F.when(is_list, F.least(F.lit(12), F.greatest(top_k, F.lit(5), hits + 2))).otherwise(top_k)


def take_top(hits: DataFrame, count_col: str, q_col: str = "q_id") -> DataFrame:
    return hits.withColumn("_r", F.row_number().over(_per(q_col, "ord"))).filter(F.col("_r") <= F.col(count_col)).drop("_r")


def last_n(rows: DataFrame, n: int, *order, by: str | None = None) -> DataFrame:
    """AG8, SO8: the last n rows, for each value of by if given."""
    if by is None:
        return rows.orderBy(*[F.desc(o) for o in order]).limit(n)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*[F.desc(o) for o in order]))).filter(F.col("_r") <= n).drop("_r")


def fused(hits: DataFrame, similarity: Column, *, k: int = 60, least: int = 3, q_col: str = "q_id") -> DataFrame:
    """SO3, SO4: reciprocal-rank fusion of the order and the similarity ranks.

    Rows of raw score PINNED or more stay first, in their order. The others (the
    tail) sort by 1/(k+i) + 1/(k+rank), both ranks from 0, in float as ties demand;
    a null similarity counts as -1. Questions of fewer than least rows or tail rows
    keep their order. Renews ord."""
    w = Window.partitionBy(q_col)
    rows = hits.withColumn("_tail", F.col("score") < PINNED).withColumn("_sim", F.coalesce(similarity, F.lit(-1.0)))
    rows = rows.withColumn("_n", F.count("*").over(w)).withColumn("_t", F.count_if(F.col("_tail")).over(w))
    part = Window.partitionBy(q_col, "_tail")
    rows = rows.withColumn("_i", F.row_number().over(part.orderBy("ord")) - 1).withColumn("_r", F.row_number().over(part.orderBy(F.desc("_sim"), "ord")) - 1)
    one = lambda c: (F.lit(1.0).cast("float") / (F.lit(float(k)).cast("float") + c.cast("float"))).cast("float")
    score = (one(F.col("_i")) + one(F.col("_r"))).cast("float")
    on = (F.col("_n") >= least) & (F.col("_t") >= least)
    rows = rows.withColumn("rrf", F.when(on & F.col("_tail"), score))
    order = [F.col("_tail").cast("int"), F.desc_nulls_last("rrf"), F.col("ord")]
    plain = F.row_number().over(_per(q_col, "ord"))
    return rows.withColumn("ord", F.when(on, F.row_number().over(_per(q_col, *order))).otherwise(plain)).drop("_tail", "_sim", "_n", "_t", "_i", "_r")


def reranked(hits: DataFrame, query_vectors: DataFrame, passage_vectors: DataFrame, enabled: bool = True, q_col: str = "q_id", key: str = "path") -> DataFrame:
    """VE5: fusion with cosine similarity, or hits as they are when reranking is off.
    query_vectors: (q_col, query_vec); passage_vectors: (q_col, key, passage_vec)."""
    if not enabled:
        return hits
    with_vec = hits.join(query_vectors, q_col, "left").join(passage_vectors, [q_col, key], "left")
    sim = F.when(F.col("query_vec").isNotNull() & F.col("passage_vec").isNotNull(), cosine_normalised(F.col("query_vec"), F.col("passage_vec")))
    return fused(with_vec, sim, q_col=q_col).drop("query_vec", "passage_vec")


def best_name_match(hits: DataFrame, name: Column, q_col: str = "q_id") -> DataFrame:
    """JN7: for each question the hit whose title shares most tokens with the name, the first of equals."""
    split = lambda c: F.split(F.lower(c), r"[\s,.]+")
    own = F.array_distinct(F.filter(split(name), lambda t: F.length(t) >= 3))
    shared = F.size(F.array_intersect(own, split(F.col("title"))))
    return hits.withColumn("_n", shared).withColumn("_r", F.row_number().over(_per(q_col, F.desc("_n"), "ord"))).filter("_r = 1").drop("_n", "_r")


def list_article(probes: DataFrame, least: int = 400, q_col: str = "q_id") -> DataFrame:
    """PF18: the first raw title probe that is no redirect and has a body; score 2000."""
    real = probes.filter(~F.col("is_redirect") & (F.col("body_len") >= least))
    return real.withColumn("_r", F.row_number().over(_per(q_col, "ord"))).filter("_r = 1").drop("_r").withColumn("score", F.lit(LIST_ARTICLE))
