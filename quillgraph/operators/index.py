"""Full-text and title indexes over an article table, and lookups in them.

Questions come as a DataFrame; every lookup answers all of them in one plan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import PUNCT
from quillgraph.operators.storage import durable

K1, B = 1.2, 0.75
# Score lanes.
EXACT, SUGGESTED, PREFIXED = 1000, 950, 800
#: A broadcast side holds this many rows at most; beyond it the join shuffles.
BROADCAST_ROWS = 50_000
#: Rows of one key that meet as many of the other side in a task, and pairs of a task.
SLICE, PAIRS = 1_000, 4_000_000


def fitted(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its rows are counted and few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def only(table: DataFrame, keys: DataFrame, column: str, key: str | None = None) -> DataFrame:
    """table's rows whose column is among the keys. Up to BROADCAST_ROWS keys are
    broadcast, so that a large table is read and not shuffled for a few lookups; beyond
    that table comes back whole, and the join that follows shuffles it."""
    wanted = keys.select(F.col(key or column).alias(column)).filter(F.col(column).isNotNull()).distinct()
    if wanted.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return table
    return table.join(F.broadcast(wanted), column, "left_semi")


#: What separates terms: white space, and the characters of PUNCT.
SEPARATORS = "\t\n\x0b\f\r" + "".join(c for c in map(chr, range(0x21, 0x2100)) if re.fullmatch(PUNCT, c))


def terms(text: Column, least: int = 3) -> Column:
    """Index terms: lower-case words of least characters or more. Separators become spaces
    and the text is cut at these, which takes less time than a pattern."""
    spaced = F.translate(F.lower(text), SEPARATORS, " " * len(SEPARATORS))
    return F.filter(F.split(spaced, " "), lambda t: F.length(t) >= least)


def bm25_search(docs: DataFrame, questions: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", q_col: str = "q_id", query_col: str = "query", k: int = 20) -> DataFrame:
    """SC4: (q_col, rank, id_col, score): the k best documents of each question.

    One pass over the texts. Only the questions' terms are looked for: a document's row
    drops other terms before anything is shuffled. An empty term, which no question has,
    stands for the document itself, so the number of documents and their mean length
    come from the same checkpointed table as document frequencies and scores. Ties go
    to the smaller id. Questions without terms or matches have no rows. Question terms
    are broadcast when they are counted few.
    """
    asked = questions.select(q_col, F.explode(F.array_distinct(terms(F.col(query_col)))).alias("term"))
    vocabulary = asked.select("term").distinct()
    few = vocabulary.count()
    wanted = vocabulary.union(docs.sparkSession.range(1).select(F.lit("").alias("term")))
    listed = docs.select(id_col, terms(F.col(text_col)).alias("t"))
    # explode_outer, and no filter on t: either would be pushed below and cut the text once more
    every = F.when(F.size("t") > 0, F.concat(F.array(F.lit("")), "t"))
    spread = listed.select(id_col, F.size("t").alias("dl"), F.explode_outer(every).alias("term")).join(fitted(wanted, few + 1), "term", "left_semi")
    counted = durable(spread.groupBy(id_col, "dl", "term").agg(F.count("*").alias("tf")))
    stats = counted.filter("term = ''").agg(F.sum("tf").alias("n"), F.avg("dl").alias("avg")).head()  # two numbers
    found = counted.filter("term <> ''")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    n, avg = F.lit(float(stats["n"] or 0)), F.lit(float(stats["avg"] or 1.0))
    weights = asked.join(fitted(df, few), "term").withColumn("idf", F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    pairs = weights.count() if few <= BROADCAST_ROWS else BROADCAST_ROWS + 1
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avg))
    # dealt by document, its few rows move once, and not a sum for each question besides
    scored = found.repartition(id_col).join(fitted(weights, pairs), "term").groupBy(q_col, id_col).agg(F.sum(part).alias("score"))
    best = Window.partitionBy(q_col).orderBy(F.desc(F.round("score", 6)), id_col)
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(q_col, "rank", id_col, F.round("score", 6).alias("score"))


# --- titles ------------------------------------------------------------------

def title_key(title: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(title, PUNCT, " "), r"\s+", " ")))


def paired(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """left joined to right by the column on. A key's pairs are as many as its rows multiplied, so
    the rows of a frequent key are cut into slices of some SLICE by a hash, and each slice of
    one side meets each of the other in a task of its own. Tasks get some PAIRS pairs each."""
    spark = left.sparkSession
    counts = left.groupBy(on).agg(F.count("*").alias("_l")).join(right.groupBy(on).agg(F.count("*").alias("_r")), on)
    sizes = durable(counts.select(on, F.col("_l"), F.col("_r"), F.ceil(F.col("_l") / SLICE).cast("int").alias("_i"), F.ceil(F.col("_r") / SLICE).cast("int").alias("_j")))
    pairs = sizes.agg(F.sum(F.col("_l") * F.col("_r"))).head()[0] or 0
    cuts = sizes.filter("_i > 1 or _j > 1").select(on, "_i", "_j")
    cuts = fitted(cuts, cuts.count())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pairs // PAIRS)

    def sliced(rows: DataFrame, own: str, other: str) -> DataFrame:
        """rows in the slice of own that their hash gives, once for each slice of other."""
        many = lambda c: F.coalesce(F.col(c), F.lit(1))
        known = rows.filter(F.col(on).isNotNull()).join(cuts, on, "left").select(*rows.columns, F.pmod(F.xxhash64(*rows.columns), many(own)).cast("int").alias("_own"), F.sequence(F.lit(0), many(other) - 1).alias("_all"))
        return known.select(*rows.columns, F.col("_own").alias(own), F.explode("_all").alias(other)).repartition(parts, on, "_i", "_j")

    return sliced(left, "_i", "_j").join(sliced(right, "_j", "_i"), [on, "_i", "_j"]).drop("_i", "_j")


def follow_redirects(hits: DataFrame, articles: DataFrame, hops: int = 3) -> DataFrame:
    """hits with path, title and is_redirect of where up to hops redirects lead. Rows that lead
    nowhere are not joined: with no key in common they would all meet in one task."""
    leads = F.coalesce(F.col("is_redirect") & F.col("redirect_to").isNotNull(), F.lit(False))
    there, moving = hits.filter(~leads), durable(hits.filter(leads))
    for _ in range(hops):
        if moving.isEmpty():
            break
        to = only(articles, moving, "path", "redirect_to").select(F.col("path").alias("_p"), F.col("title").alias("_t"), F.col("is_redirect").alias("_r"), F.col("redirect_to").alias("_to"))
        moved = F.col("_p").isNotNull()
        step = durable(moving.join(to, F.col("redirect_to") == F.col("_p"), "left").select(*[c for c in hits.columns if c not in ("path", "title", "is_redirect", "redirect_to")], F.when(moved, F.col("_p")).otherwise(F.col("path")).alias("path"), F.when(moved, F.col("_t")).otherwise(F.col("title")).alias("title"), F.when(moved, F.col("_r")).otherwise(F.col("is_redirect")).alias("is_redirect"), F.when(moved, F.col("_to")).otherwise(F.col("redirect_to")).alias("redirect_to")))
        there, moving = there.unionByName(step.filter(~leads)), step.filter(leads)
    return there.unionByName(moving)


def exact_titles(probes: DataFrame, articles: DataFrame, title_col: str = "title_asked", hops: int = 3) -> DataFrame:
    """SC5: probes joined to the article of that title, redirects followed, score 1000.
    Redirects are followed from each article once, before its probes are joined."""
    named = only(articles, probes, "title", title_col).select(F.col("title").alias(title_col), "title", "path", "is_redirect", "redirect_to")
    return paired(probes, follow_redirects(named, articles, hops).drop("redirect_to", "is_redirect"), title_col).withColumn("score", F.lit(EXACT))


def suggested_titles(probes: DataFrame, articles: DataFrame, title_col: str = "title_asked", key_chars: int = 3) -> DataFrame:
    """SC6: for each probe the title nearest to it that begins alike, score 950.

    Candidates share the first key_chars characters of the normalised title (an
    equi-join); titles that go on from the probe come before others, then the least
    Levenshtein distance wins, ties to the smaller title. A shorter probe can only be
    gone on from: of each such beginning the one best title is found beforehand. A
    probe that is blank once normalised has no suggestion."""
    asked = probes.withColumn("_a", title_key(F.col(title_col))).withColumn("_k", F.substring("_a", 1, key_chars))
    named = articles.select("title", "path", title_key(F.col("title")).alias("_n"))
    whole = F.length("_k") == key_chars
    near = asked.filter(whole).join(named.withColumn("_k", F.substring("_n", 1, key_chars)), "_k").withColumn("_d", F.levenshtein("_n", "_a")).filter(F.col("_n").startswith(F.col("_a")) | (F.col("_d") <= F.length("_a") / 3))
    first = Window.partitionBy(*probes.columns).orderBy(~F.col("_n").startswith(F.col("_a")), "_d", "title", "path")
    long = near.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select(*probes.columns, "title", "path")
    short = asked.filter(~whole & (F.length("_a") > 0))
    begun = only(beginnings(named, 1, key_chars - 1), short, "_k")
    least = begun.groupBy("_k").agg(F.min(F.struct(F.length("_n").alias("n"), "title", "path")).alias("_b"))
    brief = short.distinct().join(least, "_k").select(*probes.columns, "_b.title", "_b.path")
    return long.unionByName(brief).withColumn("score", F.lit(SUGGESTED))


def beginnings(named: DataFrame, least: int, most: int) -> DataFrame:
    """named with a row (_k) for each beginning of _n of least to most characters."""
    cuts = F.transform(F.sequence(F.lit(least), F.least(F.length("_n"), F.lit(most))), lambda n: F.substring(F.col("_n"), F.lit(1), n))
    return named.filter(F.length("_n") >= least).withColumn("_k", F.explode(cuts))


def lookup_titles(probes: DataFrame, articles: DataFrame, title_col: str = "title_asked") -> DataFrame:
    """Exact hits, and suggestions for probes without one."""
    exact = exact_titles(probes, articles, title_col)
    rest = probes.join(only(articles, probes, "title", title_col).select(F.col("title").alias(title_col)).distinct(), title_col, "left_anti").select(*probes.columns)
    return exact.unionByName(suggested_titles(rest, articles, title_col))


def raw_titles(probes: DataFrame, articles: DataFrame, body_col: str = "body", title_col: str = "title_asked") -> DataFrame:
    """SC7: (…, title, path, is_redirect, body_len); a redirect is not followed and has length 0."""
    named = only(articles, probes, "title", title_col).select(F.col("title").alias(title_col), "title", "path", "is_redirect", F.when(F.col("is_redirect"), 0).otherwise(F.length(body_col)).alias("body_len"))
    return paired(probes, named, title_col)


def titles_by_prefix(articles: DataFrame, prefix: str, limit: int, *, title_col: str = "title") -> DataFrame:
    """SC8: titles that begin with prefix, whatever the case, in title order, score 800.
    Blank titles take places within the limit and are then dropped."""
    low = prefix.lower()
    hit = articles.filter(F.lower(F.col(title_col)).startswith(low)).orderBy(title_col).limit(limit)
    return hit.filter(F.trim(F.col(title_col)) != "").withColumn("score", F.lit(PREFIXED))


def prefix_matches(probes: DataFrame, articles: DataFrame, limit: int, prefix_col: str = "prefix", key_chars: int = 8) -> DataFrame:
    """SC8 for many prefixes: the first limit titles of each, in title order, score 800.

    An equi-join on the first key_chars characters, then the whole prefix. A shorter
    prefix is a key of its own: of its titles only the first limit can be asked for,
    so they are ranked before the join, and a prefix of every title joins limit rows."""
    asked = probes.withColumn("_p", F.lower(prefix_col)).withColumn("_k", F.substring("_p", 1, key_chars))
    named = articles.select("title", "path", F.lower("title").alias("_n"))
    long = asked.filter(F.length("_p") >= key_chars).join(named.withColumn("_k", F.substring("_n", 1, key_chars)), "_k").filter(F.col("_n").startswith(F.col("_p")))
    order = Window.partitionBy(*probes.columns).orderBy("title", "path")
    ranked = long.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= limit).select(*probes.columns, "title", "path")
    short = asked.filter(F.length("_p") < key_chars)
    begun = only(beginnings(named, 0, key_chars - 1), short, "_k").withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy("title", "path"))).filter(F.col("_r") <= limit)
    brief = short.join(begun.select("_k", "title", "path"), "_k").select(*probes.columns, "title", "path")
    return ranked.unionByName(brief).withColumn("score", F.lit(PREFIXED))


def article_html(hits: DataFrame, articles: DataFrame) -> DataFrame:
    """SC9: hits with the page at their path, redirects followed; null where there is none."""
    return hits.join(only(articles, hits, "path").select("path", "html"), "path", "left")
