"""A ready full-text index with block maxima, and a search that skips blocks.

Documents are dealt into blocks of some BLOCK by a hash of their id; a block's texts meet in one
task, which counts its terms in Arrow and numpy. The index holds a row for
each term and block: the documents, what the term's weight in each follows from, and the largest weight. Rows
lie in folders by a hash of the term, sorted by term. A search reads the headers of its
terms alone (block, number, largest weight), which bound every block's scores from above.
Each question's most promising blocks are scored first; a block whose bound does not reach
the k-th score found there is never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.operators.index import K1, SEPARATORS, B, fitted, terms
from quillgraph.operators.storage import durable

#: Documents of a block on average and bytes of their texts, folders of the index, and files of a folder at most.
#: A term of few documents has a row for nearly each of them, the more so the smaller the blocks.
BLOCK, TEXT, FOLDERS, SLICES = 4096, 16 << 20, 64, 8
#: Counts and lengths take less room than weights, above all in a shuffle.
POSTINGS = "postings struct<docs:array<long>,tf:array<int>,dl:array<int>>"
ENTRY = f"term string, block long, n long, top double, {POSTINGS}, folder int"
#: Blocks of questions or terms are broadcast up to so many rows, of two values each.
NARROW_ROWS = 500_000
#: SEPARATORS and the space, for RE2.
BETWEEN = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in SEPARATORS + " ") + "]+"
#: Blocks of a question that are scored first.
FIRST = 4
#: Scores are rounded to six places; a bound may lie below by as much.
ROUNDED = 1e-6


def counted_terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, dl, found): length in terms, and structs (term, tf), counted within the row.

    Of the sorted terms, each that differs from the one before starts a run. Explode found by
    exploded(): a filter on its size would be pushed into the lambdas, which then sort the terms anew for each of them."""
    listed = docs.select(F.col(id_col), F.sort_array(terms(F.col(text_col))).alias("_t"))
    place = F.when(F.size("_t") > 0, F.sequence(F.lit(0), F.size("_t") - 1)).otherwise(F.array().cast("array<int>"))
    starts = listed.select("*", F.filter(place, lambda i: (i == 0) | (F.get("_t", i) != F.get("_t", i - 1))).alias("_s"))
    runs = F.transform("_s", lambda s, k: F.struct(F.get("_t", s).alias("term"), (F.coalesce(F.get("_s", k + 1), F.size("_t")) - s).cast("long").alias("tf")))
    return starts.select(F.col(id_col), F.greatest(F.size("_t"), F.lit(0)).alias("dl"), runs.alias("found"))


def exploded(counted: DataFrame, *columns: str) -> DataFrame:
    """columns, term and tf: a row for each term of a document."""
    return counted.select(*columns, F.explode_outer("found").alias("f")).filter("f is not null").select(*columns, "f.term", "f.tf")


def folder_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def weight(tf: Column, dl: Column, avg: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avg)))


def cut(low: pa.Array, least: int = 3) -> tuple[pa.Array, np.ndarray]:
    """terms() of lower-cased texts, one after another, and the number of each one's text."""
    listed = pc.split_pattern_regex(low, BETWEEN)
    words, at = pc.list_flatten(listed), pc.list_parent_indices(listed)
    long = pc.greater_equal(pc.utf8_length(words), least)
    return words.filter(long), at.filter(long).to_numpy()


def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(low) to (dl, bytes): length in terms and bytes."""
    for rows in batches:
        _, at = cut(rows.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.bincount(at, minlength=rows.num_rows), pa.int64()), pc.binary_length(rows.column(0)).cast(pa.int64())], names=["dl", "bytes"])


def inverted(rows: pa.Table) -> pa.Table:
    """(block, doc, low), the texts of a block, to (term, block, postings)."""
    rows = rows.sort_by("doc")
    words, at = cut(rows["low"].combine_chunks())
    coded = words.dictionary_encode()
    many = rows.num_rows
    pair, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * many + at, return_counts=True)
    code, row = np.divmod(pair, many)
    starts = pa.array(np.append(0, np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))), pa.int32())
    values = {"docs": rows["doc"].combine_chunks().take(pa.array(row)), "tf": pa.array(tf, pa.int32()), "dl": pa.array(np.bincount(at, minlength=many)[row], pa.int32())}
    postings = pa.StructArray.from_arrays([pa.ListArray.from_arrays(starts, v) for v in values.values()], list(values))
    return pa.table([coded.dictionary, pa.repeat(rows["block"][0], len(postings)), postings], ["term", "block", "postings"])


def build(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> None:
    """Write the index of docs to path, an unused folder that all executors see.

    Each row is a document of its own; rows with a null id or without terms are left out. Texts are read once for their number
    and mean length, which weights need, then shuffled once, by block, and counted there, so that the rows of the index alone
    are shuffled besides. A term that all documents hold is spread over all blocks."""
    spark = docs.sparkSession
    known = docs.filter(F.col(id_col).isNotNull())
    stats = known.select(F.lower(text_col).alias("low")).mapInArrow(lengths, "dl long, bytes long").filter("dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("avg"), F.sum("bytes").alias("bytes")).head()  # three numbers
    n, avg = int(stats["n"]), float(stats["avg"] or 1.0)
    spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(avg).alias("avg")).write.parquet(f"{path}/stats")
    blocks = max(1, n // block, int(stats["bytes"] or 0) // TEXT)
    dealt = known.select(F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("block"), F.col(id_col).cast("long").alias("doc"), F.lower(text_col).alias("low"))
    held = dealt.groupBy("block").applyInArrow(inverted, f"term string, block long, {POSTINGS}").repartition(folder_of(F.col("term")), F.pmod("block", F.lit(SLICES)))
    top = F.array_max(F.zip_with("postings.tf", "postings.dl", lambda tf, dl: weight(tf, dl, avg)))
    out = held.select(folder_of(F.col("term")).alias("folder"), "term", "block", F.size("postings.docs").cast("long").alias("n"), top.alias("top"), "postings")
    out.sortWithinPartitions("folder", "term", "block").write.partitionBy("folder").parquet(f"{path}/postings")


def entries(spark: SparkSession, path: str, vocabulary: DataFrame, few: int) -> DataFrame:
    """The index rows of these terms (term): only their folders are read, FOLDERS numbers at most reaching the driver."""
    folders = [r[0] for r in vocabulary.select(folder_of(F.col("term"))).distinct().collect()]
    held = spark.read.schema(ENTRY).parquet(f"{path}/postings").filter(F.col("folder").isin(folders))
    return held.join(fitted(vocabulary, few), "term", "left_semi")


def weighed(spark: SparkSession, path: str, questions: DataFrame, q_col: str, query_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, weights, bounds): (term, block, n, top) of the questions' terms; (q, term, idf); (q, block, bound)."""
    asked = questions.select(F.col(q_col).alias("q"), F.explode(F.array_distinct(terms(F.col(query_col)))).alias("term")).distinct()
    vocabulary = durable(asked.select("term").distinct())
    few = vocabulary.count()
    headers = durable(entries(spark, path, vocabulary, few).select("term", "block", "n", "top"))
    n = F.lit(float((spark.read.parquet(f"{path}/stats").head() or {"n": 0})["n"]))
    df = headers.groupBy("term").agg(F.sum("n").alias("df"))
    weights = durable(asked.join(fitted(df, few), "term").select("q", "term", F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))
    bounds = headers.join(fitted(weights, weights.count()), "term").groupBy("q", "block").agg(F.sum(F.col("idf") * F.col("top")).alias("bound"))
    return headers, weights, durable(bounds)


def scored(spark: SparkSession, path: str, weights: DataFrame, chosen: DataFrame) -> DataFrame:
    """(q, doc, score) of all documents of the chosen (q, block).

    Postings are shuffled once, by block; each question's share of them and its sums follow in the same task. Of few blocks,
    those of the terms asked for there are shuffled alone."""
    vocabulary = weights.select("term").distinct()
    held = entries(spark, path, vocabulary, vocabulary.count()).select("term", "block", "postings")
    pairs = chosen.select("q", "block")
    pairs = F.broadcast(pairs) if pairs.limit(NARROW_ROWS + 1).count() <= NARROW_ROWS else pairs
    wanted, blocks = weights.join(pairs, "q").select("term", "block"), chosen.select("block").distinct()
    if wanted.limit(NARROW_ROWS + 1).count() <= NARROW_ROWS:
        held = held.join(F.broadcast(wanted.distinct()), ["term", "block"], "left_semi")
    else:
        held = held.join(fitted(blocks, blocks.count()), "block", "left_semi")
    dealt = held.repartition("block")
    avg = (spark.read.parquet(f"{path}/stats").head() or {"avg": 1.0})["avg"]
    asked = dealt.join(fitted(weights, weights.count()), "term").join(pairs, ["q", "block"])
    each = asked.select("block", "q", "idf", "postings.tf", "postings.dl", F.posexplode("postings.docs").alias("at", "doc"))
    return each.groupBy("block", "q", "doc").agg(F.sum(F.col("idf") * weight(F.get("tf", "at"), F.get("dl", "at"), avg)).alias("score")).select("q", "doc", "score")


def least_scores(found: DataFrame, k: int) -> DataFrame:
    """(q, least): the k-th score found, of questions with as many."""
    best = Window.partitionBy("q").orderBy(F.desc("score"))
    return found.withColumn("r", F.row_number().over(best)).filter(F.col("r") == k).select("q", F.col("score").alias("least"))


def taken_blocks(bounds: DataFrame, first: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(q, block, bound) of bounds, but for those scored first, whose bound reaches the k-th score found so far."""
    rest = bounds.join(first.select("q", "block"), ["q", "block"], "left_anti").join(least_scores(found, k), "q", "left")
    return rest.filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - ROUNDED)).select("q", "block", "bound")


def search(spark: SparkSession, path: str, questions: DataFrame, *, id_col: str = "doc_id", q_col: str = "q_id", query_col: str = "query", k: int = 20) -> DataFrame:
    """(q_col, rank, id_col, score): the k best documents of each question, as bm25_search gives them over the indexed documents.

    Rows of one q_col are one question. Ties go to the smaller id. Questions without terms or matches have no rows."""
    _, weights, bounds = weighed(spark, path, questions, q_col, query_col)
    order = Window.partitionBy("q").orderBy(F.desc("bound"), "block")
    first = durable(bounds.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= FIRST).drop("r"))
    found = durable(scored(spark, path, weights, first))
    taken = durable(taken_blocks(bounds, first, found, k))
    every = found
    if taken.limit(1).count():
        least = durable(least_scores(found, k))
        rest = scored(spark, path, weights, taken).join(fitted(least, least.count()), "q", "left")
        # what does not reach the k-th score found is left out before the rest is ranked
        every = found.unionByName(rest.filter(F.col("least").isNull() | (F.col("score") >= F.col("least") - ROUNDED)).drop("least"))
    best = Window.partitionBy("q").orderBy(F.desc(F.round("score", 6)), "doc")
    ranked = every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(q_col), "rank", F.col("doc").alias(id_col), F.round("score", 6).alias("score"))
