"""The block-max index: the same rows as a full search, fewer blocks and folders read."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from quillgraph.functions.text import PUNCT
from quillgraph.operators import blockmax, index, storage


def corpus(spark):
    rng = random.Random(1)
    words = [f"word{k}" for k in range(400)]
    docs = [(k, " ".join(rng.choices(words, [1 / (r + 1) for r in range(400)], k=rng.randint(1, 60)))) for k in range(900)] + [(900, None), (901, ""), (902, "a b"), (None, "word1 word2")]
    questions = [(k, " ".join(rng.choices(words, k=rng.randint(1, 4)))) for k in range(25)] + [(25, "nosuchterm"), (26, ""), (27, None), (28, "word1 word1 word399")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(questions, "q_id long, query string")


def test_index_equals_full_search_and_skips_blocks(spark):
    docs, questions = corpus(spark)
    path = storage.shared_folder(spark, "test")
    blockmax.build(docs, path, block=16)
    want = {tuple(r) for r in index.bm25_search(docs.filter("doc_id is not null"), questions, k=5).select("q_id", "rank", "doc_id", "score").collect()}
    got = {tuple(r) for r in blockmax.search(spark, path, questions, k=5).collect()}
    assert got == want and len(want) > 100
    _, weights, bounds = blockmax.weighed(spark, path, questions, "q_id", "query")
    first = bounds.withColumn("r", F.expr("row_number() over (partition by q order by bound desc, block)")).filter(f"r <= {blockmax.FIRST}").drop("r")
    taken = blockmax.taken_blocks(bounds, first, blockmax.scored(spark, path, weights, first), 5)
    assert first.count() + taken.count() < 0.8 * bounds.count()


def test_only_the_folders_asked_for_are_read(spark):
    docs, _ = corpus(spark)
    path = storage.shared_folder(spark, "test")
    blockmax.build(docs, path, block=64)
    wanted = spark.createDataFrame([("word7",)], "term string")
    rows = blockmax.entries(spark, path, wanted, 1)
    folder = wanted.select(blockmax.folder_of(F.col("term"))).head()[0]
    assert {f"folder={folder}" in f for f in rows.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]} == {True}
    plan = rows.select("term", "block", "top")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or f"folder IN ({folder})" in plan or f"(folder#" in plan.split("PartitionFilters")[1][:80]
    assert "postings" not in plan.split("ReadSchema")[1]


def test_counted_terms(spark):
    rows = [(1, "cat dog cat, cat! owl a"), (2, None), (3, "a b"), (4, "dog")]
    got = blockmax.exploded(blockmax.counted_terms(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text"), "doc_id", "dl")
    assert {tuple(r) for r in got.collect()} == {(1, 5, "cat", 3), (1, 5, "dog", 1), (1, 5, "owl", 1), (4, 1, "dog", 1)}


def test_empty_tables(spark):
    docs, questions = corpus(spark)
    path = storage.shared_folder(spark, "test")
    blockmax.build(docs.limit(0), path)
    assert blockmax.search(spark, path, questions).count() == 0
    other = storage.shared_folder(spark, "test")
    blockmax.build(docs, other)
    assert blockmax.search(spark, other, questions.limit(0)).count() == 0


def test_terms_are_words_between_white_space_and_punctuation(one):
    text = "".join(f"Wörd{chr(c)}" for c in range(1, 0x2100)) + "…ab — abc\x0bЖЖЖ"
    by_pattern = F.filter(F.split(F.lower(F.lit(text)), rf"(?:\s|{PUNCT})+"), lambda t: F.length(t) >= 3)
    got = one(index.terms(F.lit(text)))
    assert got == one(by_pattern) and got[-2:] == ["abc", "жжж"]


def test_texts_are_cut_once(spark, monkeypatch):
    """Neither lengths nor filters on them have a text cut a second time, and each document's terms move once."""
    kept = []
    monkeypatch.setattr(index, "durable", lambda df: kept.append(df) or storage.durable(df))
    docs, questions = corpus(spark)
    best = index.bm25_search(docs, questions)
    plan = kept[0]._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"lower\(text#", plan)) == 1
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(q_id" in plan and not re.search(r"hashpartitioning\(q_id#\d+L?, doc_id", plan)


def test_terms_cut_in_arrow_are_index_terms(spark):
    text = "".join(f"Wörd{chr(c)}" for c in range(1, 0x2100)) + "…ab — abc\x0bЖЖЖ \x85𝒜𝒜𝒜"
    texts = spark.createDataFrame([(0, text), (1, None), (2, ""), (3, " a, bb"), (4, "Cat")], "k int, text string").coalesce(1)
    rows = texts.select("k", F.lower("text").alias("low"), index.terms(F.col("text")).alias("t")).collect()
    words, at = blockmax.cut(pa.array([r["low"] for r in rows], pa.string()))
    assert list(zip(at.tolist(), words.to_pylist())) == [(r["k"], t) for r in rows for t in r["t"] or []]


def test_a_term_has_a_row_for_each_of_a_few_blocks(spark):
    docs = spark.range(4096).select(F.col("id").alias("doc_id"), F.format_string("common word%d", F.col("id") % 7).alias("text"))
    path = storage.shared_folder(spark, "test")
    blockmax.build(docs, path)
    rows = blockmax.entries(spark, path, spark.createDataFrame([("common",)], "term string"), 1)
    assert rows.count() <= 4 and rows.agg(F.sum("n")).head()[0] == 4096


def test_long_texts_make_more_blocks(spark, monkeypatch):
    monkeypatch.setattr(blockmax, "TEXT", 1000)
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("common "), 30).alias("text"))
    path = storage.shared_folder(spark, "test")
    blockmax.build(docs, path)
    rows = blockmax.entries(spark, path, spark.createDataFrame([("common",)], "term string"), 1)
    assert rows.count() > 4 and rows.agg(F.sum("n")).head()[0] == 60


def test_scores_are_summed_where_a_block_is(spark):
    """Postings move once, by block; no sum of a question and document is shuffled."""
    docs, questions = corpus(spark)
    path = storage.shared_folder(spark, "test")
    blockmax.build(docs, path, block=64)
    _, weights, bounds = blockmax.weighed(spark, path, questions, "q_id", "query")
    plan = blockmax.scored(spark, path, weights, bounds)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(block.*REPARTITION_BY_COL", plan)) == 1 and not re.search(r"hashpartitioning\(q#", plan)


def test_only_what_reaches_the_kth_score_is_ranked(spark, monkeypatch):
    docs, questions = corpus(spark)
    path = storage.shared_folder(spark, "test")
    blockmax.build(docs, path, block=16)
    monkeypatch.setattr(blockmax, "FIRST", 1)
    for k in (1, 3):
        want = {tuple(r) for r in index.bm25_search(docs.filter("doc_id is not null"), questions, k=k).collect()}
        assert {tuple(r) for r in blockmax.search(spark, path, questions, k=k).collect()} == want
