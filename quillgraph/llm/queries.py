"""The registered queries opN_<name>: each operator over its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bpe, contamination, ctw, language, line_dedup, periodic, pii, simhash, substring, topk, toxicity, turns, url_filter
from quillgraph.llm.common import crc_fold

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: Of the registered query only; a real run takes its key from a secret store.
PUBLIC_KEY = b"a key that everyone may know"


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PUBLIC_KEY)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner(table(spark, sf_dir, "embeddings"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score_documents(docs, model)
    return out.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns dropped, emptied, cut, repeated or given to the user, by crc32 of conversation and turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault")).filter("fault <> 0")
    told = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), told.alias("text"), "fault")
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))).drop("fault", "copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return turns.repair(damaged(conversations), every=conversations)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out_of_training = crc_fold(F.col("doc_id"), 3) == 1
    model = language.fit(docs.filter(~out_of_training))
    return language.identify(docs, model).select("doc_id", out_of_training.alias("held_out"), "lang_pred", "score", "accepted")


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """The places whose words a text of n words gets: in a tenth of the documents, by crc32 of
    the id (a null id counts as empty text), the words from some place on repeat."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    place = np.arange(n)
    place[start:] = start + (place[start:] - start) % period
    return place


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.periodic_runs(table(spark, sf_dir, "documents"), edit=repeated_tail).withColumn("best", periodic.longest(F.col("runs")))
    length, period = -F.col("best.less"), F.col("best.period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).alias("exponent_milli"), F.sha2(periodic.listed(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"))


def queries() -> dict[str, Query]:
    from quillgraph.llm.oracles import ORACLES

    found = [f for name, f in globals().items() if name.startswith("op")]
    assert not set(ORACLES) - {f.__name__ for f in found}
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from quillgraph.llm.oracles import ORACLES

    return dict(ORACLES)
