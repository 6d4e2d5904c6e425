"""Language identification: scores against plain loops, held-out accuracy, rejection, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import language
from quillgraph.llm.queries import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")


@pytest.fixture(scope="module")
def model(documents):
    return language.fit(documents.filter("doc_id % 3 <> 1"), fit_rows=300)


def plain_mean(text, logits, bits):
    """Of every run of 2 to 4 bytes, one by one."""
    text = b" " + text.translate(language.BLANKS) + b" "
    rows = []
    for n in (2, 3, 4):
        for i in range(len(text) - n + 1):
            own = int.from_bytes(text[i : i + n], "big")
            own = ((own ^ own >> 15) * 0x85EBCA6B + n) % 2**32
            rows.append(logits[((own ^ own >> 13) * 0xC2B2AE35) % 2**32 >> 32 - bits])
    return np.sum(np.array(rows, np.float64), axis=0) / len(rows)


def test_means_equal_plain_loops(monkeypatch):
    logits = np.random.default_rng(1).normal(size=(1 << 10, 3)).astype(np.float32)
    texts = [b"", b"a", "Füße über 12 Äpfel".encode(), b"abc " * 40, b"x" * 64]
    for chunk in (1 << 17, 16):  # whole, and in pieces
        monkeypatch.setattr(language, "CHUNK", chunk)
        got = language.means(texts, logits, 10)
        for text, row in zip(texts, got, strict=True):
            assert row == pytest.approx(plain_mean(text, logits, 10), rel=1e-6)


def test_sparse_equals_means(monkeypatch):
    logits = np.random.default_rng(1).normal(size=(1 << 10, 3)).astype(np.float32)
    for chunk in (1 << 17, 16):
        monkeypatch.setattr(language, "CHUNK", chunk)
        for text in (b"a", "Füße über 12 Äpfel".encode(), b"abc " * 40):
            place, share = language.sparse(text, 10)
            assert share.sum() == pytest.approx(1) and share @ logits[place] == pytest.approx(plain_mean(text, logits, 10), rel=1e-5)


def test_held_out_accuracy(documents, model):
    held = documents.filter("doc_id % 3 = 1")
    right, n = language.identify(held, model).join(held.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).head()
    assert n > 300 and right > 0.98


def test_registered_query(spark):
    """No column but the text enters a prediction: with all else changed, a row keeps its own."""
    got = queries()["op12_language_id"](spark, SF)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and len(rows) == 1000
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for i, r in rows.items())


def test_rejects_unlike_texts(spark, model):
    rows = [(1, "Съешь же ещё этих мягких французских булок да выпей чаю " * 3), (2, "もじもじ漢字かな交じり文です" * 5)]
    assert not any(r["accepted"] for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect())


def test_odd_rows(spark, model):
    rows = [(None, "Thatly the of and"), (1, None), (2, ""), (3, " 12 34 .. "), (4, "é"), (4, "é"), (5, "the " * 700_000 + "x" * (1 << 20))]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, LANG_PRED string, score string")
    got = language.identify(df, model)
    assert got.columns == ["doc_id", "lang_pred", "score", "accepted"]
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"], r["accepted"]))
    assert all(by_id[i] == [("und", 0.0, False)] for i in (1, 2, 3)) and len(by_id[4]) == 2 and by_id[4][0] == by_id[4][1]
    assert by_id[None][0][0] == "en" and by_id[5][0][0] in model.names
    empty = language.fit(df.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    assert empty.names == [] and {r["lang_pred"] for r in language.identify(df, empty).collect()} == {"und"}
    assert language.identify(df.limit(0), model).count() == 0


def test_learns_the_same_again(documents, model):
    """Whatever the partitions."""
    again = language.fit(documents.filter("doc_id % 3 <> 1").repartition(7), fit_rows=300)
    assert again.names == model.names and (again.logits == model.logits).all() and again.least == model.least


def test_calibration():
    label = np.array([0] * 80 + [1] * 20)
    logits = np.zeros((100, 2))
    logits[:, 0] = 30.0  # far too sure: a fifth is wrong
    t, least = language.calibrated(logits, label, 0.3)
    assert language.softmax(logits / t)[0, 0] == pytest.approx(0.8, abs=0.05) and 0.7 < least < 0.9
    assert language.calibrated(logits[:0], label[:0], 0.3) == (1.0, 0.0)
