"""The registered queries over whole tables at sf0.001: against their SQL, or a plain version."""

import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from quillgraph.llm.queries import oracle_sql, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
ROUND = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert Counter(tuple(ROUND(r[c]) for c in columns) for r in got.collect()) == Counter(tuple(ROUND(r[k]) for k in at) for r in want.fetchall())


@pytest.fixture(scope="module")
def documents(duck):
    return duck.execute("SELECT doc_id, text FROM documents").fetchall()


def test_fingerprints(spark, documents):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries()["op3_simhash_near_dedup"](spark, SF).collect()}
    assert got == brute.groups(documents)


def test_bpe(spark, documents):
    import hashlib

    import numpy as np
    from tokenizers import Tokenizer

    from quillgraph.llm.queries import tokenizer_path

    tok = Tokenizer.from_file(tokenizer_path())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries()["op6_bpe"](spark, SF).collect()}
    want = {}
    for i, t in documents:
        ids = tok.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert got == want


def test_lm_base_scores(spark, documents):
    got = {r["doc_id"]: r for r in queries()["op9_lm_scoring"](spark, SF).collect()}
    for i, out, n, known, total, base in brute.unigram(documents):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out, n, known, total) and r["base_score"] == pytest.approx(base)
    assert all(r["score"] < 0 for r in got.values())


def test_toxicity_rows(spark, documents):
    got = queries()["op10_toxicity"](spark, SF).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in documents} and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_pseudonyms_keep_clean_texts(spark, documents):
    texts = dict(documents)
    got = queries()["op2_pii"](spark, SF).collect()
    assert len(got) == len(texts) and all((r["text"] == texts[r["doc_id"]]) == (r["n_replaced"] == 0) for r in got)


def test_lm_scores_at_the_registered_depth(spark, documents):
    """The text's score by dictionaries, on some documents that learn from each other alone."""
    from quillgraph.llm import ctw

    rows = sorted(documents, key=lambda r: len(r[1] or ""))[:60]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ctw.score_documents(df).collect()}
    for i, want in brute.context_tree(rows, 5):
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_near_copies_equal_brute_force(spark):
    """The pipeline's stage over all documents of sf0.01: no similar pair apart, no other pair together."""
    from quillgraph.llm import near_copies

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute.similar_groups([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = {r["doc_id"]: r["group"] for r in near_copies.near_copy_groups(docs).collect()}
    assert {i: got.get(i, i) for i in want} == want and len(set(want.values())) < len(want)
