import random

import corpus_pipeline
from pyspark.sql import functions as F

from quillgraph.llm.queries import oracle_sql, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(4000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    clean = {k: prose(80) for k in range(200)}
    item = prose(30)
    line = "a line that stands in three of these documents"
    texts = dict(clean)
    texts |= {300 + k: prose(60) + " dumbhead" + f" q{k}" for k in range(60)}
    texts |= {400: prose(50) + " " + item + " " + prose(50), 401: clean[5], 402: clean[6] + " more"}
    texts |= {k: clean[k] + "\n" + line for k in (10, 11, 12)}
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(None, "a text without id", "en", "s", 1), (500, None, "en", "s", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 300)) for i in texts if i < 400], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(clean) | {None, 500}
    assert out[10]["decoded"] == clean[10] and out[12]["decoded"].endswith(line)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    lines = corpus_pipeline.drop_common_lines(spark, docs, str(tmp_path))
    assert lines.filter(F.coalesce(F.length("text"), F.lit(0)) != F.col("n_chars")).count() == 0


def test_registry():
    names = queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert set(oracle_sql()) <= set(names)
