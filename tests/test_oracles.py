"""Every query with SQL gives that SQL's rows at sf0.001."""

import math
from collections import Counter

import duckdb
import pytest
from conftest import DATA

from quillgraph.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_matches_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, str(DATA))
    columns = sorted(got.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == Counter(tuple(plain(r[k]) for k in at) for r in want.fetchall())


def test_entry_point_without_the_training_operators(monkeypatch):
    import sys

    import __spark_entry__ as e

    for name in [m for m in sys.modules if m.startswith("quillgraph.llm")] + ["corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name, raising=False)
    real = e.importlib.util.find_spec

    def missing(name, *a):
        if name.startswith("quillgraph.llm"):
            raise ModuleNotFoundError(name)
        return None if name == "corpus_pipeline" else real(name, *a)

    monkeypatch.setattr(e.importlib.util, "find_spec", missing)
    assert set(e.queries()) == set(catalogue.queries()) and "bm25_topk" in e.queries()
