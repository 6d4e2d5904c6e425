"""Typo suggestions, sorted titles, dictionaries and running sums against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import dictionaries, index, logs, ordered, sorted_titles, storage, typos
from quillgraph.sources import sinks


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


@pytest.mark.parametrize(("most", "beginning"), [(1, 4), (2, 5), (2, 12)])
def test_no_near_title_is_missed(spark, most, beginning):
    """However short the beginnings that meet: the distance is to the whole title."""
    rng = random.Random(most * beginning)
    titles = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(80)})
    asked = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(80)}) + ["", " ", "é"]
    got = typos.suggested_by_edits(spark.createDataFrame([(a,) for a in asked] * 2, "title_asked string"), spark.createDataFrame([(t, t + "/p") for t in titles] + [(None, "n")], "title string, path string"), most=most, beginning=beginning)
    want = {}
    for a in asked:
        if a.strip() and (near := [(d, t) for t in titles if (d := distance(a, t)) <= most]):
            want[a] = min(near)
    rows = got.collect()
    assert {r["title_asked"]: (r["distance"], r["title"]) for r in rows} == want and len(rows) == 2 * len(want) and len(want) > 30
    assert all(r["path"] == r["title"] + "/p" and r["score"] == 950 for r in rows)


@pytest.mark.parametrize(("block", "limit"), [(4, 3), (3, 10), (500, 2)])
def test_prefixes_in_sorted_blocks(spark, block, limit):
    rng = random.Random(block)
    titles = ["".join(rng.choice("aAbé") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    path = storage.shared_folder(spark, "test")
    sorted_titles.build(spark.createDataFrame([(t, f"p{k}") for k, t in enumerate(titles)] + [(None, "x")], "title string, path string").repartition(4), path, block=block)
    probes = [(k, p) for k, p in enumerate(["", "a", "A", "ab", "éé", "zz", "b", "Ba", None, "a"])]
    got = {}
    for r in sorted_titles.by_prefix(spark, path, spark.createDataFrame(probes, "k int, prefix string"), limit).collect():
        got.setdefault(r["k"], set()).add((r["title"], r["path"]))
    order = sorted(((t.lower(), t, f"p{k}") for k, t in enumerate(titles)), key=lambda x: (x[0].encode(), x[1].encode(), x[2]))
    for k, p in probes:
        assert got.get(k, set()) == ({(t, q) for low, t, q in [x for x in order if x[0].startswith(p.lower())][:limit]} if p is not None else set())
    empty = storage.shared_folder(spark, "test")
    sorted_titles.build(spark.createDataFrame([], "title string, path string"), empty)
    assert sorted_titles.by_prefix(spark, empty, spark.createDataFrame(probes, "k int, prefix string"), limit).count() == 0


@pytest.mark.parametrize("size", [8 << 20, 200])
def test_dictionary(spark, monkeypatch, size):
    """One automaton, and several through which the texts pass."""
    monkeypatch.setattr(dictionaries, "ENTRY_BYTES", size)
    rng = random.Random(3)
    entries = [(f"{rng.choice('abc')}{rng.choice('abc')}" + rng.choice(("", " x", "é")), k) for k in range(60)] + [("", 1), (None, 2), ("zz", None)]
    texts = [(k, "".join(rng.choice("ABc é x") for _ in range(rng.randint(0, 30)))) for k in range(80)] + [(80, None), (81, ""), (81, "AB zz")]
    got = dictionaries.found_entries(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(entries, "entry string, place long"), id_col="doc_id")
    want = []
    for i, t in texts:
        held = {e for e, p in entries if e and p is not None and t and e in t.lower()}
        least = min(((p, e) for e, p in entries if e in held), default=(None, None))
        want.append((i, least[1], least[0], len(held)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    none = dictionaries.found_entries(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([], "entry string, place long"), id_col="doc_id")
    assert {tuple(r)[1:] for r in none.collect()} == {(None, None, 0)} and none.count() == len(texts)


def test_running_sums(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice("aab"), rng.choice((None, *range(-5, 9)))) for k in range(700)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "id long, tag string, v long").repartition(6)
    got = {r["id"]: r["s"] for r in ordered.running_sum(df, ["id"], F.col("v"), "s").collect()}
    by = {r["id"]: r["s"] for r in ordered.running_sum_by(df, "tag", [F.desc("id")], F.col("v"), "s").collect()}
    total = 0
    for i, tag, v in rows:
        total += v or 0
        assert got[i] == total and by[i] == sum(x or 0 for j, t, x in rows if t == tag and j >= i)
    assert ordered.running_sum(df.limit(0), ["id"], F.col("v"), "s").count() == 0


def test_dumped_log_is_in_order(spark):
    entries = spark.createDataFrame([(k, 1000 * k, "INFO", "t", f"m{k}") for k in random.Random(5).sample(range(300), 300)], "id long, timestamp long, level string, tag string, message string")
    path = storage.shared_folder(spark, "dump")
    sinks.dump_log(entries, path)
    names = sorted(r[0] for r in spark.read.text(path).select(F.input_file_name()).distinct().collect())
    lines = [line for n in names for line in open(n.removeprefix("file://")).read().splitlines()]
    assert [x.rpartition("m")[2] for x in lines] == [str(k) for k in range(300)]
    assert [r["n"] for r in logs.dumped(entries).orderBy("n").collect()] == list(range(1, 301))


def test_pairs_of_a_frequent_title_are_spread(spark, monkeypatch):
    """Each of 300 probes meets each of 300 articles of one title, some by redirects, in no single task."""
    monkeypatch.setattr(index, "SLICE", 30, raising=False)
    rows = [(f"p{k}", "same", False, None) for k in range(300)] + [(f"r{k}", f"old{k % 3}", True, f"s{k}") for k in range(9)] + [(f"s{k}", f"mid{k}", k % 2 == 0, f"p{k}" if k % 2 == 0 else None) for k in range(8)] + [("n", None, False, None)]
    articles = spark.createDataFrame(rows, "path string, title string, is_redirect boolean, redirect_to string")
    probes = spark.createDataFrame([(k, "same") for k in range(300)] + [(1000 + k, f"old{k}") for k in range(3)] + [(2000, "none"), (2001, None)], "q_id long, title_asked string")
    got = index.exact_titles(probes, articles)
    at = {r[0]: r for r in rows}

    def end(r):
        for _ in range(3):
            r = at.get(r[3], r) if r[2] else r
        return r[1], r[0]

    want = sorted((q, *end(r)) for q, t in [tuple(p) for p in probes.collect()] for r in rows if t is not None and r[1] == t)
    assert sorted((r["q_id"], r["title"], r["path"]) for r in got.collect()) == want and len(want) == 90009
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 0.6 * len(want)
    raw = index.raw_titles(probes, articles.withColumn("body", F.lit("x")))
    assert raw.count() == 90009 and max(r["count"] for r in raw.groupBy(F.spark_partition_id()).count().collect()) < 0.6 * 90009
