import pytest
from cards import FIXTURE
from conftest import DATA
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.functions import html
from quillgraph.functions.vocab import RU, Profile
from quillgraph.operators import candidates, excerpts, extraction, graph, logs, metrics
from quillgraph.plans.catalogue import queries

HITS = "q_id long, ord int, title string, path string, snippet string, score int, source_tag string"
QUIET = settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))


def hits(spark, rows):
    return spark.createDataFrame([(1, k, t, p, "", s, None) for k, (t, p, s) in enumerate(rows)], HITS)


def paths(df):
    return [r["path"] for r in df.orderBy("q_id", "ord").collect()]


def test_first_lane_wins(spark):
    lanes = [hits(spark, [("a", "p1", 2000)]), hits(spark, [("b", "p2", 899)]), hits(spark, [("a", "p1", 50), ("c", "p3", 40)])]
    got = candidates.union_first(lanes)
    assert [(r["path"], r["score"]) for r in got.orderBy("ord").collect()] == [("p1", 2000), ("p2", 899), ("p3", 40)]


def test_confident_or_all(spark):
    both = hits(spark, [("a", "p1", 1000), ("b", "p2", 50)]).union(hits(spark, [("a", "p1", 50), ("b", "p2", 40)]).withColumn("q_id", F.lit(2).cast("long")))
    got = candidates.confident_or_all(both)
    assert sorted((r["q_id"], r["score"]) for r in got.collect()) == [(1, 1000), (2, 40), (2, 50)]


def test_boost_keeps_scores(spark):
    rows = hits(spark, [("Мэр Тольятти", "m", 60), ("Тольятти", "t", 50)]).withColumn("terms", F.array(F.lit("мэров"), F.lit("тольятти")))
    got = candidates.title_boosted(rows).orderBy("ord").collect()
    assert [(r["path"], r["score"]) for r in got] == [("t", 50), ("m", 60)]


def test_fusion(spark):
    rows = hits(spark, [("a", "a", 50), ("b", "b", 40), ("c", "c", 30)])
    sims = F.get(F.array(F.lit(0.2), F.lit(0.9), F.lit(0.5)), F.col("ord"))
    assert paths(candidates.fused(rows, sims)) == ["b", "a", "c"]
    assert paths(candidates.fused(rows.filter("ord < 2"), sims)) == ["a", "b"]
    pinned = hits(spark, [("a", "a", 900), ("b", "b", 40), ("c", "c", 30), ("d", "d", 20)])
    assert paths(candidates.fused(pinned, sims))[0] == "a"


def test_card_links_body_sections():
    page = html.Page(FIXTURE, RU)
    assert page.card() == [{"label": "Глава/мэр", "value": "Абв Г."}, {"label": "Население", "value": "700 000"}]
    assert page.links() == [{"prop": "P6", "text": "Абв Г.", "href": "Абв"}]
    assert "Вводный текст." in page.body() and "Завод." in page.body() and "Население" not in page.body()
    assert [s["heading"] for s in page.sections()] == ["Городская власть", "Мэры", "Экономика"]


@pytest.mark.parametrize("source", [None, "", "<", "<table class=infobox>", "<tr><td>x", "</p></p>", "<h2></h2>text", "<table class='infobox'><tr><th>a<td>b<tr><th>c<td>d"])
def test_broken_pages(source):
    page = html.Page(source, RU)
    assert isinstance(page.body(), str) and page.links() == [] and isinstance(page.card(), list)


EDGES = [("city", "P6", "m3", "m3", 0), ("m3", "P1365", "m2", "m2", 0), ("m2", "P1365", "m1", "m1", 0), ("m2", "P1366", "m3", "m3", 1)]


def walk(spark, edges, seed="city", **options):
    table = spark.createDataFrame(edges, "src_path string, prop string, text string, dst_path string, ord int")
    got = graph.bounded_walk(spark.createDataFrame([(1, seed)], "q_id long, path string"), table, **options)
    return [(r["path"], r["depth"]) for r in got.orderBy("ord").collect()]


def test_walk(spark):
    assert walk(spark, EDGES) == [("m3", 1), ("m2", 2), ("m1", 3)]
    assert walk(spark, EDGES, max_nodes=2) == [("m3", 1), ("m2", 2)]
    assert walk(spark, EDGES, max_depth=1) == [("m3", 1)]
    assert walk(spark, EDGES, seed=" ") == []
    none = spark.createDataFrame([], "q_id long, prop string, prop_ord int")
    assert walk(spark, EDGES, properties=none) == []


def test_walk_hits(spark):
    table = spark.createDataFrame(EDGES, "src_path string, prop string, text string, dst_path string, ord int")
    seeds = spark.createDataFrame([(1, "city", "Город", 1000)], "q_id long, path string, title string, score int")
    got = graph.walk_hits(graph.bounded_walk(seeds, table), seeds, RU).orderBy("ord").collect()
    assert [r["score"] for r in got] == [1000, 899, 898, 897]
    assert got[1]["source_tag"] == "по P6 (глава) из «city»"


def test_predecessors(spark):
    pairs = spark.createDataFrame([("m3", "m2 (2000)"), ("m2", "m1[1]"), ("m1", "m3")], "name_key string, before string")
    starts = spark.createDataFrame([(1, "m3")], "q_id long, name string")
    got = graph.predecessor_chain(starts, pairs).orderBy("step").collect()
    assert [r["name"] for r in got] == ["m3", "m2", "m1"]


def naive_window(body, title, terms, cap):
    stems = [t[:-2] if len(t) >= 5 else t for t in terms]
    stems = list(dict.fromkeys(s for s in stems if s and s not in title.lower()))
    low, at = body.lower(), []
    for s in stems:
        i = low.find(s)
        while i >= 0:
            at.append(i)
            i = low.find(s, i + len(s))
    if len(body) <= cap:
        return body
    if not at:
        return body[:cap]
    counts = [(sum(a <= x < a + cap for x in at), -a) for a in sorted(at)]
    start = min(max(-max(counts)[1] - 100, 0), len(body) - cap)
    return body[start : start + cap]


@QUIET
@given(st.text("ab .", max_size=400), st.lists(st.sampled_from(["ab", "a b", "bba", "aabbab"]), max_size=3))
def test_windows_match_a_naive_search(body, terms):
    assert excerpts.plain_chunk(body, "t", terms, 30, Profile()) == naive_window(body, "t", terms, 30)


def test_window_columns_match_the_plain_form(spark):
    rows = [(k, "x" * (k * 7) + "мэр глава " * (k % 5) + "y" * 300 + "мэр города " * 3, "Город", ["мэров", "города"]) for k in range(30)] + [(99, "", "", []), (100, "z" * 500, "", [])]
    df = spark.createDataFrame(rows, "id int, body string, title string, terms array<string>")
    got = excerpts.relevant_chunk(df, id_col="id", body_col="body", title_col="title", terms_col="terms", cap=120, profile=RU)
    assert {r["id"]: r["chunk"] for r in got.collect()} == {i: excerpts.plain_chunk(b, t, w, 120, RU) for i, b, t, w in rows}


def pack_rows(spark, n, is_list, budget, body):
    rows = [(1, k, f"t{k}", f"s{k}", None, body, "", "", ["x"], is_list, 4, budget) for k in range(n)]
    return excerpts.packed(spark.createDataFrame(rows, "q_id long, ord int, title string, snippet string, source_tag string, body string, card string, section string, terms array<string>, is_list boolean, top_k int, budget int"), RU).head()


def test_packing_shares(spark):
    own = pack_rows(spark, 6, False, 4500, "b" * 5000)
    assert [len(x) for x in own["block"].split("=== t")[1:]][0] == 1125 + len("0 ===\n\n\n") and own["total"] == 6
    listed = pack_rows(spark, 10, True, 9000, "b" * 9000)
    assert len(listed["block"].split("=== t1")[0]) == 4950 + len("=== t0 ===\n\n\n")
    assert pack_rows(spark, 2, False, 4500, None)["block"] == "=== t0 ===\ns0\n\n=== t1 ===\ns1\n\n"


def merged(spark, items):
    df = spark.createDataFrame([(1, k, n, y) for k, (n, y) in enumerate(items)], "q_id long, ord int, name string, years string")
    return [(r["name"], r["years"]) for r in extraction.merged_items(df).orderBy("ord").collect()]


def test_merge(spark):
    assert merged(spark, [("Сергей Жилкин", "?"), ("Николай Уткин", "2000–2008"), ("сергей жилкин", "1996–2000")]) == [("сергей жилкин", "1996–2000"), ("Николай Уткин", "2000–2008")]
    assert merged(spark, [("Иван Петров", "2000"), ("Иван Петров", "1999–2005")]) == [("Иван Петров", "2000")]


def test_logs_round_trip(spark):
    rows = spark.createDataFrame([(k, 1704164645678 + k, "WARN", "TAG", f"msg\n{k}") for k in range(501)], "id long, timestamp long, level string, tag string, message string")
    lines = logs.formatted(rows).select("id", "line")
    assert lines.filter("id = 0").head()["line"] == "2024-01-02 03:04:05.678 W/TAG: msg\u00010"
    back = logs.parsed_lines(lines.union(spark.createDataFrame([(9, "malformed")], "id long, line string")))
    assert back.select("id", "timestamp", "level", "tag", "message").exceptAll(rows).count() == 0 and back.count() == 501
    assert logs.tail(rows).agg(F.min("id"), F.count("*")).head()[:] == (1, 500)
    assert sum(r["line"].count("\n") for r in logs.dumped(rows.filter("id < 2")).collect()) == 2
    cut = logs.rotated(lines.withColumn("log", F.lit(1)), "id", by="log", size=1000)
    assert 200 < cut.count() <= 251 and cut.agg(F.max("id")).head()[0] == 500


def test_rates(spark):
    assert spark.range(1).select(metrics.eta_ms(F.lit(1000), F.lit(3000), F.lit(11), F.lit(111))).head()[0] == 18181
    assert spark.range(1).select(metrics.eta_ms(F.lit(1000), F.lit(3000), F.lit(1), F.lit(111))).head()[0] is None
    assert spark.range(1).select(metrics.per_second(F.lit(50), F.lit(10000)), metrics.per_second(F.lit(50), F.lit(0))).head()[:] == (5.0, 0.0)


def test_name_match(spark):
    rows = hits(spark, [("Самара", "a", 1), ("Сухих, Илья Геннадьевич", "b", 1)])
    assert paths(candidates.best_name_match(rows, F.lit("Илья Геннадьевич Сухих"))) == ["b"]


def test_map_edits(one):
    m = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    assert one(metrics.with_entry(m, F.lit("a"), F.lit(5))) == {"b": 2, "a": 5}
    assert one(metrics.without_key(m, F.lit("a"))) == {"b": 2}


def test_throttle_and_debounce(spark):
    rows = spark.createDataFrame([("a", t) for t in (0, 150, 300, 350, 900)], "id string, ms long")
    assert sorted(r["ms"] for r in metrics.throttled(rows, by="id", ts_ms="ms").collect()) == [0, 300, 900]
    assert sorted(r["ms"] for r in metrics.debounced(rows, by="id", ts_ms="ms").collect()) == [350, 900]


def test_budget_pack_matches_a_plain_version(spark):
    """The query over all documents: ten to a question, of which every other one asks for a list."""
    groups = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect():
        groups.setdefault(r["doc_id"] // 10, []).append(r)
    want = {}
    for q, rows in groups.items():
        is_list = rows[0]["doc_id"] % 20 < 10
        count = min(12, max(5, len(rows) + 2)) if is_list else 4
        share = max(4500 // count, 500)
        block, titles = "", []
        for k, r in enumerate(rows[:count]):
            if r["text"] is None:
                continue
            if 4500 - len(block) <= 200:
                break
            cap = min(4500 - len(block), 4500 * 55 // 100 if k == 0 and is_list else share)
            title = f"doc {r['doc_id']}"
            chunk = r["text"] if len(r["text"]) <= cap else naive_window(r["text"], title, ["tion", "ment"], cap)
            block += f"=== {title} ===\n{chunk}\n\n"
            titles.append(title)
        want[q] = (block, titles, len(rows))
    got = {r["q_id"]: (r["block"], r["titles"], r["total"]) for r in queries()["budget_pack"](spark, str(DATA)).collect()}
    assert got == want


def test_one_page_tree_stands_at_a_time(spark):
    """A tree is gone with its page, without the collector, and Arrow batches hold few pages."""
    import gc
    import weakref

    gc.disable()
    try:
        page = html.Page("<div><p>a<p>b<ul><li>c</ul></div>", RU)
        root = weakref.ref(page.root)
        assert page.body() == "a b c"
        del page
        assert root() is None
    finally:
        gc.enable()
    rows = spark.range(700).repartition(1).select("id", html.parsed(F.concat(F.lit("<h2>t</h2><p>x"), F.col("id").cast("string")), RU).alias("p"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256
    assert {(r["id"], r["body"]) for r in rows.select("id", "p.body").collect()} == {(k, f"t x{k}") for k in range(700)}


def test_answers_are_parsed_once(spark):
    """No step of the parse stands in the plan twice, and a filter on the items' size does not repeat it."""
    rows = [(1, 0, "кто мэр", "Иван Петров", False, "Иван Петров — 1990 год\nДругой — 1999"), (1, 1, "кто мэр", "Пётр Сидоров", False, "ДА."), (2, 0, "кто мэр", "Х", True, None)]
    got = extraction.reduced(spark.createDataFrame(rows, "q_id long, ord int, question string, title string, is_seed boolean, raw string"), RU)
    assert got._jdf.queryExecution().optimizedPlan().toString().count(r"{2013}\x{2014}") == 1
    assert {(r["q_id"], r["name"], r["years"]) for r in got.collect()} == {(1, "Иван Петров", "1990"), (1, "Пётр Сидоров", "?")}
